"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more, and their components.

It is the blocked product of the sparse document by shingle matrix with itself, of which only rows and columns are formed that can
matter. Two sets that link share one of the first floor(n / 4) + 1 shingles of each, in any order common to all (prefix bound). The
order used puts shingles of many documents last, so that passages many documents share hardly ever stand in a prefix:

1. count the first half of each set's shingles in hash order; those of `hot` or more documents go last from now on (the order may be any:
   it decides about the work, not about the result). Half, as prefixes without hot shingles reach beyond the first quarter;
2. count the prefixes in that order and note, in a bit map that grows with their number up to 2^30 bits, which shingles two documents
   share; others link nothing;
3. write the sets' digests and the shared part of their prefixes. Equal sets are one node from here on;
4. star: every node is a candidate of one hub per shingle, the node with the fewest rare shingles. Candidates whose sizes allow it are
   verified by the product of their incidence rows, in blocks; the links give preliminary components;
5. rest: where the nodes of a shingle still lie in different components, their pairs accumulate overlap counts over the prefix; those
   that can't reach the bound (count so far and what is left of the smaller set) are discarded, and the others are verified. Where many
   nodes share a shingle, all nodes that such shingles connect are multiplied in blocks, and only links leave a block.

Candidates of both kinds first pass a bound by bins: the sum over a few hundred bins of shingles of the smaller of both counts.

A pair is left out only if it can't link or its ends are connected already, so the components are those of all links.
Sets and nodes are known by 64-bit digests: two different ones of n meet with a chance of n^2 / 2^65.

Defined cases: a text without words has an empty set and is its own component; fewer than five words make one shingle; rows with a null
doc_id take part, a component without any other doc_id has a null id; repeated rows are repeated; an empty table gives no rows; other
columns are not read (keep_one() keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.components import components
from candlewick.llm.words import Hasher, lean_arrow, shingle_sets, slices, texts
from candlewick.session import discard, release, written

WORDS = 5
#: The shared-shingle map has 2^26 to 2^30 bits, 16 for each shared shingle while that is enough, and the list of hot shingles at most so
#: many entries: what is broadcast has a bound. A fuller map only lets more shingles through that no other document has.
MAP_WORDS, MOST_WORDS = 1 << 20, 1 << 24
HOT_ENTRIES = 1_000_000
BINS = 256
LONG = 400
LEAST_SET = 3  # smaller sets link with equal ones alone


class Order:
    """Hash order, with the hot shingles after all others."""

    def __init__(self, hot: np.ndarray):
        self.hot = np.sort(hot)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hot & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """The shingles in order, and how many aren't hot. The argument is sorted."""
        if not len(self.hot):
            return shingles, len(shingles)
        hot = self.maybe[(shingles & np.uint64(len(self.maybe) - 1)).astype(np.int64)]
        at = np.flatnonzero(hot)
        if len(at):
            x = shingles[at]
            hot[at] = self.hot[np.minimum(np.searchsorted(self.hot, x), len(self.hot) - 1)] == x
        return np.concatenate([shingles[~hot], shingles[hot]]), int((~hot).sum())


def prefix_size(n: int) -> int:
    return n // 4 + 1


def signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = Hasher()
    for b in slices(batches, 128, 1 << 19):
        yield b, shingle_sets(*hasher(texts(b)), WORDS)


#: How many digests a task remembers, to give equal sets once; then it starts anew (equal sets that come twice do no harm).
SEEN = 200_000


def _prefix_rows(docs: DataFrame, hot: np.ndarray, size: Callable[[int], int] = prefix_size) -> DataFrame:
    """The prefix shingles of every document, as rows; of documents with equal sets in a task, those of one."""
    held = docs.sparkSession.sparkContext.broadcast(hot)
    schema = pa.schema([("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(held.value), set()
        for _, sets in _sets(batches):
            out = [np.zeros(0, np.uint64)]
            for x in sets:
                if len(x) >= LEAST_SET and (sig := signature(x)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sig)
                    out.append(order(x)[0][: size(len(x))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], schema=schema)

    return docs.select("text").mapInArrow(run, "s long")


def _hot(docs: DataFrame, least: int) -> np.ndarray:
    half = _prefix_rows(docs, np.zeros(0, np.uint64), lambda n: n // 2 + 1)
    counts = written(half.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "join-hot")
    got = counts.orderBy(F.desc("n"), "s").limit(HOT_ENTRIES).select("s").toArrow()
    discard(counts)
    return got.column("s").to_numpy().view(np.uint64)


def map_words(shared: int) -> int:
    """Words of 64 bits of the map for so many shared shingles; a power of two."""
    return min(MOST_WORDS, max(MAP_WORDS, 1 << (max(shared, 1) * 16 // 64).bit_length()))


def _shared(docs: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Bit map of the prefix shingles that occur in two documents or more."""
    twice = written(_prefix_rows(docs, hot).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s"), "join-twice")
    words = map_words(twice.count())
    bits = twice.groupBy(F.expr(f"CAST(shiftrightunsigned(s, 6) & {words - 1} AS int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS int)))").alias("bits"))
    bits = written(bits, "join-map")
    got = bits.toArrow()
    discard(twice, bits)
    out = np.zeros(words, np.uint64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _written_sets(docs: DataFrame, hot: np.ndarray, shared: np.ndarray) -> DataFrame:
    """doc_id, sig, n of every row; rare, and the shared prefix shingles with their places, of the first row with that set in a task."""
    held = docs.sparkSession.sparkContext.broadcast((hot, shared))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("rare", pa.int64()), ("pre", longs), ("at", longs), ("bins", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits, seen = Order(held.value[0]), held.value[1], set()
        for b, sets in _sets(batches):
            sig = np.array([signature(x) for x in sets], np.uint64)
            pre, at, rare, bins = [], [], [], []
            for s, x in zip(sig.tolist(), sets, strict=True):
                found = None
                if len(x) >= LEAST_SET and s not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(s)
                    ordered, few = order(x)
                    p = ordered[: prefix_size(len(x))]
                    keep = np.flatnonzero((bits[((p >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
                    found = p[keep].view(np.int64) if len(keep) else None
                pre.append(found)
                bins.append(None if found is None else np.bincount((x & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.int32).tobytes())
                at.append(None if found is None else keep)
                rare.append(0 if found is None else few)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(sig.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(rare, pa.int64()), pa.array(pre, longs), pa.array(at, longs), pa.array(bins, pa.binary())],
                schema=schema,
            )

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sig long, n long, rare long, pre array<long>, at array<long>, bins binary"), "join-sets")


def _needed_sets(docs: DataFrame, firsts: DataFrame, nodes: DataFrame, few: int = 1_000_000) -> list[DataFrame]:
    """(sig, shingles) of the nodes, in one or more tables: one document of each (firsts: sig, doc_id) is read again.

    Documents are read once for each `few` nodes, so that the nodes can be broadcast: no text is ever shuffled.
    """
    reps = written(firsts.select("sig", "doc_id").join(nodes, "sig", "left_semi"), "join-reps")
    schema = pa.schema([("sig", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            sets = {signature(x): x for x in sets}
            yield pa.RecordBatch.from_arrays([pa.array(np.array([*sets], np.uint64).view(np.int64)), pa.array([x.view(np.int64) for x in sets.values()], pa.list_(pa.int64()))], schema=schema)

    out, parts = [], max(1, -(-reps.count() // few))
    for part in range(parts):
        mine = reps.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
        texts_ = docs.join(F.broadcast(mine.select("doc_id").distinct()), "doc_id", "left_semi")
        if mine.where("doc_id IS NULL").limit(1).count():
            texts_ = texts_.union(docs.where("doc_id IS NULL"))
        made = texts_.select("text").mapInArrow(run, "sig long, shingles array<long>")
        made = written(made.join(F.broadcast(mine.select("sig")), "sig", "left_semi"), "join-shingles")
        again = made.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # where a doc_id is that of several rows
        if again.limit(1).count():
            whole, made = made, written(made.dropDuplicates(["sig"]), "join-shingles")
            discard(whole)
        out.append(made)
    discard(reps)
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def _overlaps(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The product of two blocks of incidence rows, of which the diagonal is wanted: sizes of the intersections."""
    sizes = np.array([[len(a), len(b)] for a, b in pairs])
    row = np.repeat(np.arange(len(pairs)), sizes.sum(1))
    cell = np.concatenate([x for p in pairs for x in p])
    order = np.lexsort((cell, row))
    row, cell = row[order], cell[order]
    twice = (row[1:] == row[:-1]) & (cell[1:] == cell[:-1])
    return np.bincount(row[1:][twice], minlength=len(pairs))


#: Pairs whose sets are brought together at once, and the most such rounds: a pair carries a whole set through a shuffle.
ROUND_PAIRS, ROUNDS = 100_000, 8


def _links(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that link, in rounds by b, so that the disk holds the shuffled sets of one round only."""
    n = candidates.count()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
        flat, stops = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        return np.split(flat, stops[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            x, y = rows(b.column("x")), rows(b.column("y"))
            both, total = _overlaps(list(zip(x, y, strict=True))), np.array([len(i) + len(j) for i, j in zip(x, y, strict=True)])
            yield b.select(["a", "b"]).filter(pa.array(7 * both >= 3 * total)).cast(schema)

    out, rounds = [], min(ROUNDS, max(1, -(-n // ROUND_PAIRS)))
    turn_of = lambda column: F.pmod(F.xxhash64(column), F.lit(rounds))
    most = candidates.groupBy(turn_of("b")).count().agg(F.max("count")).first()[0] if rounds > 1 else n
    small = F.broadcast if most <= 500_000 else (lambda df: df)
    first, second = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
    for turn in range(rounds):
        df = small(candidates.where(turn_of("b") == turn)).join(first, "a").join(second.where(turn_of("b") == turn), "b")
        out.append(written(df.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "join-links"))
    return _all(out)


def _possible(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """The candidate pairs that may link by how many shingles of either set fall into each of a few hundred bins."""
    small = F.broadcast if candidates.limit(500_001).count() <= 500_000 else (lambda df: df)
    nodes = candidates.select(F.col("a").alias("sig")).union(candidates.select("b")).distinct()
    # Written, so that the join by hub is one of plain exchanges, which AQE splits where very many nodes share a hub.
    bins = written(table.where("bins IS NOT NULL").select("sig", "bins").join(small(nodes), "sig", "left_semi").dropDuplicates(["sig"]), "join-bins")
    df = small(candidates).join(bins.select(F.col("sig").alias("a"), F.col("bins").alias("x")), "a").join(bins.select(F.col("sig").alias("b"), F.col("bins").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32).reshape(-1, BINS) for c in ("x", "y"))
            yield b.select(["a", "b"]).filter(pa.array(7 * np.minimum(x, y).sum(1) >= 3 * (x.sum(1) + y.sum(1))))

    left = written(df.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "join-possible")
    discard(bins)
    return left


_SIZES = "4 * least(n, n2) >= 3 * greatest(n, n2)"


#: c of the overlap is counted, and at most what follows the last counted shingle is left of either set.
_REACH = "7 * (c + least(n - 1 - i, n2 - 1 - j)) >= 3 * (n + n2)"


def _star(postings: DataFrame) -> DataFrame:
    """Each node with the hubs of its shingles, if the hub's shingles alone let the pair reach the bound."""
    hubs = postings.groupBy("s").agg(F.min(F.struct("rare", "sig", "n", "at")).alias("hub"), F.count(F.lit(1)).alias("df")).where("df > 1")
    hubs = written(hubs.select("s", F.col("hub.sig").alias("b"), F.col("hub.n").alias("n2"), F.col("hub.at").alias("at2")), "join-hubs")
    pairs = postings.join(hubs, "s").where(F.col("sig") != F.col("b")).where(_SIZES)
    counted = pairs.groupBy(F.col("sig").alias("a"), "b", "n", "n2").agg(F.count(F.lit(1)).alias("c"), F.max("at").alias("i"), F.max("at2").alias("j"))
    star = written(counted.where(_REACH).select("a", "b"), "join-star")
    discard(hubs)
    return star


def _open(rooted: DataFrame) -> DataFrame:
    """The postings of shingles whose nodes lie in different components, with the number of these nodes."""
    mixed = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("df")).where("low < high").select("s", "df")
    mixed = written(mixed, "join-mixed")
    left = written(rooted.drop("df").join(mixed, "s"), "join-open")
    discard(mixed)
    return left


def _pairs(mine: DataFrame) -> DataFrame:
    """Pairs of nodes with a common shingle and different roots, once per shingle."""
    other = mine.select("s", F.col("sig").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"))
    both = mine.join(other, "s").where((F.col("root") != F.col("root2")) & (F.col("sig") > F.col("b"))).where(_SIZES)
    return both.select(F.col("sig").alias("a"), "b", "n", "n2", "at", "at2")


def _product(x: list[np.ndarray], y: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Overlap counts of two blocks of sets, accumulated over column blocks of their incidence matrices; columns of one set are left out."""
    flat = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    stops = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (i, j) in enumerate(zip(stops, stops[1:], strict=False)):
        part = np.zeros((len(x) + len(y), width), np.float32)
        part[row[i:j], column[i:j] - k * width] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out


def _block_links(group: pa.Table) -> pa.Table:
    """Of the nodes of one or two blocks, links that connect what all their links connect."""
    sig, root, block = (group.column(c).to_numpy() for c in ("sig", "root", "block"))
    held = group.column("shingles").combine_chunks()
    sets = np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1])
    first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    n = np.array([len(v) for v in sets])
    both = _product([sets[i] for i in first], [sets[i] for i in second])
    a, b = np.nonzero((7 * both >= 3 * (n[first][:, None] + n[second][None, :])) & (root[first][:, None] != root[second][None, :]))
    a, b = first[a], second[b]
    label = np.arange(len(sig))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(sig)))
    return pa.table({"a": pa.array(sig[moved], pa.int64()), "b": pa.array(sig[label[moved]], pa.int64())})


#: Sets' shingles sent to block products at once: so many times those of the families' sets, or so many shingles if that is more.
SENT, SENT_LEAST = 2, 20_000_000


def _blocks(many: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """Links among nodes of shingles that many share, by products of blocks of about `size` sets, or LONG shingles for each of them, at most.

    Nodes that such shingles connect are a family; each two blocks of a family meet in one task. Only links leave it, at most one a node.
    A set is sent once for each block of its family, which grows with the square of the family: it is done in rounds, so that the disk
    holds no more at once than a small multiple of the sets.
    """
    least = written(many.groupBy("s").agg(F.min("sig").alias("m")), "join-least")
    families = components(many.join(least, "s").select(F.col("sig").alias("a"), F.col("m").alias("b")).distinct())
    nodes = many.select("sig", "root", "n").distinct().join(families.select(F.col("node").alias("sig"), F.col("root").alias("family")), "sig")
    nodes = written(nodes, "join-family")
    # By number of sets and by their shingles, so that a block of long sets stays as small.
    whole = F.greatest(F.count(F.lit(1)) / size, F.sum("n") / (size * LONG))
    blocks = written(nodes.groupBy("family").agg(F.ceil(whole).cast("int").alias("blocks"), F.sum("n").alias("held")), "join-blocks")
    held, sent = blocks.agg(F.sum("held"), F.sum(F.col("held") * F.col("blocks"))).first()
    rounds = -(-int(sent) // max(SENT * int(held), SENT_LEAST))
    placed = nodes.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    placed = placed.join(sets, "sig").select("sig", "root", "family", "block", "blocks", "shingles")
    placed = written(placed, "join-placed") if rounds > 1 else placed
    out = []
    for turn in range(rounds):
        paired = placed.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        keyed = paired.select("sig", "root", "family", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        keyed = keyed.where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(rounds)) == turn)
        out.append(written(keyed.groupBy("family", "i", "j").applyInArrow(_block_links, "a long, b long"), "join-block-links"))
    discard(least, nodes, blocks, *[placed] * (rounds > 1))
    return _all(out)


def _rest(postings: DataFrame, done: DataFrame, wanted: Callable[[DataFrame], list[DataFrame]], linked: Callable[[DataFrame], DataFrame], large: int = 48, block: int = 512) -> DataFrame:
    """Links between nodes with a common prefix shingle that aren't connected yet.

    postings (written, and discarded here) have a root; wanted(nodes) gives the nodes' sets, linked(pairs) those that link. Where at most `large` nodes share a shingle,
    their pairs are counted and bounded; the others' would be many, and never leave their tasks.
    """
    mine = _open(postings)
    discard(postings)
    many = mine.where(F.col("df") > large)
    counted = _pairs(mine.where(F.col("df") <= large)).groupBy("a", "b", "n", "n2").agg(F.count(F.lit(1)).alias("c"), F.max("at").alias("i"), F.max("at2").alias("j"))
    known = done.union(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = linked(written(counted.where(_REACH).select("a", "b").join(known, ["a", "b"], "left_anti"), "join-rest"))
    if many.limit(1).count():
        sets = wanted(many.select("sig").distinct())
        links = links.union(_blocks(many, _all(sets), block))
        discard(*sets)
    discard(mine)
    return links


def classes(docs: DataFrame, hot: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id and sig (the set's digest) of every row of docs (doc_id, text)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    lean_arrow(docs.sparkSession)
    late = _hot(docs, hot)
    release(docs.sparkSession)
    shared = _shared(docs, late)
    release(docs.sparkSession)
    whole = _written_sets(docs, late, shared)
    # Of the table of all columns, which is by far the largest, only what later steps read is kept.
    table = written(whole.select("doc_id", "n", "sig"), "join-rows")
    bins = written(whole.where("bins IS NOT NULL").select("sig", "bins"), "join-all-bins")
    postings = whole.where("pre IS NOT NULL").select("sig", "n", "rare", F.inline(F.arrays_zip("pre", "at"))).withColumnRenamed("pre", "s")
    # Equal sets come once per task that has them.
    postings = written(postings.groupBy("s", "sig").agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.max("at").alias("at")), "join-postings")
    discard(whole)
    # The documents of one set are combined before they are shuffled: they may be very many.
    firsts = written(table.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "join-firsts")

    def linked(candidates: DataFrame) -> DataFrame:
        left = _possible(candidates, bins)
        sets = _needed_sets(docs, firsts, left.select(F.col("a").alias("sig")).union(left.select("b")).distinct())
        found = _links(left, _all(sets))
        discard(left, *sets)
        return found

    star = _star(postings)
    links = linked(star)
    release(docs.sparkSession)
    roots = components(links)
    rooted = postings.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = written(rooted, "join-rooted")
    discard(postings)
    links = links.union(_rest(rooted, star, lambda nodes: _needed_sets(docs, firsts, nodes), linked))
    discard(bins)
    release(docs.sparkSession)
    roots = components(links)
    own = firsts.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    own = written(own, "join-own")
    whole = written(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-components")
    by_set = written(own.join(whole, "root").select("sig", "component_id"), "join-classes")
    # A plain join of written tables: where very many documents share a set, AQE splits its partition.
    full = table.where("n > 0").select("doc_id", "n", "sig").join(by_set, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "sig")
    return full.union(table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sig"))


def keep_one(docs: DataFrame, few: int = 1_000_000) -> DataFrame:
    """docs without those that belong to a component with a smaller doc_id; all columns stay.

    A doc_id goes only if all rows that carry it do; rows that repeat the least doc_id of a component all stay. Ids that go are broadcast,
    at most about `few` at once: docs, with their texts, are never shuffled.
    """
    found = classes(docs)
    loses = F.coalesce(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("component_id").isNotNull(), F.lit(False))
    gone = found.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_and(loses).alias("loses")).where("loses").select("__id")
    gone = written(gone, "join-gone")
    parts = max(1, -(-gone.count() // few))
    for part in range(parts):
        ids = F.broadcast(gone.where(F.pmod(F.xxhash64("__id"), F.lit(parts)) == part))
        docs = docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_anti")
    return docs
