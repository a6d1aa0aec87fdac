"""Benchmark decontamination, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item, or a shorter item's words as a whole. Whole texts are scanned in two steps. First,
every 8th position of a document gives the hash of 6 words (any 13-word window holds such a position in full); the hashes are looked up
in the broadcast set of all 6-word hashes of the items. Few documents survive that. All windows of theirs are then looked up by hash, and
where one is found its words are formed, and it counts only if they are equal. Both steps know a text by its digest, so copies are verified
once.

Defined cases: a null text or item has no words; items without words or with a null id are ignored, item ids count once however often
they occur; repeated rows give repeated results; without items nothing is hit; an empty table gives no rows; other columns are not read
(decontaminate() keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: What is broadcast has at most so many rows and bytes; else the planner joins it as any other table.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 1 << 26


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD), "")


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it has at most that many rows and bytes; else joined as the planner likes."""
    of = {"string": F.octet_length, "binary": F.octet_length}
    each = [of[t](c) if t in of else F.octet_length(F.to_json(F.struct(c))) if t.startswith(("array", "map", "struct")) else F.lit(8) for c, t in df.dtypes]
    each = [F.coalesce(x.cast("long"), F.lit(0)) + 16 for x in each]
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(each[1:], each[0])), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if got["n"] <= rows and got["size"] <= size else df


def _names(df: DataFrame) -> list[str]:
    """The columns' names, quoted."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def _free(df: DataFrame, name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _grams(words_col: str, k: int, stride: int) -> Column:
    """Hashes of k words, at every stride-th position."""
    last = f"size({words_col}) - {k - 1}"
    return F.expr(f"IF(size({words_col}) < {k}, CAST(array() AS array<bigint>), transform(sequence(1, greatest({last}, 1), {stride}), i -> xxhash64(slice({words_col}, i, {k}))))")


@dataclass(frozen=True)
class Windows:
    """The benchmark's windows (w: the words joined, h: the hash of the words, items), their lengths, and the anchors of the first step."""

    table: DataFrame
    anchors: DataFrame
    lengths: tuple[int, ...]

    def shapes(self) -> list[tuple[int, int]]:
        """(words, stride) of the anchors of each window length."""
        return [((n + 1) // 2 - (n == WINDOW), n - ((n + 1) // 2 - (n == WINDOW)) + 1) for n in self.lengths]


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Windows:
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    items = written(items.withColumn("n", F.least(F.size("ws"), F.lit(WINDOW))), "benchmark-items")
    lengths = tuple(sorted(r.n for r in items.select("n").distinct().collect()))
    each = items.select("item", "n", F.expr("inline(transform(sequence(1, size(ws) - n + 1), i -> struct(array_join(slice(ws, i, n), ' ') AS w, xxhash64(slice(ws, i, n)) AS h)))"))
    table = each.groupBy("w", "h", "n").agg(F.collect_set("item").alias("items"))
    out = Windows(table, table, lengths)
    anchors = None
    for n, (k, _) in zip(lengths, out.shapes(), strict=True):
        part = items.where(F.col("n") == n).select(F.explode(_grams("ws", k, 1)).alias("anchor"))
        anchors = part if anchors is None else anchors.union(part)
    anchors = anchors.distinct() if anchors is not None else items.select(F.lit(0).cast("long").alias("anchor")).limit(0)
    return Windows(written(table, "benchmark-windows"), written(anchors, "benchmark-anchors"), lengths)


def _first_step(docs: DataFrame, win: Windows) -> DataFrame:
    """One row per (doc_id, text): n_words, how many rows it stands for, and whether an anchor occurs."""
    df = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), words(F.col("text")).alias("ws"))
    grams = [_grams("ws", k, stride) for k, stride in win.shapes()]
    df = df.select("doc_id", "digest", F.size("ws").cast("long").alias("n_words"), (F.concat(*grams) if grams else F.expr("CAST(array() AS array<bigint>)")).alias("anchors"))
    df = df.select("doc_id", "digest", "n_words", F.posexplode_outer("anchors").alias("pos", "anchor"))
    hit = df.join(_small(win.anchors.withColumn("there", F.lit(True))), "anchor", "left")
    return hit.groupBy("doc_id", "digest", "n_words").agg(F.coalesce(F.max("there"), F.lit(False)).alias("near"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"))


def _second_step(docs: DataFrame, near: DataFrame, win: Windows) -> DataFrame:
    """Per digest: the union of hit intervals as (start, stop) word numbers, and the items hit, sorted as strings."""
    wanted = near.where("near").select("digest").distinct()
    texts = docs.select(text_digest(F.col("text")).alias("digest"), "text").join(_small(wanted), "digest", "left_semi")
    texts = written(texts.groupBy("digest").agg(F.max("text").alias("text")), "decontamination-texts").select("digest", words(F.col("text")).alias("ws"))
    every = [
        F.expr(f"IF(size(ws) < {n}, array(), transform(sequence(1, greatest(size(ws) - {n - 1}, 1)), i -> struct(i AS at, {n} AS n, xxhash64(slice(ws, i, {n})) AS h)))") for n in win.lengths
    ]
    spots = texts.select("digest", F.inline(F.concat(*every))).join(_small(win.table.select("h").distinct()), "h", "left_semi")
    spots = written(spots.groupBy("digest").agg(F.collect_list(F.struct("at", "n", "h")).alias("spots")), "decontamination-spots")
    found = texts.join(_small(spots), "digest").select("digest", F.inline(F.expr("transform(spots, x -> struct(x.at, x.n, x.h, array_join(slice(ws, x.at, x.n), ' ') AS w))")))
    table = _small(win.table.select("h", F.col("w").alias("w2"), F.col("n").alias("n2"), "items"))
    hit = found.join(table, "h").where((F.col("w") == F.col("w2")) & (F.col("n") == F.col("n2")))
    got = hit.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("stop")))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.expr("""aggregate(spans, CAST(array() AS array<struct<start:int,stop:int>>), (a, s) ->
        IF(size(a) > 0 AND a[greatest(size(a) - 1, 0)].stop >= s.at,
           array_append(slice(a, 1, size(a) - 1), named_struct('start', a[greatest(size(a) - 1, 0)].start, 'stop', greatest(a[greatest(size(a) - 1, 0)].stop, s.stop))),
           array_append(a, named_struct('start', s.at, 'stop', s.stop))))""")
    return got.select("digest", merged.alias("hits"), "items").select(
        "digest", "hits", F.expr("aggregate(hits, 0L, (a, s) -> a + s.stop - s.start)").alias("n_hit"), "items"
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, words hit, items with occurring windows, and whether it is contaminated."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    win = windows(benchmark)
    near = written(_first_step(docs, win), "decontamination-near")
    none = F.sha2(F.lit(""), 256)
    if win.lengths:
        found = written(_second_step(docs, near, win), "decontamination-hits")
        df = near.join(found.select("digest", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "digest", "left")
    else:
        df = near.select("*", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    df = df.select("doc_id", "n_words", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hit", "n_items")], F.coalesce("items_sha256", none).alias("items_sha256"), "copies")
    return df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated().alias("contaminated"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text") -> DataFrame:
    """docs without the contaminated ones (documents), or with the hit words, and what follows each up to the next word, cut out (spans)."""
    win = windows(benchmark)
    if not win.lengths:
        return docs
    quoted = "`" + text.replace("`", "``") + "`"
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(quoted).alias("text"))
    near = written(_first_step(plain, win), "decontamination-near")
    found = written(_second_step(plain, near, win), "decontamination-hits")
    digest, hits, ws, gaps = (_free(docs, c) for c in ("__digest", "__hits", "__ws", "__gaps"))
    if mode == "documents":
        gone = found.join(near.select("digest", "n_words"), "digest").where(contaminated()).select(F.col("digest").alias(digest))
        return docs.withColumn(digest, text_digest(F.col(quoted))).join(_small(gone), digest, "left_anti").select(*_names(docs))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
    cut = found.select(F.col("digest").alias(digest), F.col("hits").alias(hits))
    df = docs.withColumn(digest, text_digest(F.col(quoted))).join(_small(cut), digest, "left")
    hit = F.col(hits).isNotNull()
    df = df.select("*", F.when(hit, F.regexp_extract_all(F.col(quoted), F.lit(word), F.lit(0))).alias(ws), F.when(hit, F.split(F.col(quoted), word, -1)).alias(gaps))
    kept = F.expr(f"concat({gaps}[0], array_join(transform({ws}, (w, i) -> IF(exists({hits}, s -> i + 1 >= s.start AND i + 1 < s.stop), '', concat(w, {gaps}[i + 1]))), ''))")
    return df.withColumn(text, F.when(hit, kept).otherwise(F.col(quoted))).select(*_names(docs))
