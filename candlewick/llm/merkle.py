"""Merkle manifest of a dataset: a digest for every row, a tree for every group of rows, and a tree of the groups' roots.

H is SHA-256 in lower-case hex of its inputs, one after the other; digests go in as hex text. A row's leaf is H of its fields, each as "-"
if null, else as its UTF-8 length, ":" and its value. The leaves of a group ascend by their key; while a level has several nodes, every
`fanout` consecutive ones (in the last run: what is left, even one) become their H. The groups' roots, in ascending order of the group
(null first, then bytewise), are the leaves of one more tree.

Order of work: leaves are written once, narrow; a range sort and the ranges' counts give every leaf its place, and places give aligned
blocks of fanout ** k leaves. Blocks are the unit of every task: their digests lie in one contiguous byte matrix, a level is that matrix
reshaped by fanout and hashed row by row, and index arithmetic finds all siblings. A block's root is a leaf of the next round, so 10^10
rows need three rounds. Then paths go back down: a block receives the path above its root and gives each leaf its own. No task sees more
than a block, whatever a group's size, and the driver sees counts only.

Defined cases: a null key comes first in its group; rows of one key come in order of their leaves; repeated rows are leaves of their own;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.session import written

HEX = 64
#: Leaves of a block at most.
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field's part of the row's leaf."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def matrix(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Hex digests as rows of bytes."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def strings(m: np.ndarray) -> list[str]:
    s = m.tobytes().decode()
    return [s[i : i + HEX] for i in range(0, len(s), HEX)]


def hashed(rows: np.ndarray) -> np.ndarray:
    """H of every row of a byte matrix."""
    raw, width = memoryview(rows.tobytes()), rows.shape[1]
    return np.frombuffer("".join([sha256(raw[i : i + width]).hexdigest() for i in range(0, len(raw), width)]).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, fanout: int, count: int) -> list[np.ndarray]:
    """The digests of so many levels above the leaves, and theirs first."""
    out = [leaves]
    for _ in range(count):
        m = out[-1]
        whole = len(m) // fanout * fanout
        parts = [hashed(m[:whole].reshape(-1, fanout * HEX))] if whole else []
        if whole < len(m):
            parts.append(hashed(m[whole:].reshape(1, -1)))
        out.append(np.concatenate(parts))
    return out


def height(size: int, fanout: int, most: int) -> int:
    """Levels above the leaves of a tree's block: until one node is left, but for trees of several blocks as many as a block has."""
    n = 0
    while size > 1 and n < most:
        size, n = -(-size // fanout), n + 1
    return n


def siblings(tree: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all leaves and levels: the digests of the others of the run (leaf, level, other, byte), which of them exist, and the leaf's
    own place in its run (leaf, level)."""
    at = np.arange(len(tree[0]))
    found, there, own = [], [], []
    for m in tree[:-1]:
        place = at % fanout
        others = np.arange(fanout - 1) + (np.arange(fanout - 1) >= place[:, None])
        index = (at - place)[:, None] + others
        there.append(index < len(m))
        found.append(m[np.minimum(index, len(m) - 1)])
        own.append(place)
        at = at // fanout
    if not own:
        return np.zeros((len(at), 0, fanout - 1, HEX), np.uint8), np.zeros((len(at), 0, fanout - 1), bool), np.zeros((len(at), 0), np.int64)
    return np.stack(found, 1), np.stack(there, 1), np.stack(own, 1)


def folded(own: np.ndarray, tree: list[np.ndarray], fanout: int) -> np.ndarray:
    """The block's root as each leaf's digest in `own` and the siblings of its place give it."""
    at = np.arange(len(own))
    for m in tree[:-1]:
        place = at % fanout
        width = np.minimum(fanout, len(m) - (at - place))
        up = np.empty_like(own)
        for w in np.unique(width).tolist():
            some = np.flatnonzero(width == w)
            runs = m[(at - place)[some, None] + np.arange(w)]
            runs[np.arange(len(some)), place[some]] = own[some]
            up[some] = hashed(runs.reshape(len(some), w * HEX))
        own, at = up, at // fanout
    return own


def fold_path(digest: str, places: list[int], others: list[str]) -> str:
    """The root that a digest gives with a path: at each level its place among the others' digests."""
    for place, s in zip(places, others, strict=True):
        digest = sha256((s[: place * HEX] + digest + s[place * HEX :]).encode()).hexdigest()
    return digest


@dataclass
class Shape:
    fanout: int = 2
    most: int = BLOCK

    def __post_init__(self) -> None:
        if self.fanout < 2:
            raise ValueError("a fanout is 2 or more")
        self.levels = 1
        while self.fanout ** (self.levels + 1) <= self.most:
            self.levels += 1
        self.block = self.fanout**self.levels


def placed(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows (with column tree, never null) with `at`, the place among the tree's rows in order of keys, and `size`, the tree's rows.

    The row's own number is the last key of the ranges, so that neither a tree nor a key fills a task; ranges are counted, not scanned.
    """
    order = ["tree", *keys, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), label)
    part, row = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    runs = dealt.groupBy("tree", part).agg(F.min(row).alias("_least"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # a row per range and tree
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("tree", "_part", (before - F.col("_least")).alias("_shift"), F.sum("_n").over(tree).alias("size")), f"{label}-runs")
    return dealt.withColumn("_part", part).join(runs, ["tree", "_part"]).withColumn("at", row + F.col("_shift")).drop("_id", "_part", "_shift")


_NODES = "tree string, at long, size long, digest string"


def _reduce(shape: Shape) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        size = block["size"][0].as_py()
        top = levels(matrix(block["digest"]), shape.fanout, height(size, shape.fanout, shape.levels))[-1]
        return pa.table({"tree": block["tree"].slice(0, 1), "at": block["block"].slice(0, 1), "size": pa.array([-(-size // shape.block)]), "digest": strings(top)})

    return run


def _block(nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at DIV {shape.block}"))


def rounds(nodes: DataFrame, shape: Shape, label: str) -> list[DataFrame]:
    """The nodes (tree, at, size, digest), their blocks' roots, those of their blocks, until every tree has one node."""
    out = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        up = _block(out[-1].select("tree", "at", "size", "digest"), shape).groupBy("tree", "block").applyInArrow(_reduce(shape), _NODES)
        out.append(written(up, label))
        largest = -(-largest // shape.block)
    return out


def _down(shape: Shape, finish: Callable[..., pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block with the path above its root; finish(block, levels, siblings, existing, places, row above)."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        size = block["size"][0].as_py()
        tree = levels(matrix(block["digest"]), shape.fanout, height(size, shape.fanout, shape.levels))
        return finish(block, tree, *siblings(tree, shape.fanout), above.to_pylist()[0])

    return run


_PATHS = "tree string, at long, root string, top string, places array<int>, others array<string>"


def _paths(block: pa.Table, tree: list[np.ndarray], found: np.ndarray, there: np.ndarray, own: np.ndarray, above: dict) -> pa.Table:
    places = [[*p, *above["places"]] for p in own.tolist()]
    others = [["".join(strings(f[t])) for f, t in zip(x, y, strict=True)] + above["others"] for x, y in zip(found, there, strict=True)]
    n = block.num_rows
    return pa.table(
        {
            "tree": block["tree"],
            "at": block["at"],
            "root": pa.array([above["root"]] * n, pa.string()),
            "top": pa.array([above["top"]] * n, pa.string()),
            "places": pa.array(places, pa.list_(pa.int32())),
            "others": pa.array(others, pa.list_(pa.string())),
        }
    )


_AUDIT = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _audit(shape: Shape) -> Callable[..., pa.Table]:
    def finish(block: pa.Table, tree: list[np.ndarray], found: np.ndarray, there: np.ndarray, own: np.ndarray, above: dict) -> pa.Table:
        rest, n = "".join(above["others"]).encode(), block.num_rows
        found, there = found.reshape(n, -1, HEX), there.reshape(n, -1)
        whole = there.all(1).tolist()
        proofs = [sha256((found[i] if whole[i] else found[i][there[i]]).tobytes() + rest).hexdigest() for i in range(n)]
        shown = matrix(pc.coalesce(block["shown"], block["digest"]))
        given = strings(folded(shown, tree, shape.fanout))
        # Most rows give the same block root, and what it gives further up is the same too.
        upper = {d: fold_path(d, above["places"], above["others"]) for d in set(given)}
        same = lambda v: pa.array([v] * n, pa.string())
        return pa.table({"key": block["key"], "leaf": block["digest"], "subroot": same(above["root"]), "root": same(above["top"]), "proof_sha256": proofs, "folded_root": [upper[d] for d in given]})

    return finish


_PROOFS = "key long, leaf string, subroot string, root string, places array<int>, others array<string>"


def _proofs(block: pa.Table, *rest: object) -> pa.Table:
    t = _paths(block, *rest)
    return pa.table({"key": block["key"], "leaf": block["digest"], "subroot": t["root"], "root": t["top"], "places": t["places"], "others": t["others"]})


def _descend(nodes: list[DataFrame], above: DataFrame, shape: Shape, label: str, finish: Callable[..., pa.Table], schema: str) -> DataFrame:
    """From the trees' roots, whose paths are `above`, to what finish gives for the lowest nodes."""
    for i in range(len(nodes) - 2, -1, -1):
        last = i == 0
        blocks = _block(nodes[i] if last else nodes[i].select("tree", "at", "size", "digest"), shape).groupBy("tree", "block")
        above = blocks.cogroup(above.groupBy("tree", "at")).applyInArrow(_down(shape, finish if last else _paths), schema if last else _PATHS)
        if not last:
            above = written(above, label)
    return above


class Manifest:
    """The trees over the leaves of `rows`: columns key (long), tree (the group's string key, never null), digest, shown.

    shown: the digest that a reader of the data finds, which `audit` checks, null where it is `digest`, of which the manifest is made.
    """

    def __init__(self, rows: DataFrame, fanout: int = 2, block: int = BLOCK):
        self.shape = Shape(fanout, block)
        rows = written(rows, "merkle-leaves")
        self.nodes = rounds(placed(rows, ["key", "digest"], "merkle-placed"), self.shape, "merkle-round")
        if len(self.nodes) == 1:  # no tree has two leaves: one round all the same, so that paths come from above
            self.nodes.append(self.nodes[0].select("tree", "at", "size", "digest"))
        #: A row per group: tree, digest (its subroot), at (its place in the upper tree).
        self.subroots = written(placed(self.nodes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], "merkle-groups"), "merkle-subroots")
        top = rounds(self.subroots, self.shape, "merkle-top")
        if len(top) == 1:
            top.append(top[0].select("tree", "at", "size", "digest"))
        none = F.expr("CAST(array() AS array<int>)"), F.expr("CAST(array() AS array<string>)")
        #: The upper tree's root, in at most one row.
        self.root = top[-1].select("tree", "at", F.col("digest").alias("root"), F.col("digest").alias("top"), none[0].alias("places"), none[1].alias("others"))
        paths = _descend(top, self.root, self.shape, "merkle-paths", _paths, _PATHS).drop("root")
        groups = self.subroots.select("at", "group", F.col("digest").alias("root"))
        self.above = written(paths.join(groups, "at").select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("at"), "root", "top", "places", "others"), "merkle-above")

    def audit(self) -> DataFrame:
        """A row per leaf: key, leaf, subroot, root, proof_sha256 (H of all siblings from the leaf up, left to right), and folded_root,
        which the digest shown gives with the siblings of the manifest."""
        return _descend(self.nodes, self.above, self.shape, "merkle-paths", _audit(self.shape), _AUDIT)

    def proofs(self) -> DataFrame:
        """A row per leaf: key, leaf, subroot, root, places and others (as fold_path takes them)."""
        return _descend(self.nodes, self.above, self.shape, "merkle-paths", _proofs, _PROOFS)


def group_key(c: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c.cast("string")))


def of_documents(docs: DataFrame, fanout: int = 2, block: int = BLOCK, damaged: Column | None = None, found: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs (columns doc_id, source, lang, n_chars, text), a group per lang. Where `damaged` holds, a reader is taken to find
    the columns `found` instead of the fields that they name."""
    digest = leaf([docs[c] for c in FIELDS])
    shown = F.lit(None).cast("string") if damaged is None else F.when(damaged, leaf([(found or {}).get(c, docs[c]) for c in FIELDS]))
    return Manifest(docs.select(docs["doc_id"].cast("long").alias("key"), group_key(docs["lang"]).alias("tree"), digest.alias("digest"), shown.alias("shown")), fanout, block)
