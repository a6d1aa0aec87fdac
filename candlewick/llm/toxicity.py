"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows: of the word itself and of its first 3 to 6 letters, so that words unseen in training still
share what their beginnings taught. Filters one, two and three words wide run over the whole text; the maximum over all positions of
each filter feeds a logistic output. The first embedding number starts as the rows' shrunken log-odds of a toxic document, the rest is
learned by stochastic gradients, which reach the text through the positions that hold the maxima. The log-odds, the gradients and the
calibration each have a part of the labelled rows of their own. Scores are calibrated monotonously to the labelled rate, and for each language the threshold with the best F1 on all labelled rows outside the held-out fold is kept, whatever their number
and length: their scores are counted by language, label and step of the grid (thresholds judge scores, they don't enter them).

Bound: at most `sample` labelled documents per class, the first by a hash of doc_id, and of these the ones of at most `sample_bytes` bytes
of UTF-8, are learned from. Every document is scored, over its whole text.

Defined cases: null and empty texts have no words and get the score of such a text; a null doc_id is in no fold (held_out false); labels
that are null are ignored, of several for one document the highest counts; without labels of both kinds every score is the labelled rate
(0 without labels); repeated rows get equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.words import lean_arrow, slices, texts

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 19, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
EDGE = " \t\n.,;:!?\"'()[]{}|*#$%&<>-_/"
PADS = max(WIDTHS) - 1
THRESHOLD = 0.3
LEAST_CALIBRATION = 40
GRID = np.linspace(0.1, 0.5, 41)
BROADCAST_ROWS = 2_000_000


@dataclass
class Model:
    """rows: bucket numbers with an embedding other than zero (sorted); emb: theirs. With rate alone, every score is that."""

    rate: float
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    emb: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    thresholds: dict[str, float] = field(default_factory=dict)


class Words(dict):
    """White-space chunk -> number; the buckets of each number are in `table`. `bound` limits memory only."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound
        self.table = np.zeros((1024, 1 + len(PREFIXES)), np.int32)

    def __missing__(self, chunk: bytes) -> int:
        word = chunk.decode("utf-8", "replace").lower().strip(EDGE)
        n = len(self)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        keys = [word, *(word[:k] + "~" if len(word) >= k else "" for k in PREFIXES)]
        self.table[n] = [xxhash.xxh3_64_intdigest(k.encode()) % (BUCKETS - 1) + 1 if k else 0 for k in keys]
        self[chunk] = n
        return n

    def of(self, raws: list[bytes | None]) -> list[np.ndarray]:
        if len(self) > self.bound:
            self.clear()
        get = self.__getitem__
        return [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in ((r.split() if r else []) for r in raws)]


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents with -1 in between, where each begins, and which positions may start a window."""
    sizes = np.array([max(len(d), 1) for d in docs]) + PADS
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat, ok = np.full(sizes.sum(), -1, np.int32), np.zeros(sizes.sum(), bool)
    for s, d in zip(starts, docs, strict=True):
        flat[s : s + len(d)] = d
        ok[s : s + max(len(d), 1)] = True
    return flat, starts, ok


def _convolve(x: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
    padded = np.concatenate([x, np.zeros((PADS, x.shape[1]), np.float32)])
    for i, (k, w) in enumerate(zip(WIDTHS, filters, strict=True)):
        part = padded[: len(x)] @ w[0]
        for j in range(1, k):
            part += padded[j : j + len(x)] @ w[j]
        out[:, i * FILTERS : (i + 1) * FILTERS] = part
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.known = np.zeros((0, DIM), np.float32)
        self.rows, self.emb = np.append(model.rows, BUCKETS), np.concatenate([model.emb, np.zeros((1, DIM), np.float32)])

    def embedded(self, buckets: np.ndarray) -> np.ndarray:
        """Sums of the buckets' rows, which are zero where the model has none."""
        at = np.searchsorted(self.rows, buckets)
        return self.emb[np.where(self.rows[at] == buckets, at, len(self.rows) - 1)].sum(1)

    def logits(self, raws: list[bytes | None]) -> np.ndarray:
        m = self.model
        if m.out is None:
            return np.zeros(len(raws))
        docs = self.words.of(raws)
        n = len(self.words)
        if n < len(self.known):
            self.known = self.known[:0]
        if n > len(self.known):
            new = self.embedded(self.words.table[len(self.known) : n])
            self.known = np.concatenate([self.known, new])
        flat, starts, ok = _laid_out(docs)
        x = self.known[flat] if n else np.zeros((len(flat), DIM), np.float32)
        x[flat < 0] = 0
        h = _convolve(x, m.filters)
        h[~ok] = -np.inf
        return np.maximum(np.maximum.reduceat(h, starts) + m.bias, 0) @ m.out

    def scores(self, raws: list[bytes | None]) -> np.ndarray:
        if self.model.out is None:
            return np.full(len(raws), self.model.rate)
        return calibrated(self.logits(raws).astype(float), self.model.knots)


def _log_odds(buckets: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Of each bucket: log-odds of toxic given that a document has it, less 1.5 standard errors; 0 at least."""
    count = np.zeros((2, BUCKETS))
    for b, y in zip(buckets, toxic, strict=True):
        count[int(y), b] += 1
    n = np.array([(~toxic).sum(), toxic.sum()], float)
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    out = np.maximum(odds - 1.5 * np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5)), 0)
    out[count[1] == 0] = 0
    out[0] = 0
    return out


def train(raws: list[bytes], toxic: np.ndarray, rate: float, steps: int = 32_000, batch: int = 64, step: float = 0.05, seed: int = 0) -> Model:
    """Of each class 40 % of the rows give the log-odds, 40 % the gradients (about `steps` documents are gone through), 20 % the calibration.

    Where a part would have too few rows of a class, the gradients and the calibration share theirs, or use all rows.
    """
    if not toxic.any() or toxic.all():
        return Model(rate)
    rng = np.random.default_rng(seed)
    words = Words(1 << 60)
    docs = words.of(raws)
    part = np.empty(len(docs), np.int8)  # 0: log-odds, 1: gradients, 2: calibration
    for y in (False, True):
        at = rng.permutation(np.flatnonzero(toxic == y))
        part[at] = np.searchsorted([0.4, 0.8], (np.arange(len(at)) + 0.5) / len(at))
    few = lambda p, least: min((toxic & (part == p)).sum(), (~toxic & (part == p)).sum()) < least
    if few(2, LEAST_CALIBRATION):
        part[part == 2] = 1
    first, rest = part == 0, np.flatnonzero(part == 1) if not few(1, 1) else np.arange(len(docs))
    judged = np.flatnonzero(part == 2) if (part == 2).any() else rest
    emb = np.zeros((BUCKETS, DIM), np.float32)
    emb[:, 0] = _log_odds([np.unique(words.table[docs[i]]) if len(docs[i]) else np.zeros(0, np.int32) for i in np.flatnonzero(first)], toxic[first])
    filters = [rng.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    filters[0][0, :, 0] = np.eye(DIM)[0]
    bias, out, offset = np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32), -2.0
    out[0] = 1.0
    sums = [np.full(p.shape, 1e-2, np.float32) for p in (*filters, bias, out, emb)]

    def update(p: np.ndarray, s: np.ndarray, g: np.ndarray, where: object = ...) -> None:
        s[where] += g * g
        p[where] -= step * g / np.sqrt(s[where])

    for _ in range(int(np.clip(steps / len(rest), 6, 24))):
        order = rng.permutation(rest)
        for at in range(0, len(order), batch):
            k = order[at : at + batch]
            flat, starts, ok = _laid_out([docs[i] for i in k])
            rows = words.table[np.maximum(flat, 0)]
            x = emb[rows].sum(1)
            x[flat < 0] = 0
            h = _convolve(x, filters)
            h[~ok] = -np.inf
            stops = [*starts[1:], len(flat)]
            top = np.stack([s + h[s:e].argmax(0) for s, e in zip(starts, stops, strict=True)])
            pooled = np.take_along_axis(h, top, 0) + bias
            act = np.maximum(pooled, 0)
            gone = 1 / (1 + np.exp(-(act @ out + offset))) - toxic[k]
            g = (gone / len(k)).astype(np.float32)
            back = g[:, None] * out * (pooled > 0)
            padded = np.concatenate([flat, np.full(PADS, -1, flat.dtype)])
            xp = np.concatenate([x, np.zeros((PADS, DIM), np.float32)])
            touched, changes = [], []
            for i, width in enumerate(WIDTHS):
                t, b = top[:, i * FILTERS : (i + 1) * FILTERS], back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(filters[i])
                for j in range(width):
                    grad[j] = np.einsum("nfd,nf->df", xp[t + j], b)
                    used = (padded[t + j] >= 0) & (b != 0)
                    touched.append(words.table[padded[t + j][used]])
                    changes.append((b[..., None] * filters[i][j].T[None])[used])
                update(filters[i], sums[i], grad)
            update(out, sums[-2], act.T @ g)
            update(bias, sums[-3], back.sum(0))
            offset -= step * 4 * float(g.sum())
            buckets, change = np.concatenate(touched), np.repeat(np.concatenate(changes), 1 + len(PREFIXES), 0)
            ids, inverse = np.unique(buckets.ravel(), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse.ravel(), change)
            total[ids == 0] = 0
            update(emb, sums[-1], total, ids)
    rows = np.flatnonzero(np.any(emb != 0, 1))
    model = Model(rate, rows, emb[rows], filters, bias, out)
    scorer = Scorer(model)
    logits = np.concatenate([scorer.logits([raws[i] for i in judged[j : j + 256]]) for j in range(0, len(judged), 256)]).astype(float)
    model.knots = _monotone(logits, toxic[judged], rate)
    return model


def _monotone(logits: np.ndarray, toxic: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Calibration by pooled adjacent violators: (logit, toxic share) knots, each class weighted to the labelled rate."""
    weight = np.where(toxic, rate / toxic.sum(), (1 - rate) / (~toxic).sum()) * len(toxic)
    blocks: list[list[float]] = []
    for i in np.argsort(logits, kind="stable"):
        blocks.append([logits[i] * weight[i], weight[i] * toxic[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[2] for b in blocks])
    share = np.array([(b[1] + rate) / (b[2] + 1) for b in blocks])
    return at, np.maximum.accumulate(share)


def calibrated(logits: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Between the knots in line; a hundredth of the logistic value tells apart what lies on one level."""
    return 0.99 * np.interp(logits, *knots) + 0.01 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _threshold(toxic: np.ndarray, clean: np.ndarray, least: int = 20) -> float | None:
    """The threshold of the grid with the best F1 (the middle one of equals), from counts of rows that reach so many of its steps; None with too few toxic ones."""
    if toxic.sum() < least:
        return None
    caught, alarms = (np.cumsum(n[::-1])[::-1][1:] for n in (toxic, clean))
    f1 = 2 * caught / np.maximum(1, toxic.sum() + caught + alarms)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(GRID[best[len(best) // 2]])


def _thresholds(docs: DataFrame, model: Model) -> dict[str, float]:
    """By language, from the scores of all rows of docs (text, lang, toxic)."""
    lean_arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("lang", pa.string()), ("toxic", pa.bool_()), ("step", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches, 96, 1 << 19):
            steps = np.searchsorted(GRID, scorer.scores(texts(b)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.string()), b.column("toxic"), pa.array(steps)], schema=schema)

    counts: dict[str, np.ndarray] = {}
    for r in docs.mapInArrow(run, "lang string, toxic boolean, step int").groupBy("lang", "toxic", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.lang, np.zeros((2, len(GRID) + 1), np.int64))[int(r.toxic), r.step] = r.n
    return {"": THRESHOLD} | {la: t for la, n in counts.items() if (t := _threshold(n[1], n[0])) is not None}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 20_000) -> Model:
    """A model from the labelled rows (labels: doc_id, toxic) outside the held-out fold."""
    mine = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = {r.toxic: r.n for r in mine.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = known.get(True, 0) / max(1, sum(known.values()))
    if len(known) < 2:
        return Model(rate)
    h = F.xxhash64("doc_id")
    wanted = mine.where("toxic = 1").orderBy(h, "doc_id").limit(sample).union(mine.where("toxic <> 1").orderBy(h, "doc_id").limit(sample))
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")).where(F.octet_length("raw") <= sample_bytes)
    rows = sorted((r.doc_id, bytes(r.raw), r.toxic == 1) for r in text.join(F.broadcast(wanted), "doc_id").collect())
    model = train([r[1] for r in rows], np.array([r[2] for r in rows], bool), rate) if rows else Model(rate)
    if model.out is not None:
        judged = mine.select("doc_id", (F.col("toxic") == 1).alias("toxic"))
        judged = F.broadcast(judged) if sum(known.values()) <= BROADCAST_ROWS else judged
        every = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(judged, "doc_id")
        model.thresholds = _thresholds(every.select("text", "lang", "toxic"), model)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang and score of every row, each over its whole text."""
    lean_arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches, 96, 1 << 19):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()), pa.array(scorer.scores(texts(b)))], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang string, score double")


def report(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per document: fold, score, verdict at 0.3, and whether the score reaches its language's threshold."""
    model = learn(docs, labels, **bounds)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= threshold(model)).alias("rejected"))


def threshold(model: Model, lang: str = "lang") -> Column:
    out = F.lit(model.thresholds.get("", THRESHOLD))
    for la, t in sorted(model.thresholds.items()):
        if la:
            out = F.when(F.col(lang) == la, t).otherwise(out)
    return out


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """docs without those that reach their language's threshold; all columns stay. Rows are scored in place, nothing is joined."""
    model = learn(docs, labels, **bounds)
    lean_arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    default = model.thresholds.get("", THRESHOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches, 96, 1 << 19):
            limits = np.array([held.value.thresholds.get(la or "", default) for la in b.column("lang").to_pylist()])
            yield b.filter(pa.array(scorer.scores(texts(b)) < limits))

    return docs.mapInArrow(run, docs.schema)
