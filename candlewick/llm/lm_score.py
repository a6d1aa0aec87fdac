"""Language-model scores: a smoothed unigram base, and a log-bilinear neural model trained by noise-contrastive estimation.

Words are lower-cased A-Z; every text ends with one end token. Counts are taken over all training texts. The neural model predicts each
token from the two before (the end token before a text's first): r = q(w1) C1 + q(w2) C2. Every token of any corpus has a context vector q
and an output vector of its own. The `VOCABULARY` most frequent ones have rows of their own in both tables; every other one has the sum of
two rows, chosen by its hash, of a table that grows with the number of distinct tokens up to `ROWS`. Its output is in two levels:

* which frequent token, or any other one: softmax of r . v[w] + b[w] over all of them;
* which of the others: the mixture, over `STATES` states k of weights softmax(r A + a), of share(w) exp(o(w)[k]) / Z[k], where share is the
  token's part of the smoothed counts, and Z[k] the sum over all distinct training tokens and the unseen one (whose o is 0).

Both levels are normalised exactly: the first by matrix products over its whole vocabulary, Z by one pass over the table of counts.

It is trained in numpy on all tokens of all training texts, against noise from the unigram distribution (for the second level, other
tokens of the texts). The texts are dealt by a hash of id and text to shards of about `SHARD_TOKENS` and sorted by it there, so what is
learned doesn't depend on how the input is partitioned. Each shard is gone through once by minibatches; the shards' parameters and AdaGrad's
sums are averaged by their tokens, in levels of at most `FAN`; this is done `ROUNDS` times, each from the last one's mean. A shard has about
`SHARD_STEPS` steps whatever the corpus's size, as batches are smaller where it has fewer tokens.

What is broadcast has a fixed bound: the counts of the `HEAD` most frequent tokens, and the parameters. Counts of all other tokens meet
their texts in an equi-join, in which no key is frequent.

Tokens are known by 64-bit hashes of their bytes. Defined cases: null and empty texts consist of the end token; a null doc_id is in the
training fold; without training texts the counts are empty and every token is unseen; repeated rows are repeated (and count as often); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.words import Hasher, Lookup, lean_arrow, mix, slices, texts
from candlewick.session import written

END = mix(np.zeros(1, np.uint64))[0]  # of no bytes
VOCABULARY, HEAD, DIM = 127, 1 << 17, 16
#: Hashed rows for all other tokens at most, and states of their mixture.
ROWS, STATES = 1 << 16, 8
CHUNK_TOKENS = 4_000_000
NOISE, OTHERS, BATCH, STEP = 32, 128, 4096, 0.05
ROUNDS, SHARD_TOKENS, SHARD_STEPS, LEAST_BATCH = 1, 1 << 22, 1024, 256
#: More shards than that would move more parameters than text; beyond, shards grow.
SHARDS, FAN = 1 << 15, 8
#: Where AdaGrad's sums of squares start: below the square of a batch's mean gradient, so that the step size is the gradient's own.
SUMS = 1e-6
#: The same, and the step, for tables whose rows few tokens of a batch touch. Gradients are those of single tokens there (not their mean),
#: so a row's first few tokens move it by about STEP / sqrt(SUMS) each, and one token can't be learned by heart.
ROW_SUMS, ROW_STEP = {0: 10.0, 7: 10.0}, {0: 0.5, 7: 1.0}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with their tokens one after the other, and each text's number of tokens."""
    hasher = Hasher()
    for b in slices(batches, rows, 1 << 20):
        h, n = hasher(texts(b))
        yield b, np.insert(h, np.cumsum(n), END), n + 1


def counts(docs: DataFrame) -> DataFrame:
    """(h, c) of every token of the texts."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], schema=schema)

        for _, tokens, _ in _tokens(batches):
            waiting.append(tokens)
            n += len(tokens)
            if n >= CHUNK_TOKENS:
                yield out()
                waiting, n = [], 0
        if n:
            yield out()

    made = docs.select("text").mapInArrow(run, "h long, c long")
    return written(made.groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Model:
    """head: sorted hashes of the most frequent tokens, their counts, and their class in the first level (0: all others).

    params: q, C1, C2, v, b, A, a, o, z; z is log Z once the model is trained.
    """

    total: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    params: list[np.ndarray]
    trained: bool = False

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))

    @property
    def rest_norm(self) -> float:
        """log10 of the smoothed counts of all tokens that have no class of their own, the unseen one included."""
        mine = self.head_counts[self.classes > 0]
        return float(np.log10(self.total + self.distinct + 1 - (mine.sum() + len(mine))))


#: Which parameters are tables of which a batch touches few rows.
SPARSE = (0, 7)


def start_model(table: DataFrame, seed: int = 0) -> Model:
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    got = table.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    classes = np.where(np.arange(len(h)) < VOCABULARY, np.arange(len(h)) + 1, 0).astype(np.int32)
    smooth = np.zeros(min(VOCABULARY, len(h)) + 1)
    smooth[1:] = c[: len(smooth) - 1] + 1
    smooth[0] = total + distinct + 1 - smooth.sum()
    order = np.argsort(h)
    rng = np.random.default_rng(seed)
    size, rows = len(smooth), min(ROWS, 1 << max(4, distinct.bit_length() - 1))
    draw = lambda spread, *shape: rng.normal(0, spread, shape).astype(np.float32)
    c1, c2 = (np.eye(DIM, dtype=np.float32) * f for f in (0.6, 0.4))
    shares = smooth / smooth.sum()
    params = [np.concatenate([draw(0.05, size + rows, DIM), draw(0, 1, DIM)]), c1, c2, draw(0.05, size, DIM), np.log(shares).astype(np.float32), draw(0.3, DIM, STATES), draw(0, STATES), draw(0.1, rows, STATES), draw(0, STATES)]
    return Model(total, distinct, h[order], c[order], classes[order], shares, params)


def _places(h: np.ndarray, classes: np.ndarray, size: int, rows: int) -> np.ndarray:
    """The two context rows of each token: its class and a row of zeros at the end, or two of the hashed ones."""
    mine = np.uint64(rows - 1)
    near, far = ((h >> np.uint64(k) & mine).astype(np.int32) + np.int32(size) for k in (0, 24))
    mine = classes > 0
    return np.stack([np.where(mine, classes, near), np.where(mine, np.int32(size + rows), far)])


def _before(x: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token, what x (a column a token) holds for the one before, and for the one before that; `end` outside the text."""
    w1, w2 = np.empty_like(x), np.empty_like(x)
    w1[:, :1], w1[:, 1:] = end, x[:, :-1]
    w2[:, :2], w2[:, 2:] = end, x[:, :-2]
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    w1[:, firsts] = end
    w2[:, firsts] = end
    w2[:, (firsts + 1)[sizes > 1]] = end
    return w1, w2


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    return e


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps (a sum for each row of the sparse tables)."""

    def __init__(self, params: list[np.ndarray], sums: list[np.ndarray], shares: np.ndarray, seed: int):
        self.p, self.log_noise = [x.copy() for x in params], np.log(NOISE * shares).astype(np.float32)
        self.s = [x.copy() for x in sums]
        self.cut, self.rng = np.cumsum(shares), np.random.default_rng(seed)

    def _dense(self, i: int, rows: np.ndarray, change: np.ndarray) -> np.ndarray:
        flat = (rows[:, None] * change.shape[1] + np.arange(change.shape[1])).ravel()
        return np.bincount(flat, change.ravel(), self.p[i].size).reshape(self.p[i].shape).astype(np.float32)

    def _sparse(self, i: int, rows: np.ndarray, change: np.ndarray) -> None:
        order = np.argsort(rows)
        new = np.empty(len(rows), bool)
        new[:1], new[1:] = True, rows[order[1:]] != rows[order[:-1]]
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        rows, d = rows[order[new]], change.shape[1]
        total = np.bincount((place[:, None] * d + np.arange(d)).ravel(), change.ravel(), len(rows) * d).reshape(-1, d).astype(np.float32)
        s = self.s[i]
        s[rows] += np.einsum("nd,nd->n", total, total) / np.float32(d)
        self.p[i][rows] -= total * (np.float32(ROW_STEP[i]) / np.sqrt(s[rows]))[:, None]

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
        """w1, w2: context rows; w: class; out: the two output rows of the tokens without a class."""
        q, c1, c2, v, b, a, a0, o, z = self.p
        noise = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), len(self.cut) - 1)
        x1, x2 = q[w1[0]] + q[w1[1]], q[w2[0]] + q[w2[1]]
        r, n = x1 @ c1 + x2 @ c2, np.float32(len(w))
        seen = 1 / (1 + np.exp(self.log_noise[w] - np.einsum("nd,nd->n", r, v[w]) - b[w])) - 1
        drawn = 1 / (1 + np.exp(self.log_noise[noise] - b[noise] - r @ v[noise].T))
        seen /= n
        drawn /= n
        back = seen[:, None] * v[w] + drawn @ v[noise]
        grads = {
            3: self._dense(3, w, seen[:, None] * r) + self._dense(3, noise, drawn.T @ r),
            4: (np.bincount(w, seen, len(b)) + np.bincount(noise, drawn.sum(0), len(b))).astype(np.float32),
        }
        rest = np.flatnonzero(w == 0)
        if len(rest):
            # In groups, whose tokens are noise for each other: p / p_noise of a token is its mixture sum S, as its share cancels.
            groups = -(-len(rest) // OTHERS)
            rest = np.resize(rest, (groups, -(-len(rest) // groups)))  # a few come twice
            k, flat = max(rest.shape[1] - 1, 1), rest.ravel()
            rr, mine = r[flat], out[:, flat]
            weight, e = _softmax(rr @ a + a0), np.exp(o[mine[0]] + o[mine[1]] - z)
            own = np.einsum("nk,nk->n", weight, e)
            back_own = (own / (own + k) - 1) / own
            gw, ge = weight.reshape(*rest.shape, -1), e.reshape(*rest.shape, -1)
            back_other = 1 / (gw @ ge.transpose(0, 2, 1) + k)
            back_other[:, np.arange(k + 1)[: rest.shape[1]], np.arange(k + 1)[: rest.shape[1]]] = 0
            d_weight = back_own[:, None] * e + (back_other @ ge).reshape(e.shape)
            d_e = e * (weight * back_own[:, None] + (back_other.transpose(0, 2, 1) @ gw).reshape(e.shape))
            d_logit = weight * (d_weight - np.einsum("nk,nk->n", weight, d_weight)[:, None]) / n
            grads |= {5: rr.T @ d_logit, 6: d_logit.sum(0), 8: -d_e.sum(0) / n}
            back[flat] += d_logit @ a.T  # of one that comes twice, once
            self._sparse(7, np.concatenate([*mine]), np.concatenate([d_e, d_e]))
        grads |= {1: x1.T @ back, 2: x2.T @ back}
        rows, changes = [], []
        for x, c in ((w1, c1), (w2, c2)):
            change, hashed = n * back @ c.T, x[1] < len(q) - 1
            rows += [x[0], x[1][hashed]]
            changes += [change, change[hashed]]
        self._sparse(0, np.concatenate(rows), np.concatenate(changes))
        for i, g in grads.items():
            self.s[i] += g * g
            self.p[i] -= STEP * g / np.sqrt(self.s[i])


def _learn(m: Model, sums: list[np.ndarray], slices_: Iterator[tuple[np.ndarray, np.ndarray]], batch: int, seed: int) -> tuple[Trainer, int]:
    """One pass over slices (tokens, sizes of texts)."""
    find, trainer, n = Lookup(m.head), Trainer(m.params, sums, m.shares, seed), 0
    size, rows = len(m.shares), len(m.params[7])
    of = lambda h: np.where((at := find(h)) < 0, 0, m.classes[at])
    end = _places(np.array([END]), of(np.array([END])), size, rows)
    for tokens, sizes in slices_:
        w = of(tokens)
        x = _places(tokens, w, size, rows)
        w1, w2 = _before(x, sizes, end)
        x -= size
        order = trainer.rng.permutation(len(w))
        mixed, w = np.concatenate([w1, w2, x]).T[order], w[order]
        for i in range(0, len(w), batch):
            k = np.ascontiguousarray(mixed[i : i + batch].T)
            trainer.step(k[:2], k[2:4], w[i : i + batch], k[4:])
        n += len(w)
    return trainer, n


def _unpacked(blob: bytes, like: list[np.ndarray]) -> np.ndarray:
    """Parameters (half precision) and sums, one after the other."""
    n = sum(p.size for p in like)
    return np.concatenate([np.frombuffer(blob, np.float16, n).astype(np.float32), np.frombuffer(blob, np.float32, offset=2 * n)])


def train(docs: DataFrame, model: Model, table: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model with parameters learned from all tokens of the texts (docs: doc_id, text), and its normalisers (table: counts)."""
    if not model.total:
        return model
    spark = docs.sparkSession
    like, n_params = model.params, sum(p.size for p in model.params)
    sums = [np.full(len(p), ROW_SUMS[i], np.float32) if i in SPARSE else np.full(p.shape, SUMS, np.float32) for i, p in enumerate(like)]
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("params", pa.binary())])
    ddl = "slot long, n long, params binary"
    shards = int(np.clip(model.total // SHARD_TOKENS, 1, SHARDS))
    batch = int(np.clip(model.total // shards // SHARD_STEPS, min(LEAST_BATCH, BATCH), BATCH))
    # Equal (id, text) rows are interchangeable, so their order doesn't matter. Parameters leave a task once, so there may be no more tasks than
    # shards, whatever a session makes of the number of partitions.
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("k")).repartition(shards, "k").coalesce(shards).sortWithinPartitions("k").select("text")
    packed = lambda flat: flat[:n_params].astype(np.float16).tobytes() + flat[n_params:].astype(np.float32).tobytes()

    def mean(group: pa.Table) -> pa.Table:
        n, total = np.array(group.column("n").to_pylist()), 0
        for k, blob in zip(n, group.column("params"), strict=True):
            total = total + _unpacked(blob.as_py(), like) * np.float64(k)
        return pa.table([group.column("slot").slice(0, 1), pa.array([int(n.sum())]), pa.array([packed(total / max(1, n.sum()))], pa.binary())], schema=schema)

    for turn in range(rounds):
        held = spark.sparkContext.broadcast((model, sums))

        def run(batches: Iterator[pa.RecordBatch], held: object = held, turn: int = turn) -> Iterator[pa.RecordBatch]:
            (m, before), number = held.value, TaskContext.get().partitionId()
            trainer, n = _learn(m, before, ((t, k) for _, t, k in _tokens(batches)), batch, 1_000_000 * turn + number)
            blob = packed(np.concatenate([p.ravel() for p in trainer.p + trainer.s]))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([blob], pa.binary())], schema=schema)

        parts, left = dealt.mapInArrow(run, ddl).where("n > 0"), shards
        while left > FAN:
            left = -(-left // FAN)
            parts = parts.withColumn("slot", F.col("slot") % left).groupBy("slot").applyInArrow(mean, ddl)
        done = parts.toArrow()
        flat = _unpacked(mean(done).column("params")[0].as_py(), like)
        cut = np.split(flat, np.cumsum([x.size for x in like + sums])[:-1])
        learned = [x.reshape(y.shape) for x, y in zip(cut, like + sums, strict=True)]
        sums = learned[len(like) :]
        model = replace(model, params=learned[: len(like)])
        held.unpersist()
    model.params[8] = normalisers(table, model)
    return replace(model, trained=True)


def normalisers(table: DataFrame, model: Model) -> np.ndarray:
    """log Z of every state: the sum over all tokens of the counts' table that have no class, and the unseen one."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = held.value, np.zeros(STATES)
        o, size, find = m.params[7], len(m.shares), Lookup(m.head)
        for b in slices(batches, 1 << 16):
            h, c = b.column("h").to_numpy().view(np.uint64), b.column("c").to_numpy()
            at = find(h)
            w = np.where(at < 0, 0, m.classes[at])
            x = _places(h, w, size, len(o))[:, w == 0] - size
            total += (c[w == 0] + 1) @ np.exp((o[x[0]] + o[x[1]]).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(STATES)), pa.array(total)], ["k", "z"])

    got = {r.k: r.z for r in table.select("h", "c").mapInArrow(run, "k long, z double").groupBy("k").agg(F.sum("z").alias("z")).collect()}
    return (np.log([got.get(k, 0.0) + 1 for k in range(STATES)]) - model.rest_norm * np.log(10)).astype(np.float32)


class Scorer:
    """log10 probabilities of tokens: whether they are among the head's, the head's counts, the first level, and the mixture."""

    def __init__(self, model: Model):
        self.m, self.find = model, Lookup(model.head)
        self.logs = np.append(np.log10(model.head_counts + 1.0), 0)
        self.classes = np.append(model.classes, 0)
        self.size, self.rows = len(model.shares), len(model.params[7])
        end = np.array([END])
        self.end = _places(end, self.classes[self.find(end)], self.size, self.rows)

    def __call__(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """inside, class, log10 (c + 1), first level, mixture factor as a seen token, and as an unseen one."""
        q, c1, c2, v, b, a, a0, o, z = self.m.params
        at = self.find(tokens)
        w = self.classes[at]
        x = _places(tokens, w, self.size, self.rows)
        w1, w2 = _before(x, sizes, self.end)
        first, seen, unseen = (np.zeros(len(tokens)) for _ in range(3))
        reach = np.sqrt((v * v).sum(1).max())
        for i in range(0, len(tokens) if self.m.trained else 0, 1024):
            k = slice(i, i + 1024)
            r = (q[w1[0, k]] + q[w1[1, k]]) @ c1 + (q[w2[0, k]] + q[w2[1, k]]) @ c2
            s = r @ v.T
            s += b
            mine = s[np.arange(len(r)), w[k]]
            top = np.float32(0)
            if np.sqrt((r * r).sum(1).max()) * reach + np.abs(b).max() > 60:  # else no sum leaves the range of floats
                top = s.max(1)
                s -= top[:, None]
            np.exp(s, out=s)
            first[k] = mine - top - np.log(s.sum(1))
            rest = np.flatnonzero(w[k] == 0)
            weight = _softmax(r[rest] @ a + a0)
            y = x[:, i + rest] - self.size
            seen[i + rest] = np.log(np.einsum("nk,nk->n", weight, np.exp(o[y[0]] + o[y[1]] - z)))
            unseen[i + rest] = np.log(weight @ np.exp(-z))
        tens = np.log(10)
        return at >= 0, w, self.logs[at], first / tens, seen / tens, unseen / tens


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: what the head's counts and the neural model give, and the tokens outside the head with their numbers.

    Tokens outside the head are scored as unseen; `more` is what each one adds if it turns out to be seen.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("neural", pa.float64()), ("others", pa.int64()), ("inner", pa.float64()), ("h", longs), ("tf", longs), ("more", doubles)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, row = Scorer(held.value), TaskContext.get().partitionId() << 40
        for batch, tokens, sizes in _tokens(batches):
            inside, w, base, first, seen, unseen = scorer(tokens, sizes)
            stops = np.cumsum(sizes)
            total = lambda x, starts=stops - sizes: np.add.reduceat(x, starts)
            outside = np.flatnonzero(~inside)
            bounds = np.searchsorted(outside, stops)
            hs, tfs, mores = [], [], []
            for i, j in zip([0, *bounds], bounds, strict=False):
                h, place, tf = np.unique(tokens[outside[i:j]], return_inverse=True, return_counts=True)
                hs.append(h.view(np.int64))
                tfs.append(tf)
                mores.append(np.bincount(place, (seen - unseen)[outside[i:j]], len(h)))
            neural = first + np.where(inside, seen, unseen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(sizes))), batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(total(inside.astype(np.int64))), pa.array(total(base)), pa.array(total(neural)),
                 pa.array(total((w == 0).astype(np.int64))), pa.array(total(np.where(w == 0, base, 0.0))), pa.array(hs, longs), pa.array(tfs, longs), pa.array(mores, doubles)], schema=schema,
            )
            row += len(sizes)

    ddl = "row long, doc_id long, n long, known long, base double, neural double, others long, inner double, h array<long>, tf array<long>, more array<double>"
    return written(docs.select("doc_id", "text").mapInArrow(run, ddl), "lm-scored")


def report(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: fold, tokens, known tokens, the base's and the model's log10 probability of the text."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    lean_arrow(docs.sparkSession)
    learn = docs.where(~held_out(F.col("doc_id")))
    table = counts(learn)
    model = train(learn, start_model(table), table, rounds)
    rows = _scored(docs, model)
    tail = rows.select("row", F.inline(F.arrays_zip("h", "tf", "more"))).join(table, "h")
    tail = tail.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail"), F.sum("tf").alias("tail_known"), F.sum("more").alias("more"))
    df = rows.drop("h", "tf", "more").join(written(tail, "lm-tail"), "row", "left").withColumn("tail", F.coalesce("tail", F.lit(0.0)))
    base = F.col("base") + F.col("tail") - F.col("n") * F.lit(model.base_norm)
    neural = F.col("neural") + F.coalesce("more", F.lit(0.0)) + F.col("inner") + F.col("tail") - F.col("others") * F.lit(model.rest_norm)
    return df.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (neural if model.trained else base).alias("score"),
    )
