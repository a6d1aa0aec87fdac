"""Hierarchical multi-length packing of tokenised documents.

Every task packs the documents of its own partition, so nothing is shuffled and a lost task is simply run again. Inside a task,
documents pass through a window of bounded size. Those longer than the largest context are cut into full sequences and a rest.
Documents and rests are routed to the smallest context size (tier) that holds them. Tiers are packed from the largest down: a
sequence opens with the longest waiting piece of its tier, its gap takes the longest pieces of the same or a shorter tier that fit,
and where none fits the head of the shortest one fills the gap exactly. What is left in the end becomes sequences whose lengths are
powers of two, so no sequence is padded at all. Sequences of a window are dealt to step groups of equal token budget so that the
groups' attention costs (sum of squared piece lengths) stay level.

Defined cases: a null or empty text has the end token alone; a null id stays null; repeated rows are packed once each; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from candlewick.llm.words import Hasher, Lookup, give_back, lean_arrow, slices, texts

TIERS = (256, 512, 1024, 2048)
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, step_group long"

_TOKENIZERS: dict[str, ChunkTokens] = {}


class ChunkTokens:
    """Ids of texts, through those of their white-space chunks.

    The vocabulary lower-cases, its pre-tokeniser never joins characters across white space, and its normaliser works within a chunk, so
    a text's ids are those of its chunks (A-Z lower-cased), one after the other. Special tokens are spelt in lower case: texts with "<|"
    are encoded as a whole. Chunks are hashed together and looked up in two sorted tables, an old one and that of what was learned since;
    ids lie in one pool. Chunks of letters alone are one pre-token each, so many are encoded as one string and told apart by the tokens
    that end a word. `bound` limits memory only; two of the chunks it holds share a hash with a chance below 1e-7.
    """

    def __init__(self, path: str, bound: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.hasher = Hasher()
        # A mark after letters is a pre-token of its own.
        self.marks = {m: int(x[0]) for m in ".,!?;:" if len(x := self._alone([m])[0]) == 1}
        self._forget()

    def _forget(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.tables, self.pool, self.used = [none, none], np.zeros(1 << 20, np.uint32), 0
        self.find = [Lookup(none[0]), Lookup(none[0])]

    def _alone(self, chunks: list[str], part: int = 1024) -> list[np.ndarray]:
        """Ids of each chunk. The library's own results take far more than the ids, so few are held at once."""
        out: list[np.ndarray] = []
        for i in range(0, len(chunks), part):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(chunks[i : i + part], add_special_tokens=False)]
        return out

    def _words(self, words: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and each one's number of ids; an id in `marks` follows its word (-1: none)."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a letter that becomes several characters
            each = self._alone(words)
            ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
        n, marked = np.diff(stops, prepend=0), marks >= 0
        return np.insert(ids, stops[marked], marks[marked].astype(np.uint32)), n + marked

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Adds chunks by their hashes, which are sorted and new."""
        marks = np.array([self.marks.get(c[-1], -1) for c in chunks])
        stems = [c[:-1] if m >= 0 else c for c, m in zip(chunks, marks.tolist(), strict=True)]
        plain = np.array([c.isalpha() for c in stems], bool)
        size, parts = np.zeros(len(keys), np.int32), []
        at = np.flatnonzero(plain)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            ids, size[part] = self._words([stems[k] for k in part.tolist()], marks[part])
            parts.append(ids)
        rest = np.flatnonzero(~plain)
        each = self._alone([chunks[k] for k in rest.tolist()])
        size[rest] = [len(x) for x in each]
        parts += each
        order = np.concatenate([at, rest])
        start = np.empty(len(keys), np.int64)
        start[order] = self.used + np.cumsum(size[order]) - size[order]
        new = np.concatenate(parts)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        self.used += len(new)
        self._merge(1, (keys, start, size))
        if len(self.tables[1][0]) > 20_000 + len(self.tables[0][0]) // 8:
            self._merge(0, self.tables[1])
            self.tables[1] = tuple(x[:0] for x in self.tables[1])
            self.find[1] = Lookup(self.tables[1][0])

    def _merge(self, i: int, more: tuple[np.ndarray, ...]) -> None:
        every = [np.concatenate(x) for x in zip(self.tables[i], more, strict=True)]
        order = np.argsort(every[0], kind="stable")
        self.tables[i] = tuple(x[order] for x in every)
        self.find[i] = Lookup(self.tables[i][0])

    def _spans(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of ids of each hash, and which are unknown."""
        start, size, lost = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32), np.arange(len(h))
        for find, (_, starts, sizes) in zip(self.find, self.tables, strict=True):
            got = find(h[lost])
            hit = got >= 0
            start[lost[hit]], size[lost[hit]] = starts[got[hit]], sizes[got[hit]]
            lost = lost[~hit]
        return start, size, lost

    def of(self, raws: list[bytes | None]) -> list[bytes]:
        odd = {i: r for i, r in enumerate(raws) if r and b"<|" in r}
        if odd:
            whole = self._alone([r.decode("utf-8", "replace") for r in odd.values()])
            rest = iter(self.of([None if i in odd else r for i, r in enumerate(raws)]))
            special = {i: x.astype("<u4").tobytes() for i, x in zip(odd, whole, strict=True)}
            return [special.get(i, x) for i, x in enumerate(rest)]
        h, n, buf, starts, stops = self.hasher.located(raws)
        start, size, lost = self._spans(h)
        if len(lost):
            keys, first = np.unique(h[lost], return_index=True)
            if len(self.tables[0][0]) + len(self.tables[1][0]) + len(keys) > self.bound:
                self._forget()
                keys, first = np.unique(h, return_index=True)
                lost = np.arange(len(h))
            at = lost[first]
            self._learn(keys, [buf[i:j].lower().decode("utf-8", "replace") for i, j in zip(starts[at].tolist(), stops[at].tolist(), strict=True)])
            start[lost], size[lost], _ = self._spans(h[lost])
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4").tobytes()
        last = np.concatenate([[0], ends])[np.cumsum(n)] * 4
        return [ids[i:j] for i, j in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


def chunk_tokens(path: str | None) -> ChunkTokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokens(path)
    return _TOKENIZERS[path]


class Packer:
    """Pieces are (length, number, document, start); a document is any object."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, group_sequences: int = 16):
        self.tiers, self.top = tuple(sorted(tiers)), max(tiers)
        self.pool: list[tuple[int, int, object, int]] = []
        self.number = 0
        self.group_tokens = group_sequences * self.top
        self.sequences: list[tuple[int, list[tuple[int, object, int]]]] = []

    def _wait(self, length: int, doc: object, start: int) -> None:
        self.number += 1
        insort(self.pool, (length, self.number, doc, start))

    def add(self, doc: object, length: int) -> None:
        start = 0
        while length - start >= self.top:
            self.sequences.append((self.top, [(self.top, doc, start)]))
            start += self.top
        if start < length:
            self._wait(length - start, doc, start)

    def _fill(self, size: int, pieces: list[tuple[int, object, int]]) -> None:
        """Fills what is left of a sequence of that size; the pool must hold enough."""
        gap = size - sum(p[0] for p in pieces)
        while gap:
            i = bisect_right(self.pool, (gap, 1 << 62))
            if i:
                length, _, doc, start = self.pool.pop(i - 1)
                pieces.append((length, doc, start))
                gap -= length
            else:
                length, _, doc, start = self.pool.pop(0)
                pieces.append((gap, doc, start))
                self._wait(length - gap, doc, start + gap)
                gap = 0
        self.sequences.append((size, pieces))

    def pack(self, last: bool) -> None:
        """Packs the tiers as far as they fill sequences; the rest too if it is the last time."""
        waiting = sum(p[0] for p in self.pool)
        for below, size in reversed(list(zip((0, *self.tiers), self.tiers, strict=False))):
            while waiting >= size and (i := bisect_left(self.pool, (size + 1,))) and self.pool[i - 1][0] > below:
                length, _, doc, start = self.pool.pop(i - 1)
                self._fill(size, [(length, doc, start)])
                waiting -= size
        if last:
            while waiting:
                size = min(self.top, 1 << (waiting.bit_length() - 1))
                self._fill(size, [])
                waiting -= size

    def take(self) -> list[tuple[int, int, list[tuple[int, object, int]]]]:
        """The finished sequences as (size, step group, pieces), groups counted from 0."""
        cost = lambda s: -sum(p[0] * p[0] for p in s[1])
        total = sum(size for size, _ in self.sequences)
        groups = [(0, g, 0) for g in range(max(1, -(-total // self.group_tokens)))]
        out, heapq_groups = [], groups
        heapq.heapify(heapq_groups)
        share = -(-total // max(1, len(groups)))
        for size, pieces in sorted(self.sequences, key=cost):
            full = []
            while len(heapq_groups) > 1 and heapq_groups[0][2] + size > share:
                full.append(heapq.heappop(heapq_groups))
            spent, g, tokens = heapq.heappop(heapq_groups)
            heapq.heappush(heapq_groups, (spent - cost((size, pieces)), g, tokens + size))
            for x in full:
                heapq.heappush(heapq_groups, x)
            out.append((size, g, pieces))
        self.sequences = []
        return out


def _rows(batches: Iterable[pa.RecordBatch], path: str | None, window_tokens: int, schema: pa.Schema, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens, packer, end = chunk_tokens(path), Packer(), np.array([END_ID], "<u4").tobytes()
    task = TaskContext.get()
    base, groups, held = (task.partitionId() if task else 0) << 33, 0, 0
    sequence = base

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal sequence, groups
        columns: list[list] = [[] for _ in schema]
        done = packer.take()
        for size, group, pieces in done:
            tier = next(t for t in packer.tiers if t >= size)
            offset = 0
            for length, (doc_id, ids), start in pieces:
                part = ids[4 * start : 4 * (start + length)]
                for c, v in zip(columns, (doc_id, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, size, tier, base + groups + group, part), strict=False):
                    c.append(v)
                offset += length
            sequence += 1
        groups += 1 + max((g for _, g, _ in done), default=-1)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        give_back()

    for b in slices(batches, 128, 1 << 19):
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokens.of(texts(b)), strict=True):
            packer.add((doc_id, ids + end), len(ids) // 4 + 1)
            held += len(ids) // 4 + 1
        if held >= window_tokens:
            packer.pack(False)
            yield from out()
            held = sum(p[0] for p in packer.pool)
    packer.pack(True)
    yield from out()


def pack(docs: DataFrame, tokenizer: str | None = None, window_tokens: int = 1_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document (columns doc_id, text), in the module's order of work.

    tokenizer: path of a vocabulary file that the executors can open; by default word_bpe_49k.json of the installed vocabularies.
    with_ids: adds `ids`, the piece's ids as little-endian 32-bit integers.
    """
    lean_arrow(docs.sparkSession)
    ddl = SCHEMA + (", ids binary" if with_ids else "")
    schema = pa.schema([pa.field(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in ddl.split(", ")])
    run = lambda batches: _rows(batches, tokenizer, window_tokens, schema, with_ids)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, ddl)
