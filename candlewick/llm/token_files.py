"""Token ids as Parquet files: one list column of ids, and narrow columns that are read without it.

Layout of a folder that `write` makes:

* `files/`: Parquet with the columns part, doc_id, begin, n_tokens, ids. Files are in ascending order of doc_id, so are the rows of a
  file; `part` numbers the files, `begin` counts the ids of the rows before it in its part. Row groups and pages are kept small enough
  that their bounds (footer and page index) let a reader skip to some documents or some ids; `ids` is coded by a dictionary, or as
  differences of neighbours ("delta").
* `parts/`: a row for each part with the ids and rows before it. It is worked out from the narrow columns of what was written, so ids
  are encoded, shuffled and written once only.

Spark's own Parquet writer commits the files, so lost tasks and executors leave no half files, on any store.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that share a doc_id come one after the other, in
order of their texts' hashes, and may lie in several parts; repeated rows are written once each; an empty table gives an empty folder
that can be read; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.words import lean_arrow, mix, slices

END_ID = 2
SCHEMA = "part int, doc_id long, begin long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

#: Letters that are ASCII or Latin, as contents of a character class; a word with at most one space before it.
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af"
_WORD = re.compile(f" ?[{_LETTER}]+")

#: Kinds of bytes, as bits: ASCII that is no white space, ASCII letters, ASCII white space, ASCII that is no letter, bytes that go on a character,
#: first bytes of characters of two bytes without white space, of Latin letters among them (but for two signs), of three without white space.
_SOLID, _PLAIN, _SPACE, _OTHER, _LATER, _TWO, _LATIN, _THREE = (1 << i for i in range(8))
_KINDS = bytes(
    _SOLID * (33 <= b < 127) | _PLAIN * (b < 128 and chr(b).isalpha()) | _SPACE * (b == 32 or 9 <= b <= 13) | _OTHER * (9 <= b < 127 and not chr(b).isalpha())
    | _LATER * (b >> 6 == 2) | _TWO * (0xC3 <= b <= 0xDF) | _LATIN * (0xC3 <= b <= 0xC9) | _THREE * (0xE4 <= b <= 0xEF)
    for b in range(256)
)
_POWERS = np.cumprod(np.full(65, 0xB5297A4D3F84D5B5, np.uint64))


def _cuts(raw: bytes) -> np.ndarray:
    """Of each byte, whether a chunk is known to begin there: see Encoder."""
    out, buf, kind = np.zeros(len(raw), bool), np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KINDS), np.uint8)
    if len(raw) < 2:
        return out
    later = kind[1:] & _LATER != 0
    solid = kind & _SOLID != 0  # ends a character that is no white space
    solid[1:] |= later & (kind[:-1] & _TWO != 0)
    solid[2:] |= later[1:] & later[:-1] & (kind[:-2] & _THREE != 0)
    letter = kind & _PLAIN != 0  # ends a letter
    begins = letter.copy()
    letter[1:] |= later & (kind[:-1] & _LATIN != 0) & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
    space = kind & _SPACE != 0
    out[1:] = space[1:] & solid[:-1] | (kind[1:] & _OTHER != 0) & letter[:-1]
    # A single white space that is no blank, before a letter: a token of its own.
    begins[:-1] |= letter[1:] & later
    out[2:] |= begins[2:] & space[1:-1] & (buf[1:-1] != 32) & solid[:-2]
    return out


class Chunks:
    """Chunks of at most 64 bytes with their ids, found by a hash and then compared byte by byte; all of a slice at once."""

    def __init__(self) -> None:
        self.n, self.keys, self.places = 0, np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)
        self.at, self.id_at = np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int64)  # where each one's bytes and ids end, from the second place on
        self.raw, self.ids = np.zeros(1 << 14, np.uint8), np.zeros(1 << 12, "<u4")

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[bytes]:
        return (self.raw[i:j].tobytes() for i, j in zip(self.at[: self.n], self.at[1 : self.n + 1], strict=True))

    def append(self, chunks: list[bytes], ids: list[bytes]) -> None:
        """Adds at the end what find() doesn't find."""
        for name, ends, parts, kind in (("raw", "at", chunks, np.uint8), ("ids", "id_at", ids, "<u4")):
            new = np.frombuffer(b"".join(parts), kind)
            bounds = getattr(self, ends)
            first = int(bounds[self.n])
            if self.n + len(parts) >= len(bounds):
                bounds = np.concatenate([bounds, np.zeros(len(bounds) + len(parts), np.int64)])
                setattr(self, ends, bounds)
            values = getattr(self, name)
            if first + len(new) > len(values):
                values = np.concatenate([values, np.zeros(len(values) + len(new), kind)])
                setattr(self, name, values)
            values[first : first + len(new)] = new
            bounds[self.n + 1 : self.n + 1 + len(parts)] = first + np.cumsum([len(x) for x in parts]) // np.dtype(kind).itemsize
        self.n += len(chunks)

    def add(self, keys: np.ndarray, chunks: list[bytes], ids: list[bytes]) -> None:
        """Adds chunks of distinct hashes that aren't there yet."""
        places = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.append(chunks, ids)
        if 2 * self.n > len(self.keys):
            held = self.keys != 0
            keys, places = np.concatenate([self.keys[held], keys]), np.concatenate([self.places[held], places])
            size = 1 << (4 * self.n).bit_length()
            self.keys, self.places = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        slot = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.places[slot[free]] = keys[free], places[free]  # of several that want a slot one gets it
            left = self.keys[slot] != keys
            # Places are written in the same order as hashes, so the last one's stand in both.
            keys, places, slot = keys[left], places[left], (slot[left] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places by hash, -1 where there is none."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def same(self, places: np.ndarray, buf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the chunks at these places (-1: none) are those that follow each other in buf."""
        first = np.cumsum(sizes) - sizes
        fits = (places >= 0) & (self.at[places + 1] - self.at[places] == sizes)
        step = np.arange(len(buf))
        step += np.repeat(np.where(fits, self.at[places], 0) - first, sizes)
        np.minimum(step, len(self.raw) - 1, out=step)
        return fits & ~np.logical_or.reduceat(self.raw[step] != buf, first)


_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts through those of their chunks, which are remembered.

    A byte-level vocabulary of the usual pre-tokeniser always cuts between other characters and the white space after them, between a letter
    and the ASCII that follows unless that is a letter too, and around a single white space that is no blank before a letter. What lies
    between such cuts is encoded apart, so a text's ids are those of its chunks, one after the other. Cuts are found in the bytes, for
    characters whose bytes tell their kind; where they don't, chunks are longer. All chunks of a slice are looked up by array operations.
    Where the file describes any other kind of vocabulary, and for texts with a special token in them, whole texts are encoded.

    `bound` limits memory alone: so many chunks of at most 64 bytes are remembered, in two generations. When the younger one has
    half of them, it takes the place of the older one; chunks that occur again come back from there.
    """

    def __init__(self, path: str, bound: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound, self.young, self.old = Tokenizer.from_file(path), bound, Chunks(), Chunks()
        kind = json.loads(self.tokenizer.to_str())
        cut = kind.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in kind["added_tokens"]]
        self.chunked = kind["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.chunked &= kind["model"]["type"] == "BPE" and not kind["model"].get("dropout") and kind["truncation"] is None and kind["padding"] is None
        vocabulary = [str(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())]
        self.spaced, self.line = np.array([t.startswith("Ġ") for t in vocabulary]), np.array([t == "Ċ" for t in vocabulary])

    def _alone(self, strings: list[str], part: int = 512) -> Iterator[bytes]:
        for i in range(0, len(strings), part):
            for e in self.tokenizer.encode_batch_fast(strings[i : i + part], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Words are encoded together: an id whose token begins with a space begins a word that has one before it, and
        the id of a line's end separates the others."""
        words: tuple[list[str], list[str]] = [], []
        rest, found = [], {}
        for c in chunks:
            (words[c[0] == " "] if _WORD.fullmatch(c) else rest).append(c)
        for before, every in zip(("\n", ""), words, strict=True):
            for i in range(0, len(every), 1024):
                some = every[i : i + 1024]
                (raw,) = self._alone([before + before.join(some)])
                at = (np.flatnonzero((self.line if before else self.spaced)[np.frombuffer(raw, "<u4")]) * 4).tolist()
                if len(at) == len(some):
                    skip = 4 * len(before)
                    found.update({c: raw[x + skip : y] for c, x, y in zip(some, at, [*at[1:], len(raw)], strict=True)})
                else:  # the vocabulary cuts words or lines in some other way
                    rest += some
        found.update(zip(rest, self._alone(rest), strict=True))
        return found

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        cut = [self.chunked and not (t and any(s in t for s in self.special)) for t in texts]
        chunked = iter(self._chunked([(t or "").encode() for t, c in zip(texts, cut, strict=True) if c]))
        whole = self._alone([t for t, c in zip(texts, cut, strict=True) if not c and t is not None])
        return [next(chunked) if c else b"" if t is None else next(whole) for t, c in zip(texts, cut, strict=True)]

    def _chunked(self, raws: list[bytes], most: int = 1 << 20) -> list[bytes]:
        joined = b"".join(raws)
        buf, begins, ends = np.frombuffer(joined, np.uint8), _cuts(joined), np.cumsum([len(r) for r in raws])
        begins[[e - len(r) for e, r in zip(ends.tolist(), raws, strict=True) if r]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(buf))
        ids, n, i = [], [np.zeros(0, np.int64)], 0
        while i < len(starts):  # about so many bytes at once
            j = max(i + 1, int(np.searchsorted(stops, starts[i] + most, "right")))
            part = self._looked_up(buf[starts[i] : stops[j - 1]], stops[i:j] - starts[i:j])
            ids.append(part[0])
            n.append(part[1])
            i = j
        upto = np.concatenate([[0], np.cumsum(np.concatenate(n))]) * 4
        flat, edges = b"".join(ids), upto[np.searchsorted(starts, np.concatenate([[0], ends]))].tolist()
        return [flat[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    def _looked_up(self, buf: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of chunks that follow each other in buf, and each one's number of ids."""
        young, starts = self.young, np.cumsum(sizes) - sizes
        place = np.arange(len(buf), dtype=np.int32)
        place -= np.repeat(starts.astype(np.int32), sizes)
        value = _POWERS[np.minimum(place, 64, out=place)]
        value *= buf.astype(np.uint64) + np.uint64(1)
        keys = mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64)) | np.uint64(1)
        keys[sizes > 64] = 0
        data = buf.tobytes()
        cut = lambda some: [data[i:j] for i, j in zip(starts[some].tolist(), (starts[some] + sizes[some]).tolist(), strict=True)]

        places = young.find(keys)
        places[~young.same(places, buf, sizes)] = -1
        left = np.flatnonzero((places < 0) & (keys != 0))
        if len(left):
            distinct, one, like = np.unique(keys[left], return_index=True, return_inverse=True)
            one = left[one]  # of chunks with one hash the first one is remembered
            same = sizes[left] == sizes[one[like]]
            left, like = left[same], like[same]
            n = sizes[left]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            same = ~np.logical_or.reduceat(buf[step + np.repeat(starts[left], n)] != buf[step + np.repeat(starts[one[like]], n)], np.cumsum(n) - n)
            new = young.find(distinct) < 0  # a hash that another chunk has isn't remembered
            raw, old = cut(one[new]), self.old
            at = old.find(distinct[new])
            ids: list[bytes | None] = [None] * len(raw)
            back = np.flatnonzero(at >= 0)
            k = at[back]
            for i, x, y, u, v in zip(back.tolist(), old.at[k].tolist(), old.at[k + 1].tolist(), old.id_at[k].tolist(), old.id_at[k + 1].tolist(), strict=True):
                if old.raw[x:y].tobytes() == raw[i]:
                    ids[i] = old.ids[u:v].tobytes()
            text = [r.decode() for r, x in zip(raw, ids, strict=True) if x is None]
            learned, text = self._learn(text), iter(text)
            first = young.n
            young.add(distinct[new], raw, [learned[next(text)] if x is None else x for x in ids])
            at = np.where(new, first + np.cumsum(new) - 1, -1)[like]
            places[left[same]] = at[same]
        end = young.n
        left = np.flatnonzero(places < 0)
        if len(left):  # long ones, for this slice alone
            text = [r.decode() for r in cut(left)]
            place = {t: end + i for i, t in enumerate(dict.fromkeys(text))}
            learned = self._learn(list(place))
            young.append([b""] * len(place), [learned[t] for t in place])
            places[left] = [place[t] for t in text]
        count = young.id_at[places + 1] - young.id_at[places]
        before = np.cumsum(count) - count
        out = young.ids[np.arange(int(count.sum())) + np.repeat(young.id_at[places] - before, count)].tobytes()
        young.n = end
        if end > self.bound // 2:
            self.young, self.old = Chunks(), young
        return out, count


def encoder(path: str | None) -> Encoder:
    """The vocabulary's encoder, held by the process; by default that of byte_bpe_50k.json of the installed vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    task = TaskContext.get()
    part, begin = task.partitionId() if task else 0, 0
    for b in slices(batches, 128, 1 << 20):
        raw = [x + end for x in encode.of(b.column("text").to_pylist())]
        n = np.array([len(x) // 4 for x in raw], np.int64)
        stops = np.cumsum(n)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
        columns = [pa.array(np.full(len(n), part, np.int32)), b.column("doc_id").cast(pa.int64()), pa.array(begin + stops - n), pa.array(n), ids]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        begin += int(stops[-1])


def write(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000
) -> None:
    """Writes the ids of docs (columns doc_id, text) to a new folder.

    tokenizer: path of a vocabulary file that the executors can open. encoding: "dictionary" or "delta". row_group_bytes, page_bytes and
    page_rows bound what a reader must take in to get at one document. A dictionary holds a whole vocabulary of up to 262,144 ids (1 MB).

    Rows go to parts by ranges of (doc_id, hash of the text, row), so neither one doc_id nor one text can fill a part alone.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r} is neither dictionary nor delta")
    lean_arrow(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    keys = ["doc_id", "_hash", "_row"]
    dealt = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    dealt.mapInArrow(lambda batches: _encoded(batches, tokenizer, end_id), SCHEMA).write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/files")
    spark = docs.sparkSession
    parts = spark.read.schema(SCHEMA).parquet(f"{path}/files").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"))
    # A row per file, so one task can put them in order.
    before = "coalesce(sum({}) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    parts.select("*", F.expr(before.format("n_tokens")).alias("first"), F.expr(before.format("n_docs")).alias("docs_before")).coalesce(1).write.parquet(f"{path}/parts")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, n_docs long, n_tokens long, least long, largest long, first long, docs_before long").parquet(f"{path}/parts")


def _placed(rows: DataFrame, path: str) -> DataFrame:
    first = _parts(rows.sparkSession, path).select("part", "first")
    return rows.join(first, "part").withColumn("start", F.col("first") + F.col("begin")).drop("part", "first", "begin")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start of every document; the ids aren't read."""
    return _placed(spark.read.schema(SCHEMA).parquet(f"{path}/files").select("part", "doc_id", "begin", "n_tokens"), path)


def documents(spark: SparkSession, path: str, least: int | None = None, largest: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and start of the documents from `least` to `largest` (all where None). Files, row groups and pages whose
    bounds exclude them aren't read."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/files")
    for bound, compare in ((least, "doc_id >= {}"), (largest, "doc_id <= {}")):
        if bound is not None:
            rows = rows.where(compare.format(int(bound)))
    return _placed(rows, path)


def window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids at the places from start (included) to stop (excluded) of the whole stream: doc_id, start and ids of each document's share,
    in no order. Only parts that hold such places are looked into."""
    hit = [(r.part, r.first) for r in _parts(spark, path).where((F.col("first") < stop) & (F.col("first") + F.col("n_tokens") > start)).select("part", "first").toLocalIterator()]
    if not hit:
        return documents(spark, path).where("false").select("doc_id", "start", "ids")
    least, largest = min(p for p, _ in hit), max(p for p, _ in hit)
    edge = dict(hit)
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/files").where(f"part BETWEEN {least} AND {largest}")
    # Bounds on stored columns, so that pages are skipped: the first and the last part know where their share begins and ends.
    rows = rows.where(f"part < {largest} OR begin < {stop - edge[largest]}").where(f"part > {least} OR begin > {start - edge[least]} - n_tokens")
    rows = _placed(rows, path)
    skip, until = F.greatest(F.lit(start) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (until - skip).cast("int")).alias("ids")).where(F.size("ids") > 0)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1024):
        ids = b.column("ids")
        flat, edges = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8), ids.offsets.to_numpy().astype(np.int64) * 4
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        columns = [b.column("part"), b.column("doc_id"), b.column("begin"), pa.array(np.diff(edges) // 4), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and start of every document, from the ids that are stored."""
    lean_arrow(spark)
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/files")
    return _placed(rows.select("part", "doc_id", "begin", "ids").mapInArrow(_digests, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long"), path)
