"""WARC archives: a writer of gzip members with revisit records, and a reader that salvages damaged files.

The writer gives each record a gzip member of its own (several below 16 MiB each for a larger record) and hands the bytes to Spark's text
writer, so archives go to any file system Spark knows. A member's last byte is the high byte of its size and zero by that bound; it is
the writer's "line separator", so the files hold members and nothing else.

The reader takes files from Spark's binaryFile source. A file holds plain records or gzip members, a member any number of records, and a
record may go on in the next member. Every member's checksum is checked, and each record's syntax, length and block digest (sha256, sha1,
md5). After a failed check the reader looks for the next gzip magic or WARC version line from which a whole record can be read, in the
file or in the member's contents, goes on there, and logs the bytes between as a gap. Of a member whose checksum fails, or that breaks
off, the records whose own block digest holds are kept (`checks` says which checks a record passed); the member is logged as a gap.

A file comes as one row, so it must fit the binaryFile source and a worker: archives should be of the size of a partition, which the
writer's partitions give. A member's contents are unpacked piece by piece and forgotten behind the reader, so a file that is one large
member takes no more than its packed bytes and its largest record.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is a response and the others revisit it.

Defined cases: a null payload is empty; a null url has no target header; rows with a null page_id revisit others but are never revisited
unless all ids of the group are null, then all are responses; repeated rows of the smallest page_id are all responses; an empty table
gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.words import slices
from candlewick.session import scratch_path, written

LEAST = 100
PART = (1 << 24) - 1
#: Of a member's contents, so much is unpacked before its checksum is known; of longer ones the checksum takes a pass of its own.
HELD, PIECE = 1 << 23, 1 << 15
SALTS, BROADCAST_ROWS = 16, 500_000
VERSION = b"WARC/1.1\r\n"
#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "path string, start long, stop long, inner_start long, inner_stop long, kind string, reason string, checks string, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit record of page `first`."""
    revisit = first is not None and first != page_id
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, part: int = PART) -> bytes:
    """gzip members of at most `part` bytes each, one after the other."""
    out = []
    for i in range(0, len(data), part):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(data[i : i + part]) + z.flush())
    return b"".join(out)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> None:
    """Archives of the pages as files in the folder `path`."""
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    df = df.withColumn("digest", F.sha2("payload", 256))
    # A page that is alone with its payload needs no partner, so few digests are looked up.
    firsts = df.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("digest", "first"), "warc-firsts")
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # of two columns of fixed size
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([members(record(*r))[:-1] for r in rows], pa.binary())], schema=schema)

    if few:
        df = df.join(F.broadcast(firsts), "digest", "left")
    else:  # the pages of one digest, which may be very many, are dealt to several tasks
        salted = firsts.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        df = df.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    made = df.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


class Damaged(ValueError):
    pass


@dataclass
class Record:
    """start, stop: of the record, or of the members that hold it; inner_start, inner_stop: in their contents."""

    start: int
    stop: int
    headers: dict[str, str]
    block: bytes
    checks: str = ""
    inner_start: int | None = None
    inner_stop: int | None = None


class Gap(NamedTuple):
    start: int
    stop: int
    reason: str
    inner_start: int | None = None
    inner_stop: int | None = None


class _Plain:
    """A file's own bytes."""

    def __init__(self, data: bytes):
        self.find, self.data = data.find, data

    def get(self, start: int, stop: int) -> bytes:
        return self.data[start:stop]


class _Contents:
    """What a gzip member holds, unpacked as far as it is asked for, and of the next ones if a record goes on there."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = memoryview(data), at
        self.held, self.base = bytearray(), 0
        self.z, self.over, self.problem = zlib.decompressobj(31), False, None

    def _more(self) -> None:
        piece = self.data[self.at : self.at + PIECE]
        if not len(piece):
            self.over, self.problem = True, "gzip: cut off"
            return
        before = self.z.copy()
        try:
            self.held += self.z.decompress(piece)
        except zlib.error as e:
            self.over, self.problem = True, f"gzip: {e}"
            with contextlib.suppress(zlib.error):  # what comes before the damage
                for b in piece:
                    self.held += before.decompress(bytes([b]))
            return
        self.at += len(piece)
        if self.z.eof:
            self.over = True
            self.at -= len(self.z.unused_data)

    def check(self) -> str | None:
        """What is wrong with the member; None if its checksum holds."""
        while not self.over and len(self.held) < HELD:
            self._more()
        if self.over:
            return self.problem
        z, at = self.z.copy(), self.at
        try:
            while not z.eof and at < len(self.data):
                z.decompress(self.data[at : at + PIECE])
                at += PIECE
        except zlib.error as e:
            return f"gzip: {e}"
        return None if z.eof else "gzip: cut off"

    def join(self) -> bool:
        """Goes on with the next member if that is sound and doesn't begin a record."""
        if self.problem or self.data[self.at : self.at + 3] != MAGIC:
            return False
        more = _Contents(self.data, self.at)
        if more.check() or VERSION_LINE.match(more.get(0, 10)):
            return False
        self.held += more.held
        self.z, self.at, self.over = more.z, more.at, more.over
        return True

    def find(self, what: bytes, start: int) -> int:
        at = start - self.base
        while (i := self.held.find(what, at)) < 0 and not self.over:
            at = max(at, len(self.held) - len(what))
            self._more()
        return i + self.base if i >= 0 else -1

    def get(self, start: int, stop: int) -> bytes:
        while len(self.held) < stop - self.base and not self.over:
            self._more()
        return bytes(memoryview(self.held)[start - self.base : stop - self.base])

    def forget(self, upto: int) -> None:
        if upto - self.base > HELD:
            del self.held[: upto - self.base]
            self.base = upto

    def next_version(self, at: int) -> int:
        """Where the next version line begins; -1 if there is none."""
        while (at := self.find(b"WARC/1.", at)) >= 0 and not VERSION_LINE.match(self.get(at, at + 10)):
            at += 1
        return at


def _digested(block: bytes, declared: str) -> bool:
    """Whether there is a block digest that can be checked; Damaged if it doesn't hold."""
    kind, _, digest = declared.partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5") or not digest:
        return False
    raw = hashlib.new(kind.lower(), block).digest()
    if digest.strip().upper().rstrip("=") not in (raw.hex().upper(), base64.b32encode(raw).decode().rstrip("=")):
        raise Damaged("block digest")
    return True


def _parsed(source: _Plain | _Contents, at: int) -> tuple[dict[str, str], bytes, int, bool]:
    """Headers, block, end, and whether a digest was checked, of the record that begins at `at`."""
    if not VERSION_LINE.match(source.get(at, at + 10)):
        raise Damaged("no version line")
    stop = source.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("no end of headers")
    headers = {}
    for line in source.get(at, stop).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    start, end = stop + 4, stop + 4 + int(size)
    whole = source.get(start, end + 4)
    while len(whole) < end + 4 - start and isinstance(source, _Contents) and source.join():
        whole = source.get(start, end + 4)
    if whole[int(size) :] != b"\r\n\r\n":
        raise Damaged("cut off")
    block = whole[: int(size)]
    return headers, block, end + 4, _digested(block, headers.get("warc-block-digest", ""))


@dataclass
class Salvage:
    """Iterates the records of one file's bytes and notes the gaps."""

    data: bytes
    gaps: list[Gap] = field(default_factory=list)

    def _unpacked(self, at: int) -> Iterator[Record]:
        """The member's records. Afterwards `end` is where its bytes end, `problem` what is wrong with it, and `kept` how far it was read."""
        c = _Contents(self.data, at)
        self.problem = c.check()
        pos, lost, why, inner = 0, None, "", []
        while c.get(pos, pos + 1):
            try:
                headers, block, stop, digested = _parsed(c, pos)
                if self.problem and not digested:
                    raise Damaged(self.problem)
            except Damaged as e:
                lost, why = (pos, str(e)) if lost is None else (lost, why)
                pos = c.next_version(pos + 1)
                if pos < 0:
                    break
                continue
            if lost is not None:
                inner.append((why, lost, pos))
                lost = None
            checks = ",".join(x for x, ok in (("member", not self.problem), ("block", digested)) if ok)
            yield Record(at, c.at, headers, block, checks, pos, stop)
            self.kept = pos = stop
            c.forget(pos)
        if lost is not None:
            inner.append((why, lost, None))
            self.problem = self.problem or (why if self.kept is None else None)
        while not c.over:
            c._more()
        self.end = c.at
        if self.kept is not None:
            self.gaps += [Gap(at, self.end, *x) for x in inner if x[2] is not None or not self.problem]

    def __iter__(self) -> Iterator[Record]:
        at, bad, plain = 0, None, _Plain(self.data)
        while at < len(self.data):
            self.kept = self.problem = self.end = None
            if self.data[at : at + 3] == MAGIC:
                for r in self._unpacked(at):
                    if bad:
                        self.gaps.append(Gap(bad[0], at, *bad[1:]))
                        bad = None
                    yield r
            else:
                try:
                    headers, block, self.end, digested = _parsed(plain, at)
                    if bad:
                        self.gaps.append(Gap(bad[0], at, *bad[1:]))
                        bad = None
                    yield Record(at, self.end, headers, block, "block" if digested else "")
                except Damaged as e:
                    self.problem = str(e)
            if not self.problem:
                at = self.end
                continue
            bad = bad or (at, self.problem, self.kept)
            found = START.search(self.data, at + 1)
            at = found.start() if found else len(self.data)
        if bad:
            self.gaps.append(Gap(bad[0], len(self.data), *bad[1:]))


def _row(r: Record, with_payload: bool) -> tuple:
    head, _, payload = r.block.partition(b"\r\n\r\n")
    kind, refers = r.headers.get("warc-type"), r.headers.get("warc-refers-to")
    if kind == "revisit":
        declared = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
        size, digest, payload = int(declared[1]) if declared else None, r.headers.get("warc-payload-digest", "").partition(":")[2] or None, None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return r.inner_start, r.inner_stop, "record", None, r.checks, kind, r.headers.get("warc-record-id", "").strip("<>"), r.headers.get("warc-target-uri"), digest, size, refers and refers.strip("<>"), payload if with_payload else None


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record (kind "record") and per quarantined gap (kind "gap", with the failed check as reason) of the files in `path`.

    start and stop are places in the file, inner_start and inner_stop in the contents of the gzip members there (a gap's inner_stop is null
    where it goes to their end, its inner_start tells how far the records before it were kept).
    Digests and sizes are of the full payload: taken from the bytes of responses, from the headers of revisits.
    """
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in FIELDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            name, file, out = b.column("path")[0].as_py(), Salvage(b.column("content")[0].as_buffer().to_pybytes()), []
            for r in file:
                out.append((name, r.start, r.stop, *_row(r, with_payload)))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            out += [(name, g.start, g.stop, g.inner_start, g.inner_stop, "gap", g.reason, *[None] * 8) for g in file.gaps]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and returns what reading them gives, one row per page."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([^:]+)$', 1) AS bigint)")
    got = read(pages.sparkSession, path, with_payload=False).where("kind = 'record'")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))
