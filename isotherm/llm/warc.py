"""Operator 6: WARC archives, written and read sequentially.

Writing: one gzip member for each record; of records with equal payloads the one with the smallest key holds
the payload, the others revisit it. Reading: members are inflated a piece at a time, records are framed by
Content-Length, digests are computed on the way and held against the headers. Archives lie in the cluster's
shared folder; a reader never holds more than one piece of a file and one record's headers, and a record's
payload only if it is asked for.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import materialize, new_path, per_batch, type_of

VERSION = b"WARC/1.1"
PIECE = 1 << 18  # bytes read at a time
ARCHIVE = 64_000_000  # bytes after which a writer begins another archive
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture; the format demands one.
DATE = "1970-01-01T00:00:00Z"


def file_system(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else "file://" + path)


def urn(key) -> str:
    """A record's name; rows without a key have one in common."""
    return "urn:isotherm:nameless" if key is None else "urn:isotherm:record:" + urllib.parse.quote(str(key), safe="")


def record(key, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member. refers_to: the key of the record whose payload this one repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{urn(key)}>"), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else urn(key))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{urn(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Members:
    """Bytes of a stream of gzip members (or of a plain stream), inflated a piece at a time."""

    def __init__(self, read):
        self.read, self.raw, self.buffer = read, b"", bytearray()
        self.raw = read(PIECE)
        self.plain = bool(self.raw) and self.raw[:2] != b"\x1f\x8b"
        self.inflate = None
        self.at_border = True  # nothing of a member is left

    def more(self) -> bool:
        """Add a piece to the buffer; False at the end, or at the end of a member."""
        if self.plain:
            self.buffer += self.raw
            got, self.raw = bool(self.raw), self.read(PIECE)
            return got
        if not self.raw:
            self.raw = self.read(PIECE)
        if not self.raw:
            if self.inflate is not None:
                raise ValueError("the archive ends inside a gzip member")
            return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(self.inflate.unconsumed_tail or self.raw, PIECE)
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
            return False
        if not self.inflate.unconsumed_tail:
            self.raw = b""
        return True

    def next_member(self) -> bool:
        """Whether something follows; begins the next member."""
        if self.buffer:
            return True
        if not self.raw:
            self.raw = self.read(PIECE)
        return bool(self.raw)

    def until(self, mark: bytes, most: int = 1 << 22) -> bytes:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if len(self.buffer) > most or not self.more() and self.buffer.find(mark, at) < 0:
                raise ValueError("a record's headers do not end")
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more() and not self.buffer:
                raise ValueError("a record is shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            if part:
                yield part


def fields_of(head: bytes) -> dict[str, str]:
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    pairs = (line.split(":", 1) for line in text.split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(read, payloads: bool = False) -> Iterator[dict]:
    """Records of one archive in order. read(n): up to n of its next bytes."""
    stream = Members(read)
    while stream.next_member():
        head = stream.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        f = fields_of(head)
        left = int(f["content-length"])
        block, payload, kept, http, n = hashlib.sha256(), hashlib.sha256(), [], b"", 0
        inside = not f.get("content-type", "").startswith("application/http")
        for part in stream.take(left):
            block.update(part)
            if not inside:
                http += part
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    continue
                http, part, inside = http[: end + 4], http[end + 4 :], True
            payload.update(part)
            n += len(part)
            if payloads:
                kept.append(part)
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end after its Content-Length")
        if not stream.plain and (stream.buffer or stream.inflate is not None):
            if stream.buffer or stream.more() or stream.buffer:
                raise ValueError("a gzip member holds more than one record")
        told, revisit = f.get("warc-payload-digest", ""), f["warc-type"] == "revisit"
        block_told = f.get("warc-block-digest", "")
        own = payload.hexdigest()
        yield {
            "record_id": f.get("warc-record-id", ""), "record_type": f["warc-type"], "url": f.get("warc-target-uri"), "refers_to_id": f.get("warc-refers-to") if revisit else None,
            "payload_bytes": int(fields_of(http).get("content-length", n)) if revisit else n, "payload_digest": told.removeprefix("sha256:") if revisit else own,
            "block_ok": block_told.removeprefix("sha256:") == block.hexdigest() if block_told.startswith("sha256:") else None,
            "payload_ok": told.removeprefix("sha256:") == own if told.startswith("sha256:") and not revisit else None, "payload": b"".join(kept) if payloads and not revisit else None,
        }


def decided(df: DataFrame, key: str, payload: str, url: str, least: int = 100) -> DataFrame:
    """key, url, payload, digest and refers_to: of payloads of at least `least` bytes that are equal, all but the smallest key's refer to it.

    A digest's smallest key is found by partial aggregation; only digests with more than one row are
    written and joined back, by an ordinary join whose hot digests adaptive execution splits.
    """
    p = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload"), 256))
    first = p.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("d")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = materialize(first, "first-records")
    joined = p.join(first, p["digest"] == first["d"], "left")
    return joined.select("key", "url", "payload", "digest", F.when((F.octet_length("payload") >= least) & ~F.col("first").eqNullSafe(F.col("key")), F.col("first")).alias("refers_to"))


def write_archives(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", folder: str | None = None) -> DataFrame:
    """Write every row as a record; returns the archives written: path, records.

    A null payload is empty; a null key is written as such; rows with one key and payload are all responses.
    A task writes files of its own name for each attempt, and only files that finished tasks list are read.
    """
    folder = folder or new_path(df.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        task, n, out, size, records, paths = TaskContext.get(), 0, None, 0, 0, []
        for batch in batches:
            for k, u, p, d, r in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:05d}.warc.gz"
                    out, size, records, n = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0, n + 1
                data = record(k, u, p.encode(), d, r)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    paths.append((f"{folder}/{name}", records))
        if out is not None:
            out.close()
            paths.append((f"{folder}/{name}", records))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths], pa.string()), pa.array([r for _, r in paths], pa.int64())], names=["path", "records"])

    return materialize(decided(df, key, payload, url).mapInArrow(run, "path string, records long"), "warc-list")


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in column `path` (plain or gzip): the identifiers, sizes, digests and whether they hold."""
    schema = "record_id string, record_type string, url string, refers_to_id string, payload_bytes long, payload_digest string, block_ok boolean, payload_ok boolean, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batch):
        for path in batch.column("path").to_pylist():
            system, base = file_system(path)
            rows: list[dict] = []
            with system.open_input_stream(base, compression=None) as f:
                for row in read_records(f.read, payloads):
                    rows.append(row)
                    if len(rows) >= (64 if payloads else 5000):
                        yield {c: [r[c] for r in rows] for c in names}
                        rows = []
            yield {c: [r[c] for r in rows] for c in names}

    n = max(1, archives.count())
    return per_batch(archives.select("path").repartition(n), work, schema)


def key_of(column, kind: str):
    name = r"^<urn:isotherm:record:(.*)>$"
    return F.when(F.col(column).rlike(name), F.url_decode(F.regexp_extract(column, name, 1))).cast(kind)


def round_trip(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write every row, read all archives, and fail if a digest does not hold. key, payload_bytes, payload_digest, record_type, refers_to."""
    kind = type_of(df, key)
    read = read_archives(df.sparkSession, write_archives(df, key, payload, url))
    sound = F.coalesce("block_ok", F.lit(False)) & F.coalesce("payload_ok", F.lit(True))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "record_id", F.lit(" does not hold"))))
    return read.select(key_of("record_id", kind).alias(key), "payload_bytes", checked.alias("payload_digest"), "record_type", key_of("refers_to_id", kind).alias("refers_to"))
