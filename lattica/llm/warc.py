"""WARC archives: writing, reading, and de-duplication by revisit records.

Tasks write gzip-per-record archives below a shared folder through ``pyarrow.fs`` (local, HDFS and object
stores alike).  A file's name holds a fresh id, and only files named in the manifest table, which Spark commits
with its own protocol, count: a task that is run again leaves no second copy behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches, remove

FILE_BYTES = 32 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
HEADERS = "path string, number long, record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload_ok boolean"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def fresh_id(of: str) -> str:
    """The record id that a rewritten archive gives to a record: the same on every run."""
    return f"urn:uuid:{uuid.uuid5(_NAMES, of)}"


def _record(kind: str, record_id: str, page_id, url, digest: str, size: int, block: bytes, extra: tuple = ()) -> bytes:
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {clean}"] * (url is not None) + [f"X-Page-Id: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", *[f"{k}: {v}" for k, v in extra if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Writer:
    """Archives of about ``FILE_BYTES`` of records each in one folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.out, self.done = folder, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.name, self.n, self.size = self.fs.open_output_stream(f"{self.root}/{name}", compression=None), name, 0, 0
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(z.compress(record) + z.flush())
        self.n, self.size = self.n + 1, self.size + len(record)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.n, self.size))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in self.done], pa.string()), pa.array([x[1] for x in self.done], pa.int64()), pa.array([x[2] for x in self.done], pa.int64())], ["path", "records", "bytes"])


def _records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one record in memory at a time."""
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(path)
    with files.open_input_stream(where, compression=None) as f:
        rest = b""
        while True:
            z, out = zlib.decompressobj(31), []
            rest = rest or f.read(1 << 16)
            if not rest:
                return
            while not z.eof:
                out.append(z.decompress(rest))
                rest = z.unused_data if z.eof else f.read(1 << 16)
                if not z.eof and not rest:
                    raise ValueError(f"{path} ends within a record")
            head, _, body = b"".join(out).partition(b"\r\n\r\n")
            named = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
            yield named, body[: int(named["Content-Length"])]


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One response record per row; returns the manifest (path, records, bytes)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("p"))

    def run(batches):
        out, n, task = _Writer(folder), 0, uuid.uuid4().hex
        for b in batches:
            for k, u, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n += 1
                out.add(_record("response", f"urn:uuid:{uuid.uuid5(_NAMES, f'{task}-{n}')}", k, u, payload_digest(p), len(p), _HTTP + p))
        yield out.manifest()

    return rows.mapInArrow(run, MANIFEST)


def read_headers(manifest: DataFrame, files: int | None = None) -> DataFrame:
    """One row per record of the archives of a manifest; of full records the payload is checked against its digest."""
    schema = HEADERS
    paths = manifest.select("path")
    paths = paths.repartition(files) if files else paths

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
        rows = []
        for b in batches:
            for path in b.column(0).to_pylist():
                for n, (h, block) in enumerate(_records(path)):
                    full = h["WARC-Type"] == "response"
                    p = _payload(block) if full else b""
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = h.get("X-Refers-To-Page-Id")
                    rows.append((path, n, h["WARC-Record-ID"].strip("<>"), h["WARC-Type"], int(h["X-Page-Id"]) if "X-Page-Id" in h else None, h.get("WARC-Target-URI"), said, len(p) if full else int(h["X-Payload-Length"]), int(refers) if refers else None, not full or payload_digest(p) == said))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return paths.mapInArrow(run, schema)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with ``kind`` and the original's ``o_page``, ``o_record``, ``o_url``.

    Of records with equal payloads (digest and length) of ``min_bytes`` or more, the one with the largest
    page_id (null counts as smallest, then the largest record id) is the response, the others revisit it.
    The maximum is pre-aggregated, so a payload that a third of all records share costs one row a task;
    Spark may split its side of the join.
    """
    best = F.max(F.struct("page_id", "record_id", "url")).alias("o")
    originals = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(best)
    originals = originals.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"), "o")
    same = (headers["payload_digest"] == originals["d"]) & (headers["payload_bytes"] == originals["n"])
    out = headers.join(originals, same, "left").drop("d", "n")
    revisit = F.col("o").isNotNull() & (F.col("o.record_id") != F.col("record_id"))
    return out.select(headers["*"], F.when(revisit, "revisit").otherwise("response").alias("kind"), *[F.when(revisit, F.col(f"o.{c}")).alias(a) for c, a in (("page_id", "o_page"), ("record_id", "o_record"), ("url", "o_url"))])


def rewrite(resolved: DataFrame, folder: str, files: int) -> DataFrame:
    """Archives in which revisits hold headers alone; every record gets fresh headers.  Returns the manifest.

    Work is dealt by source archive, whose size is bounded when it is written: as many partitions as ``files``, a
    number that is given because the headers that are shuffled are far smaller than the archives read and written.
    """
    asked = resolved.select("path", "number", "kind", "o_page", "o_record", "o_url")

    def run(t: pa.Table) -> pa.Table:
        said = {r["number"]: r for r in t.to_pylist()}
        out, path = _Writer(folder), t.column("path")[0].as_py()
        for n, (h, block) in enumerate(_records(path)):
            r, old, size = said[n], h["WARC-Record-ID"].strip("<>"), int(h["X-Payload-Length"])
            digest, extra = h["WARC-Payload-Digest"].removeprefix("sha1:"), ()
            if r["kind"] == "revisit":
                block = _HTTP
                extra = (("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{fresh_id(r['o_record'])}>"), ("WARC-Refers-To-Target-URI", r["o_url"]), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", r["o_page"]))
            out.add(_record(r["kind"], fresh_id(old), h.get("X-Page-Id"), h.get("WARC-Target-URI"), digest, size, block, extra))
        return pa.Table.from_batches([out.manifest()])

    return asked.repartition(files, "path").groupBy("path").applyInArrow(run, MANIFEST)


def deduplicated_archives(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives, resolve revisits, write the archives anew; one header row per record read back from them.

    Null payloads count as empty, null keys and urls leave their header out, repeated rows make a record
    each (one is the response), an empty table makes no archive and gives an empty result.  Further
    columns are ignored.  The new archives stay in the shared folder, in the ``path`` column's place; the
    first ones are deleted once the new ones are written.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    raw = scratch.place("raw")
    first = scratch.write(write_archives(pages, raw, key, url, payload), "manifest")
    n = max(1, first.count())
    headers = scratch.write(read_headers(first, n), "headers")
    second = scratch.write(rewrite(resolve_revisits(headers, min_bytes), scratch.place("deduplicated"), n), "manifest")
    scratch.drop(headers, first)
    remove(spark, raw)
    return read_headers(second, n)
