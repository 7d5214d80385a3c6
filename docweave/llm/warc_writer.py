"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key; each task writes gzip members one after another and rolls to a new file once
the compressed size passes the limit. Headers are regenerated from the rows alone (ids are UUIDs made of the
key and digest, the date is a column or a fixed one), gzip headers carry no time, so the same rows give the
same bytes. A file is written under a temporary name and renamed when complete; manifests with sizes and
SHA-256 digests are written last, and a reader trusts only files that the manifest names.

Of records with equal payloads, the one with the largest key is written as ``response``, the others as
``revisit`` of it, without payload. Which one that is comes from a pre-aggregated exchange of digests only, which are
computed once and written: each input row looks its digest's answer up under a salt, so a payload shared by a third of all rows
spreads. A file begins with a ``warcinfo`` record.

Defined results: a null payload is empty; payloads below ``least`` bytes are always responses; payloads of any
length are kept whole; rows with a null key sort first and are nobody's original unless all keys of the payload
are null; repeated rows are each written, and those equal to the original's key are responses. Only the named
columns are read, so others cannot clash; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c

MANIFEST = T.StructType().add("file", "string").add("part", "integer").add("roll", "integer").add("n_records", "long").add("n_bytes", "long").add("sha256", "string")
RECORD = T.StructType().add("page_id", "long").add("payload_bytes", "long").add("payload_digest", "string").add("record_type", "string").add("refers_to", "long")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "1970-01-01T00:00:00Z"
SALTS = 256


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{digest}')}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def build(key, url: str | None, payload: bytes, digest: str, original, n_payload: int, date: str = DATE) -> bytes:
    """An uncompressed record; ``original`` is the key that a revisit refers to, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_payload}\r\n\r\n".encode()
    revisit = original is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_field(url or '') or 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"X-Key: {'' if key is None else key}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(original, digest)}", f"X-Refers-To-Key: {original}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The ``warcinfo`` record of a file."""
    block = b"software: docweave\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, 'warcinfo')}", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member with no time or name in it."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class WarcFile:
    def __init__(self, fs, folder: str, name: str):
        self.fs, self.final, self.temporary = fs, f"{folder}/{name}", f"{folder}/_temporary-{uuid.uuid4().hex}"
        self.out, self.n, self.size, self.sha = fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()

    def add(self, record: bytes) -> None:
        data = member(record)
        self.out.write(data)
        self.sha.update(data)
        self.n, self.size = self.n + 1, self.size + len(data)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return {"n_records": self.n, "n_bytes": self.size, "sha256": self.sha.hexdigest()}


def read_records(data):
    """(headers, block) of each record of an open gzip file of one member per record."""
    inflate, pending = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    while True:
        chunk = pending or data.read(1 << 20)
        if not chunk:
            break
        parts.append(inflate.decompress(chunk))
        pending = inflate.unused_data
        if inflate.eof:
            yield parse(b"".join(parts))
            inflate, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def originals(rows: DataFrame, least: int) -> DataFrame:
    """(digest, salt, original): the largest key of each digest, for each salt that has rows of it."""
    local = rows.where(F.col("n") >= least).groupBy("digest", "salt").agg(F.max("key").alias("key"), F.count(F.lit(1)).alias("n_rows"))
    best = local.groupBy("digest").agg(F.max("key").alias("original"), F.sum("n_rows").alias("n_equal"), F.collect_list("salt").alias("salts"))  # at most SALTS of them
    return best.where(F.col("n_equal") > 1).select("digest", "original", F.explode("salts").alias("salt"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, roll_bytes: int = 1 << 30, date: str | None = None) -> DataFrame:
    """Write archives to ``folder``; returns the manifest, which is written there last.

    ``date`` names a timestamp column of crawl times (session's time zone); without it, and where it is null, records have ``DATE``.
    """
    from pyspark import TaskContext

    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    when = F.coalesce(F.date_format(F.col(date).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE)) if date else F.lit(DATE)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), when.alias("date"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload").cast("long")).withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
    small = c.staged(rows.select("key", "url", "digest", "n", "salt"), "warc-digests")
    found = originals(small, least)
    revisits = small.join(found, ["digest", "salt"]).where(F.col("original") != F.coalesce("key", F.lit(-(1 << 63)))).groupBy("key", "url", "digest").agg(F.first("original").alias("original"))
    # Payloads are exchanged once, by the sort. What makes a row a revisit comes as a row of its own just before it.
    told = revisits.select("key", "url", F.lit(None).cast("binary").alias("payload"), "digest", F.lit(None).cast("long").alias("n"), "original", F.lit(DATE).alias("date"))
    work = rows.select("key", "url", "payload", "digest", "n", F.lit(None).cast("long").alias("original"), "date").unionByName(told)
    work = work.repartitionByRange(c.parts_for(pages), "key", "url", "digest").sortWithinPartitions("key", "url", "digest", F.col("n").asc_nulls_first())
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches):
        fs, path = c.filesystem(folder)
        fs.create_dir(path, recursive=True)
        part, roll, out = TaskContext.get().partitionId(), 0, None
        revisit: tuple = ()

        def done():
            return pa.RecordBatch.from_pylist([{"file": f"{part:06d}-{roll:05d}.warc.gz", "part": part, "roll": roll, **out.close()}], schema=schema)

        for batch in c.slices(batches):
            for k, u, p, d, n, original, at in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if n is None:
                    revisit = (k, u, d, original)
                    continue
                original = revisit[3] if revisit[:3] == (k, u, d) else None
                if out is None:
                    out = WarcFile(fs, path, f"{part:06d}-{roll:05d}.warc.gz")
                    out.add(info(f"{part:06d}-{roll:05d}.warc.gz"))
                out.add(build(k, u, p, base64.b32encode(d).decode(), original, n, at))
                if out.size >= roll_bytes:
                    yield done()
                    out, roll = None, roll + 1
        if out is not None:
            yield done()

    work.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the files that the manifest names; digests are computed anew and compared."""
    from pyspark.sql import Window

    files = max(1, manifest.count())
    numbered = manifest.withColumn("i", F.row_number().over(Window.orderBy("part", "roll")).cast("int") - 1)  # one small row per file
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for batch in batches:
            for m in batch.to_pylist():
                fs, path = c.filesystem(folder)
                out, n = [], 0
                with fs.open_input_stream(f"{path}/{m['file']}", compression=None) as f:
                    for headers, block in read_records(f):
                        if headers["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
                            raise ValueError("a block differs from its digest")
                        n += 1
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
                            raise ValueError("a payload differs from its digest")
                        key, to = headers["X-Key"], headers.get("X-Refers-To-Key")
                        out.append((int(key) if key else None, length, digest, kind, int(to) if to else None))
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
                            out = []
                if n != m["n_records"]:
                    raise ValueError(f"{m['file']} has {n} records, its manifest {m['n_records']}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return numbered.repartitionById(files, F.col("i")).mapInArrow(read, RECORD)


def op9_warc_shards(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back."""
    folder = c.fresh_dir(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
