"""Token-id shards: ids in fixed-size blocks, transposed into byte or bit planes, each plane compressed.

A shard file, all integers little-endian::

    magic | planes of chunk 0 | planes of chunk 1 | ... | documents | chunks | footer

A chunk holds ``block`` ids (the last one fewer) of 32 bits. They are transposed into 4 byte planes or
32 bit planes, and each plane is one zstandard frame, so a reader can fetch any range of ids by the chunk
index: first id, number of ids, file position, crc32 of the ids and the plane lengths. ``documents`` holds
each document's key and number of ids. The footer has the two positions, the block size and the layout.

Defined results: a null or empty text has the end id alone; a text of any length is encoded whole, and its ids, which must
fit a task's memory, may span chunks; a null key sorts first; repeated keys are
ordered by a hash of their text, so rows that tie fully are alike; an empty table
makes no shard and returns no row. Only the key and text columns are read, so others cannot clash. Strings of special
tokens in a text are what the library makes of them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c

MAGIC = b"PLANES1\n"
_FOOTER = struct.Struct("<QQQQQII8s")
LAYOUTS = {"byte": 0, "bit": 1}
NO_KEY = -(1 << 63)
MANIFEST = T.StructType().add("shard", "string").add("part", "integer").add("roll", "integer").add("n_docs", "long").add("n_ids", "long").add("n_bytes", "long").add("crc32", "long")
RESULT = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")


def to_planes(ids: np.ndarray, layout: str) -> list[bytes]:
    """The planes of 32-bit ids, least significant first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if layout == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    if layout == "byte":
        raw = np.empty((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """Streams documents into one shard file under a temporary name; ``close`` renames it."""

    def __init__(self, fs, folder: str, name: str, layout: str = "byte", block: int = 1 << 16, level: int = 1):
        import zstandard

        self.fs, self.final, self.temporary = fs, f"{folder}/{name}", f"{folder}/_temporary-{uuid.uuid4().hex}"
        self.layout, self.block, self.compress = layout, block, zstandard.ZstdCompressor(level=level).compress
        self.out, self.at = fs.open_output_stream(self.temporary), 0
        self.pending: list[bytes] = []
        self.waiting = self.n_ids = self.crc = 0
        self.keys, self.counts = array("q"), array("q")
        self.chunks: list[tuple] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, key: int, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        data, size = b"".join(self.pending), 4 * self.block
        stop = len(data) if last else len(data) - len(data) % size
        for at in range(0, stop, size):
            part = data[at : min(at + size, stop)]
            ids = np.frombuffer(part, "<u4")
            planes = [self.compress(p) for p in to_planes(ids, self.layout)]
            crc = zlib.crc32(part)
            self.crc = zlib.crc32(part, self.crc)
            self.chunks.append((self.n_ids, len(ids), self.at, crc, *map(len, planes)))
            self.n_ids += len(ids)
            for p in planes:
                self._write(p)
        self.pending = [data[stop:]] if stop < len(data) else []
        self.waiting = (len(data) - stop) // 4

    def close(self) -> dict:
        self._flush(last=True)
        docs = self.compress(np.array([*map(np.asarray, (self.keys, self.counts))], dtype="<i8").tobytes())
        chunks = self.compress(np.array(self.chunks, dtype="<i8").tobytes())
        docs_at, chunks_at = self.at, self.at + len(docs)
        self._write(docs)
        self._write(chunks)
        self._write(_FOOTER.pack(docs_at, chunks_at, len(self.keys), len(self.chunks), self.n_ids, self.block, LAYOUTS[self.layout], MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return {"n_docs": len(self.keys), "n_ids": self.n_ids, "n_bytes": self.at, "crc32": self.crc}


class ShardReader:
    """Random access to a shard by id range, or every document in turn."""

    def __init__(self, fs, path: str):
        import zstandard

        self.decompress = zstandard.ZstdDecompressor().decompress
        self.file = fs.open_input_file(path)
        size = self.file.size()
        docs_at, chunks_at, n_docs, n_chunks, self.n_ids, self.block, layout, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a finished shard")
        self.layout = next(k for k, v in LAYOUTS.items() if v == layout)
        self.keys, self.counts = np.frombuffer(self.decompress(self.file.read_at(chunks_at - docs_at, docs_at)), "<i8").reshape(2, n_docs)
        self.chunks = np.frombuffer(self.decompress(self.file.read_at(size - _FOOTER.size - chunks_at, chunks_at)), "<i8").reshape(n_chunks, -1)

    def chunk(self, k: int) -> bytes:
        _, n, at, crc, *lengths = self.chunks[k].tolist()
        data, planes, p = self.file.read_at(sum(lengths), at), [], 0
        for length in lengths:
            planes.append(self.decompress(data[p : p + length]))
            p += length
        ids = from_planes(planes, n, self.layout).tobytes()
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, reading only the chunks that hold them."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = b"".join(self.chunk(k) for k in range(first, last + 1))
        return np.frombuffer(data, "<u4")[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """Key and id bytes of each document, in order."""
        data, at, k = b"", 0, 0
        for key, n in zip(self.keys.tolist(), self.counts.tolist()):
            while len(data) - at < 4 * n:
                data, at, k = data[at:] + self.chunk(k), 0, k + 1
            yield key, data[at : at + 4 * n]
            at += 4 * n

    def close(self) -> None:
        self.file.close()


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0, layout: str = "byte", block: int = 1 << 16, shard_ids: int = 64 << 20, shard_docs: int = 4 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write shards to ``folder`` in ascending key order; returns the manifest.

    Rows are range-partitioned by key (and text hash, so a repeated key spreads), each task rolls files of
    at most about ``shard_ids`` ids and ``shard_docs`` documents. A retried task writes the same bytes to the same names. The manifest is
    written beside the shards and has a row for each.
    """
    from pyspark import TaskContext

    n = c.parts_for(docs)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")

    def write(batches):
        from .piece_encoder import ByteLevelPieces, load

        global _ENCODER
        if _ENCODER is None or _ENCODER[0] != tokenizer_path:
            _ENCODER = (tokenizer_path, ByteLevelPieces(load(tokenizer_path)))
        encode, end = _ENCODER[1].encode, b"" if end_id is None else struct.pack("<I", end_id)
        fs, path = c.filesystem(folder)
        fs.create_dir(path, recursive=True)
        part, roll, writer = TaskContext.get().partitionId(), 0, None

        def done():
            m = writer.close()
            return pa.RecordBatch.from_pylist([{"shard": f"{part:06d}-{roll:05d}.planes", "part": part, "roll": roll, **m}], schema=_arrow(MANIFEST))

        for batch in c.slices(batches):
            keys = batch.column("key").to_pylist()
            for k, ids in zip(keys, encode(batch.column("text").to_pylist())):
                if writer is None:
                    writer = ShardWriter(fs, path, f"{part:06d}-{roll:05d}.planes", layout, block)
                writer.add(NO_KEY if k is None else k, ids + end)
                if writer.n_ids + writer.waiting >= shard_ids or len(writer.keys) >= shard_docs:
                    yield done()
                    roll, writer = roll + 1, None
        if writer is not None:
            yield done()

    manifest = rows.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


_ENCODER = None


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read back from the shard files: key, position among all ids, count, crc32.

    Positions are running sums over the manifest, which has one small row per shard. Each shard is read
    by one task; a shard whose ids do not give the manifest's crc32 fails the job.
    """
    from pyspark.sql import Window

    spark = manifest.sparkSession
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    # A running number per shard gives each a task of its own.
    placed = placed.withColumn("n", F.row_number().over(Window.orderBy("part", "roll")).cast("int") - 1)
    shards = max(1, manifest.count())
    placed = placed.repartitionById(shards, F.col("n"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = c.filesystem(folder)
                reader = ShardReader(fs, f"{path}/{row['shard']}")
                at, whole, out = row["first"], 0, []
                for key, ids in reader.documents():
                    n = len(ids) // 4
                    out.append((None if key == NO_KEY else key, at, n, zlib.crc32(ids)))
                    at, whole = at + n, zlib.crc32(ids, whole)
                    if len(out) >= 8192:
                        yield _rows(out)
                        out = []
                reader.close()
                if whole != row["crc32"]:
                    raise ValueError(f"{row['shard']} differs from its manifest")
                yield _rows(out)

    return placed.mapInArrow(read, RESULT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_arrow(RESULT))


def op1_token_planes(spark, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written and read back."""
    import public_tokenizers

    folder = c.fresh_dir(spark, "token-planes")
    manifest = write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_shards(manifest, folder)
