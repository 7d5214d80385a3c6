r"""Exact deduplication by Grace hash partitioning.

Texts are equal when identical after deleting white space ``[\x20\x09-\x0D]``. The work has three steps.

1. *Local tables.* Each task deduplicates the rows of its own input split, so that however many copies a
   text has, at most one record per split leaves it.
2. *Grace partitioning.* These records are exchanged by content hash (Spark's shuffle files are the first
   level of spill files). A task streams its bucket into an open-addressing table, which compares complete
   contents, not only hashes. When the table's distinct contents reach ``bound`` bytes it takes no more of them: records
   of contents that it has are still merged, the others go to spill files by further hash bits, and each file is treated
   alike. So memory is bounded, every level ends at least one content, and a text with copies in every split costs
   one content and no more. Of equal texts, the longest original, then the smallest ``doc_id``, stays.
3. *Answers* (``dedup``). A group's answer returns once per table that held it, and each row finds it by
   (split, place in the split's table): no key is hotter than one split. ``keep_first`` needs no answers: the records
   that it exchanges are the rows themselves, so one exchange is all it has.

Defined results: a null text counts as empty, all empty texts are equal; texts of any length are compared whole;
rows with a null key come after all others; exactly one row of each group is kept, also where rows tie
fully or have no key (any one of rows alike in length and key). ``dedup`` reads only the key
and text columns; ``keep_first`` passes the others through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c

_BLANKS = b"\t\n\x0b\x0c\r "
NO_KEY = (1 << 63) - 1
LOCAL = T.StructType().add("split", "long").add("slot", "long").add("doc_id", "long").add("n_here", "long").add("best_length", "long").add("best_id", "long").add("hash", "long").add("content", "binary").add("text_sha256", "string")
ANSWER = T.StructType().add("split", "long").add("slot", "long").add("keep_id", "long").add("group_size", "long").add("won", "boolean")
_RECORD = struct.Struct("<qqqqqqq")
_PLACE = struct.Struct("<qqq")


def normalise(text: bytes) -> bytes:
    return text.translate(None, _BLANKS)


def content_hash(content: bytes) -> int:
    """64 bits, signed."""
    import xxhash

    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


class OpenTable:
    """Open addressing with linear probing; a slot holds a hash, a cell is equal only if its content is."""

    def __init__(self, capacity: int = 1 << 10):
        self.hashes, self.cells = np.zeros(capacity, np.int64), np.full(capacity, -1, np.int64)
        self.contents: list[bytes] = []
        self.values: list[list] = []

    def _grow(self) -> None:
        old = [(h, k) for h, k in zip(self.hashes.tolist(), self.cells.tolist()) if k >= 0]
        n = 4 * len(self.cells)
        self.hashes, self.cells = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for h, k in old:
            at = h & (n - 1)
            while self.cells[at] >= 0:
                at = (at + 1) & (n - 1)
            self.hashes[at], self.cells[at] = h, k

    def find(self, h: int, content: bytes, add: bool = True) -> tuple[int, bool]:
        """The content's number, and whether it is new. An unknown one that is not to be added has the number -1."""
        n, cells, hashes = len(self.cells), self.cells, self.hashes
        at = h & (n - 1)
        while (k := cells.item(at)) >= 0:
            if hashes.item(at) == h and self.contents[k] == content:
                return k, False
            at = (at + 1) & (n - 1)
        if not add:
            return -1, True
        k = len(self.contents)
        hashes[at], cells[at] = h, k
        self.contents.append(content)
        self.values.append([])
        if 2 * (k + 1) > n:
            self._grow()
        return k, True


def better(length: int, key: int, than_length: int, than_key: int) -> bool:
    return length > than_length or length == than_length and key < than_key


def _local(docs: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """Step 1: a row per document; the best row of each distinct content in a table also carries the content.

    A table that outgrows ``bound`` bytes is closed and a new one begun under another split number, so memory
    is bounded whatever the split's size; the later steps merge what two tables both hold.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("k", F.col("t").cast("binary").alias("t"), F.length("t").cast("long").alias("n"))
    schema = pa.schema([("split", pa.int64()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("n_here", pa.int64()), ("best_length", pa.int64()), ("best_id", pa.int64()), ("hash", pa.int64()), ("content", pa.binary()), ("text_sha256", pa.string())])

    def run(batches):
        from pyspark import TaskContext

        part, tables = TaskContext.get().partitionId(), 0
        table, held, size = OpenTable(), [], 0

        def done():
            for at in range(0, len(held), 4096):
                out = []
                for place, (k, slot) in enumerate(held[at : at + 4096], at):
                    n, length, best, h, digest, best_place = table.values[slot]
                    out.append((part << 32 | tables, slot, None if k == NO_KEY else k, *((n, length, best, h, table.contents[slot]) if place == best_place else (None,) * 5), digest))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

        for batch in c.slices(batches):
            for k, t, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                k = NO_KEY if k is None else k
                content = normalise(t)
                h = content_hash(content)
                slot, first = table.find(h, content)
                value = table.values[slot]
                if first:
                    value += [1, length, k, h, hashlib.sha256(content).hexdigest(), len(held)]
                    size += len(content) + 300
                else:
                    value[0] += 1
                    if better(length, k, value[1], value[2]):
                        value[1:3], value[5] = (length, k), len(held)
                held.append((k, slot))
                size += 100
                if size > bound:
                    yield from done()
                    table, held, size, tables = OpenTable(), [], 0, tables + 1
        if held:
            yield from done()

    return rows.mapInArrow(run, LOCAL)


class Grace:
    """Records of one bucket; what no longer fits a table of ``bound`` bytes of distinct contents is spilt by hash bits."""

    FAN = 16

    def __init__(self, folder: str, bound: int):
        self.folder, self.bound = folder, bound

    def solve(self, records, level: int = 0):
        """``records``: iterable of (split, slot, n, length, best, hash, content). Yields the answers."""
        table, size, files = OpenTable(), 0, None
        with tempfile.SpooledTemporaryFile(max_size=8 << 20, dir=self.folder) as places:  # of all copies, however many
            for r in records:
                split, slot, n, length, best, h, content = r
                k, new = table.find(h, content, size <= self.bound)
                if k < 0:
                    files = files or spill_files(self.folder, self.FAN)
                    self._put(files[spill_number(h, level, self.FAN)], r)
                    continue
                value = table.values[k]
                if new:
                    value += [n, length, best, split, slot]
                    size += len(content) + 400
                else:
                    value[0] += n
                    if better(length, best, value[1], value[2]):
                        value[1:] = length, best, split, slot
                places.write(_PLACE.pack(split, slot, k))
            places.seek(0)
            while some := places.read(_PLACE.size << 12):
                for split, slot, k in _PLACE.iter_unpack(some):
                    n, _, best, *won = table.values[k]
                    yield split, slot, None if best == NO_KEY else best, n, won == [split, slot]
        del table
        for f in files or ():
            f.seek(0)
            yield from self.solve(self._get(f), level + 1)
            f.close()

    @staticmethod
    def _put(f, r) -> None:
        f.write(_RECORD.pack(*r[:6], len(r[6])))
        f.write(r[6])

    @staticmethod
    def _get(f):
        while head := f.read(_RECORD.size):
            *r, n = _RECORD.unpack(head)
            yield (*r, f.read(n))


def spill_files(folder: str, n: int) -> list:
    return [tempfile.TemporaryFile(dir=folder) for _ in range(n)]


def spill_number(h: int, level: int, fan: int) -> int:
    """Other bits of the hash on each level; after the last ones they begin anew, mixed."""
    turn, at = divmod(level, 15)
    return ((h * (2 * turn + 1) & (1 << 64) - 1) >> (4 * at)) & (fan - 1)


def _answers(local: DataFrame, partitions: int, bound: int) -> DataFrame:
    """Step 2."""
    schema = pa.schema([("split", pa.int64()), ("slot", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("won", pa.bool_())])
    records = local.where(F.col("content").isNotNull()).select("split", "slot", "n_here", "best_length", "best_id", "hash", "content").repartition(partitions, "hash")

    def run(batches):
        def records():
            for batch in c.slices(batches):
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)))

        with tempfile.TemporaryDirectory(dir=_scratch()) as folder:
            out = []
            for answer in Grace(folder, bound).solve(records()):
                out.append(answer)
                if len(out) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return records.mapInArrow(run, ANSWER)


class BestRows:
    """The best row of each distinct content among the record batches given, in an open-addressing table."""

    def __init__(self, key: int, text: int, bound: int, hashes: int | None = None):
        """Places of columns; without ``hashes`` they are computed and added as the last one."""
        self.key, self.text, self.bound, self.hashes = key, text, bound, hashes
        self.table, self.size = OpenTable(), 0
        self.chunks: list[pa.RecordBatch] = []
        self.stale = 0

    def add(self, batch: pa.RecordBatch, spill: bool) -> list[tuple[int, int]]:
        """Takes the rows in; with ``spill`` none of new content once the bound is reached: (row, hash) of those."""
        table, over, new, made = self.table, [], {}, []
        told = None if self.hashes is None else batch.column(self.hashes).to_pylist()
        for i, (k, t) in enumerate(zip(batch.column(self.key).to_pylist(), batch.column(self.text).to_pylist())):
            t = t or ""
            content = normalise(t.encode("utf-8", "surrogatepass"))
            if told:
                h = told[i]
            else:
                made.append(h := content_hash(content))
            slot, first = table.find(h, content, not spill or self.size <= self.bound)
            if slot < 0:
                over.append((i, h))
                continue
            rank = (-len(t), NO_KEY if k is None else k, k is None)
            value = table.values[slot]
            if first:
                value += [rank, 0, 0]
                self.size += 2 * len(content) + 600
            elif rank >= value[0]:
                continue
            else:
                self.stale += slot not in new
                value[0] = rank
            new[slot] = i
        if made:
            batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], [*batch.schema.names, "h"])
        if new:
            for at, slot in enumerate(new):
                table.values[slot][1:] = len(self.chunks), at
            self.chunks.append(batch.take(pa.array(list(new.values()), pa.int64())))
            if self.stale > 256 + len(table.values) // 2:  # forget rows that better ones replaced
                self.chunks, self.stale = list(self.rows()), 0
                place = ((c, i) for c, chunk in enumerate(self.chunks) for i in range(chunk.num_rows))
                for value in sorted(table.values, key=lambda v: v[1:]):
                    value[1:] = next(place)
        return over

    def rows(self):
        live: list[list[int]] = [[] for _ in self.chunks]
        for _, chunk, at in self.table.values:
            live[chunk].append(at)
        for chunk, at in zip(self.chunks, live):
            if at:
                yield chunk if len(at) == chunk.num_rows else chunk.take(pa.array(sorted(at), pa.int64()))


def _best_rows(batches, key: int, text: int, hashes: int, bound: int, folder: str, level: int = 0):
    """Step 2 for whole rows: the best row of each content of a bucket."""
    best, files, writers = BestRows(key, text, bound, hashes), None, {}
    for batch in batches:
        over = best.add(batch, True)
        parts: dict[int, list[int]] = {}
        for i, h in over:
            parts.setdefault(spill_number(h, level, Grace.FAN), []).append(i)
        for n, rows in parts.items():
            files = files or spill_files(folder, Grace.FAN)
            if n not in writers:
                writers[n] = pa.ipc.new_stream(files[n], batch.schema)
            writers[n].write_batch(batch.take(pa.array(rows, pa.int64())))
    yield from best.rows()
    del best
    for n, writer in writers.items():
        writer.close()
        files[n].seek(0)
        yield from _best_rows(pa.ipc.open_stream(files[n]), key, text, hashes, bound, folder, level + 1)
    for f in files or ():
        f.close()


def _scratch() -> str | None:
    """Spark's own scratch disk of this executor, where spill files belong; they are lost with their task alone."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",") if os.path.isdir(d)), None)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = 96 << 20) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    partitions = c.parts_for(docs, 64 << 20)
    # Written once: both later steps read it, and the numbers of splits cannot change under a retry.
    local = c.staged(_local(docs, key, text, bound), "grace-local")
    answers = _answers(local, partitions, bound)
    members = local.select("split", "slot", "doc_id", F.col("hash").isNotNull().alias("best"), "text_sha256")
    joined = members.join(answers, ["split", "slot"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("best") & F.col("won")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = 96 << 20) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``; rows are exchanged once, copies within a split not at all."""
    places = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    rows = docs.toDF(*[f.name for f in places])  # own names, so that no column can clash
    at, width = [], len(places)
    for name, kind in ((key, T.LongType()), (text, T.StringType())):
        at.append(docs.columns.index(name))
        if places[at[-1]].dataType != kind:  # then it is cast beside the column
            rows, at[-1] = rows.withColumn(f"as{len(at)}", F.col(f"c{at[-1]}").cast(kind)), width
            width += 1
    schema = T.StructType([*rows.schema.fields, T.StructField("h", T.LongType())])

    def local(batches):
        best = BestRows(*at, bound)
        for batch in c.slices(batches):
            best.add(batch, False)
            if best.size > bound:
                yield from best.rows()
                best = BestRows(*at, bound)
        yield from best.rows()

    def solve(batches):
        with tempfile.TemporaryDirectory(dir=_scratch()) as folder:
            for batch in _best_rows(c.slices(batches), *at, width, bound, folder):
                yield batch.select(list(range(len(places))))

    found = rows.mapInArrow(local, schema).repartition(c.parts_for(docs, 64 << 20), "h").mapInArrow(solve, T.StructType(places))
    return found.toDF(*docs.columns)


def op7_grace_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
