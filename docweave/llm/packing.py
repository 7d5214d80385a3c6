"""Best-two-fit packing of token sequences into bins of fixed size.

Documents longer than a bin are cut into pieces of the bin's size, the last one shorter. Pieces are
packed greedily by best fit, largest first; then, bin by bin, the smallest piece is taken out if two
unpacked pieces fit the widened gap more tightly than it did. Lengths are small integers, so the unpacked
pieces are counted per length, and finding the best one or two for a gap is a scan over lengths, never
over pieces.

Only lengths travel: token ids are never shuffled. Pieces are spread by a hash over groups of about
``group_pieces``, each packed by one task; a hash spreads any source or run of copies evenly. A group
leaves at most a few bins unfilled; those (less than ``full`` of a bin) are taken apart and packed once
more together, by the same rule in as many groups as they need, so the number of partly filled bins does not grow with
the number of groups, and no group grows, also where no two pieces fit a bin and every bin is left over.

Defined results: a null or empty text is one piece that has the end id alone; texts of any length are cut
whole; rows alike in key and text are packed separately, each as a document of its own, told apart by
``serial``, which is unique per piece; a null key is kept as null. An empty table gives no piece. Only key and text columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c

PIECES = T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("serial", "long")
PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("filled", T.LongType())])
_ENCODER: tuple | None = None


def cut(docs: DataFrame, tokenizer_path: str, size: int, end_id: int | None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text once and cut it; a row per piece, with its ids if ``with_ids``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = c.spread(rows)
    fields = [(f.name, pa.int32() if f.name == "piece" else pa.int64()) for f in PIECES.fields] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)
    result = T.StructType([*PIECES.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches):
        from pyspark import TaskContext

        from .piece_encoder import WordPieces, load

        global _ENCODER
        if _ENCODER is None or _ENCODER[0] != tokenizer_path:
            _ENCODER = (tokenizer_path, WordPieces(load(tokenizer_path)))
        encode, end = _ENCODER[1].encode, b"" if end_id is None else end_id.to_bytes(4, "little")
        serial = TaskContext.get().partitionId() << 38
        for batch in c.slices(batches):
            out = []
            for k, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, max(len(ids), 1), 4 * size)):
                    part = ids[at : at + 4 * size]
                    serial += 1
                    out.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part), serial, *([np.frombuffer(part, "<i4")] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(zip(*out), fields)], schema=schema)

    return rows.mapInArrow(run, result)


class _Lengths:
    """Counts of unpacked pieces by length, with the lengths present in ascending order."""

    def __init__(self, lengths: np.ndarray):
        present, counts = np.unique(lengths, return_counts=True)
        self.present, self.count = present.tolist(), dict(zip(present.tolist(), counts.tolist()))

    def largest(self, upto: int) -> int:
        """The longest length present that is at most ``upto``; 0 if none."""
        at = bisect_left(self.present, upto + 1)
        return self.present[at - 1] if at else 0

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            del self.count[length]
            self.present.pop(bisect_left(self.present, length))

    def give(self, length: int) -> None:
        if length not in self.count:
            self.present.insert(bisect_left(self.present, length), length)
            self.count[length] = 0
        self.count[length] += 1

    def two(self, gap: int, over: int) -> tuple[int, int]:
        """The two lengths present with the largest sum of at most ``gap``, if it is over ``over``; else zeros.

        One pointer from either end."""
        p, best = self.present, (0, 0)
        low, high = 0, bisect_left(self.present, gap) - 1
        while low <= high:
            a, b = p[low], p[high]
            if a + b > gap:
                high -= 1
                continue
            if a + b > over and (low < high or self.count[a] > 1):
                over, best = a + b, (a, b)
                if over == gap:
                    break
            low += 1
        return best


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins as lists of lengths that use up ``lengths``; each is at least 1 and at most ``size``."""
    left = _Lengths(lengths)
    bins = []
    while left.present:
        first = left.largest(size)
        left.take(first)
        bin_, gap = [first], size - first
        while gap and (one := left.largest(gap)):
            left.take(one)
            bin_.append(one)
            gap -= one
        # Put two for the smallest while that leaves less room; it fills the gap exactly in most cases.
        while gap and len(bin_) > 1 and left.present:
            smallest = min(bin_)
            a, b = left.two(gap + smallest, smallest)
            if not a:
                break
            bin_.remove(smallest)
            left.give(smallest)
            left.take(a)
            left.take(b)
            bin_ += [a, b]
            gap -= a + b - smallest
        bins.append(bin_)
    return bins


def _assign(pdf, size: int, first: int):
    """Sequence numbers from ``first`` and offsets for the pieces of one group."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "serial"], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    sequence, offset, filled = (np.zeros(len(pdf), np.int64) for _ in range(3))
    present, starts = np.unique(lengths, return_index=True)
    upnext = dict(zip(present.tolist(), starts.tolist()))
    for k, bin_ in enumerate(best_two_fit(lengths, size)):
        at, total = 0, sum(bin_)
        for n in bin_:
            i = upnext[n]
            upnext[n] += 1
            sequence[i], offset[i], filled[i] = first + k, at, total
            at += n
    return pdf.assign(sequence_id=sequence, offset=offset, filled=filled)


def _pack_groups(pieces: DataFrame, size: int, groups: int, base: int) -> DataFrame:
    def pack(key, pdf):
        # sequence numbers: base, group and place, so groups never share one
        return _assign(pdf.drop(columns="group"), size, base << 62 | int(key[0]) << 34)[[f.name for f in PACKED.fields]]

    names = [f.name for f in PIECES.fields]
    spread = F.pmod(F.xxhash64("doc_id", "piece", "serial"), F.lit(groups)).cast("int")
    return pieces.select(*names, spread.alias("group")).groupBy("group").applyInPandas(pack, PACKED)


def pack(pieces: DataFrame, size: int, group_pieces: int = 100_000, full: float = 0.97) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read several times: give a written table."""
    whole = pieces.where(F.col("length") == size)
    rest = pieces.where(F.col("length") < size)
    n = rest.count()
    groups = max(1, -(-n // group_pieces))
    first = c.staged(_pack_groups(rest, size, groups, 0), "pack-first")
    good, over = first.where(F.col("filled") >= full * size), first.where(F.col("filled") < full * size)
    again = _pack_groups(over, size, max(1, -(-over.count() // group_pieces)), 1)
    # A piece that fills a sequence needs no packing: its own key numbers it.
    alone = whole.withColumn("sequence_id", -1 - F.col("serial"))
    alone = alone.withColumn("offset", F.lit(0).cast("long")).withColumn("filled", F.col("length"))
    names = [f.name for f in PACKED.fields]
    return good.select(*names).unionByName(again.select(*names)).unionByName(alone.select(*names))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, cut and pack: a row per piece with its place."""
    pieces = c.staged(cut(docs, tokenizer_path, size, end_id, key, text), "pieces")
    return pack(pieces, size)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces cut ``with_ids`` and their places: sequence_id, ids, doc_ids."""
    placed = pieces.select("serial", "ids").join(packed.select("serial", "sequence_id", "offset", "doc_id"), "serial")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence is bounded by its size
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op2_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
