r"""Near duplicates by a parity-sketch join: exact Jaccard links between sets of 5-word shingles.

Two sets link when ``100 * |A & B| >= threshold * |A | B|``. For sizes a and b that bounds the symmetric
difference: at 80, ``|A ^ B| <= (a + b) / 9``.

1. *Sketch.* Every shingle is hashed to 64 bits. A set of n shingles falls into a size band; the band has m blocks,
   the high hash bits choose a shingle's block, and each block keeps the XOR (parity) of its shingles' hashes, a
   sparse bit sketch. The Hamming distance of sketches never exceeds the symmetric difference, so if at most k
   shingles differ, at most k blocks do (pigeonhole). Blocks are put in an order that depends on content
   alone (heavier first); then the first block that two linked sets share is among the first k + 1 of either. Only
   those are emitted, k from the largest partner a set may have. A set near its band's upper end also
   emits keys for the next band, where its larger partners are.
2. *Join.* Keys meet by one exchange; keys of a single class of equal sets vanish there. The others meet again with
   a dense 512-bit parity sketch per set: pairs whose sizes or Hamming distance exclude a link are dropped. A
   pair that shares several keys belongs to the smallest; it is reported there alone if that is among the ``SMALLEST`` smallest of
   both, or else by each, and step 3, which knows all keys, drops the others. Groups above ``TILE`` sets are cut into tiles, and pairs of tiles are
   separate work, so no group meets in one task, however large. Where most sets of a tile pair stay candidates (texts made from one
   template), its pairs leave it as one bit matrix, a *block*, not as rows.
3. *Verify.* Surviving pairs are compared exactly on their shingles, tile by tile or block by block: each text in question is sent
   once to each, and its set computed again there; no other text is exchanged. A tile or block has a bounded number
   of sets and shingles. Pairs give links; a block gives, per set, the number of documents linked and its local component, so what
   leaves a block grows with its sets, not with its pairs.

Copies never multiply: sets that are equal form a class, with one line per class and input split in step 1. A class is
named by its hash everywhere; ``doc_id`` is looked at only where an answer names one.

Defined results: a null text, or one without words, has no shingle and links with nothing; a text of fewer than
five words has its whole word sequence as one shingle; texts of any length are used whole; repeated rows each
count as a document; a null key links nothing and is never a component's id unless all keys in it are null; an
empty table gives an empty result. ``near_duplicates`` reads only key and text, so other columns cannot clash; ``keep_one``
passes them through and keeps exactly one row of each component, whatever repeats.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c
from .components import components

WIDTH = 5
SKETCH_BITS = 512
SMALLEST = 8  # keys of a set that are listed for choosing a pair's reporter
TILE = 1024
VERIFY_SHINGLES = 1 << 21  # of a tile or half a block, about; 16 MB
VERIFY_SETS = 2048
DENSE = 4  # pairs a set from which a tile pair's are sent as a block
MOST_BITS = 1 << 27
SALTS = 1024
_PAD = np.uint64((1 << 64) - 1)
_U = np.uint64
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SKETCHED = T.StructType().add("id", "long").add("doc_id", "long").add("salt", "integer").add("n", "long").add("cls", "long").add("keys", T.ArrayType(T.LongType())).add("sketch", "binary").add("smallest", "binary")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = min(len(w), WIDTH)
    total = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        total += mix(w[i : len(w) - n + 1 + i] + _MULTIPLY[i]) * _MULTIPLY[i]
    return np.unique(mix(total))


class Bounds:
    """Sizes and differences that ``100 * intersection >= threshold * union`` allows."""

    def __init__(self, threshold: int = 80):
        if not 0 < threshold <= 100:
            raise ValueError("the threshold is a percentage above 0")
        self.t = threshold

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.t

    def sizes_fit(self, a, b):
        return 100 * np.minimum(a, b) >= self.t * np.maximum(a, b)

    def difference(self, total):
        """Most differing shingles of two sets that have ``total`` together."""
        return total * (100 - self.t) // (100 + self.t)

    def keep(self, n: int) -> int:
        """The largest difference of a set of n from any partner."""
        return int(self.difference(n + self.largest_partner(n)))

    def bands(self, n: int) -> list[int]:
        own, last = n.bit_length() - 1, self.largest_partner(n).bit_length() - 1
        return list(range(own, last + 1))

    def blocks(self, band: int) -> int:
        return max(16, math.ceil(1.2 * (self.keep((2 << band) - 1) + 1)))


def band_keys(hashes: np.ndarray, band: int, m: int, keep: int) -> np.ndarray:
    """The first ``keep`` block keys of a set in the order that all sets share."""
    block = ((hashes >> _U(32)) * _U(m)) >> _U(32)  # ascending, as the hashes are
    block = block.astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    weight = np.diff(np.append(starts, len(block)))
    parity = np.bitwise_xor.reduceat(mix(hashes), starts)
    seed = mix(_U(band * 1_000_003) + block[starts].astype(np.uint64))
    keys = mix(parity ^ seed)
    if keep < len(keys):
        order = (_U(255) - np.minimum(weight, 255).astype(np.uint64)) << _U(56) | keys >> _U(8)
        return keys[np.argpartition(order, keep - 1)[:keep]]
    if keep > len(keys):  # blocks empty in both sets are shared too; they come last in the order
        empty = np.setdiff1d(np.arange(m), block[starts])
        extra = mix(mix(_U(band * 1_000_003) + empty.astype(np.uint64)))
        return np.concatenate((keys, np.sort(extra)[: keep - len(keys)]))
    return keys


def set_keys(hashes: np.ndarray, bounds: Bounds) -> np.ndarray:
    n = len(hashes)
    keep = bounds.keep(n)
    if not keep:  # it can link only with an equal set, which is its own class
        return np.empty(0, np.uint64)
    return np.concatenate([band_keys(hashes, band, bounds.blocks(band), keep + 1) for band in bounds.bands(n)])


def dense_sketch(hashes: np.ndarray) -> bytes:
    bits = np.bincount((mix(hashes ^ _MULTIPLY[4]) & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def class_of(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)) - (1 << 63)


def identified(docs: DataFrame, key: str, text: str, row: str | None) -> DataFrame:
    """(id, doc_id, text): ``row`` names a column that tells rows apart; without it rows alike in key and text share an id."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *([F.col(row).alias("id")] if row else []))
    return rows if row else rows.withColumn("id", F.xxhash64("doc_id", "text"))


def sketch(docs: DataFrame, threshold: int, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Step 1: a row per document; keys and sketches only on the first row of a class in a split."""
    schema = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("salt", pa.int32()), ("n", pa.int64()), ("cls", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("smallest", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        bounds, seen, salt = Bounds(threshold), set(), TaskContext.get().partitionId() * 7919
        for batch in c.slices(batches):
            out = []
            for i, k, t in zip(*(batch.column(x).to_pylist() for x in ("id", "doc_id", "text"))):
                h = shingles(t)
                cls, keys = class_of(h), ()
                salt += 1
                if len(h) and cls not in seen:
                    seen.add(cls)
                    keys = set_keys(h, bounds)
                if len(keys):
                    low = np.full(SMALLEST, _PAD)
                    few = np.sort(np.partition(keys, SMALLEST)[:SMALLEST] if len(keys) > SMALLEST else keys)
                    low[: len(few)] = few
                    out.append((i, k, salt % SALTS, len(h), cls, keys.view(np.int64), dense_sketch(h), low.tobytes()))
                else:
                    out.append((i, k, salt % SALTS, len(h), cls, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return c.spread(identified(docs, key, text, row)).mapInArrow(run, SKETCHED)


def shared_keys(sketched: DataFrame, partitions: int) -> DataFrame:
    """(key, cls, n) for keys that at least two classes emit; a stream over sorted rows, one row in memory."""
    rows = sketched.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "cls", F.col("n").cast("int").alias("n"))
    rows = rows.repartition(partitions, "key").sortWithinPartitions("key", "cls")

    def run(batches):
        held = last = None  # the last row seen, and the key before it
        for batch in batches:
            key, cls, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                key, cls, n = (np.concatenate(([a], b)) for a, b in zip(held, (key, cls, n)))
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, n = key[fresh], cls[fresh], n[fresh]
            same = key[1:] == key[:-1]
            use = np.zeros(len(key), bool)
            use[1:] |= same
            use[:-1] |= same
            use[0] |= last is not None and last == key[0]
            use[-1] = False  # decided when its successor is known
            held = (key[-1], cls[-1], n[-1])
            last = key[-2] if len(key) > 1 else last
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(cls[use]), pa.array(n[use].astype(np.int32))], ["key", "cls", "n"])
        if held is not None and last is not None and last == held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], ["key", "cls", "n"])

    return rows.mapInArrow(run, "key long, cls long, n int")


def _whole_groups(batches, columns: list[str]):
    """Record batches regrouped so that rows equal in ``columns`` (already adjacent) stay together."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
        if not table.num_rows:
            continue
        differs = np.zeros(table.num_rows, bool)
        for name in columns:
            x = table.column(name).to_numpy()
            differs |= x != x[-1]
        cut = np.flatnonzero(differs)
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


CANDIDATES = T.StructType().add("a", "long").add("b", "long").add("key", "long").add("classes", T.ArrayType(T.LongType())).add("bits", "binary").add("open", "binary")
_CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("classes", pa.list_(pa.int64())), ("bits", pa.binary()), ("open", pa.binary())])
_SIGN = np.uint64(1 << 63)


def candidates(shared: DataFrame, sketched: DataFrame, threshold: int, partitions: int) -> DataFrame:
    """Step 2: pairs (a < b) of classes that sizes and sketches do not exclude; or blocks.

    ``key`` (its order is that of the unsigned keys) is null for a pair that is reported once; another counts only if
    no smaller key is in both sets. A block is named by (a, b) and has ``classes`` and the pairs of their places, row by row: in
    ``bits`` those reported once, in ``open`` the others.
    """
    hot = shared.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 2 * TILE)
    tiled = shared.join(hot, "key", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("members") / TILE), F.lit(1)).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    tiled = tiled.select("key", "cls", "n", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiled = tiled.select("key", "cls", "n", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    sketches = sketched.where(F.col("sketch").isNotNull()).select("cls", "sketch", "smallest").join(shared.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("sketch").alias("sketch"), F.first("smallest").alias("smallest"))
    rows = tiled.join(sketches, "cls").repartition(partitions, "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")

    def run(batches):
        bounds = Bounds(threshold)
        for table in _whole_groups(batches, ["key", "ti", "tj"]):
            key, cls, n, tile, ti, tj = (table.column(x).to_numpy() for x in ("key", "cls", "n", "tile", "ti", "tj"))
            n = n.astype(np.int64)
            dense = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(key), -1)
            low = np.frombuffer(b"".join(table.column("smallest").to_pylist()), np.uint64).reshape(len(key), -1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])
            group = np.cumsum(new) - 1
            first = np.append(np.flatnonzero(new), len(key))
            large = np.diff(first) > 64
            mine = key.view(np.uint64)

            def fitting(at, apart):
                """Of the pairs (at, at + apart) those left, and whether each is reported here alone."""
                for s in range(0, len(at), 1 << 16):
                    i = at[s : s + (1 << 16)]
                    j = i + apart
                    fit = bounds.sizes_fit(n[i], n[j]) & ((ti[i] == tj[i]) | (tile[i] != tile[j]))
                    i, j = i[fit], j[fit]
                    fit = np.bitwise_count(dense[i] ^ dense[j]).sum(axis=1, dtype=np.int64) <= bounds.difference(n[i] + n[j])
                    i, j = i[fit], j[fit]
                    if not len(i):
                        continue
                    reporter = np.full(len(i), _PAD)
                    for x in range(low.shape[1]):
                        for y in range(low.shape[1]):
                            reporter = np.where(low[i, x] == low[j, y], np.minimum(reporter, low[i, x]), reporter)
                    fit = (reporter == _PAD) | (reporter == mine[i])
                    if fit.any():
                        yield i[fit], j[fit], reporter[fit] != _PAD

            told = (mine ^ _SIGN).view(np.int64)

            def pairs(i, j, alone):
                none = [pa.nulls(len(i), f.type) for f in list(_CANDIDATES)[3:]]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j])), pa.array(told[i], mask=alone), *none], schema=_CANDIDATES)

            apart, at = 0, np.flatnonzero(~large[group])
            while len(at):
                apart += 1
                at = at[at + apart < len(key)]
                at = at[group[at] == group[at + apart]]
                for i, j, alone in fitting(at, apart):
                    yield pairs(i, j, alone)
            for g in np.flatnonzero(large).tolist():
                start, stop = int(first[g]), int(first[g + 1])
                hit = _group_pairs(cls[start:stop], n[start:stop], dense[start:stop], low[start:stop], mine[start], tile[start:stop] if ti[start] != tj[start] else None, bounds)
                # Parts of bounded numbers of shingles, and each pair of parts.
                part = np.cumsum(n[start:stop]) // VERIFY_SHINGLES
                for x in np.unique(part).tolist():
                    for y in np.unique(part[part >= x]).tolist():
                        some = hit * ((part == x)[:, None] & (part == y)[None, :]) if part[-1] else hit
                        used = np.flatnonzero(some.any(axis=0) | some.any(axis=1))
                        if np.count_nonzero(some) < DENSE * len(used):
                            i, j = np.nonzero(some)
                            if len(i):
                                yield pairs(i + start, j + start, some[i, j] == 1)
                        elif len(used):
                            name = np.array([key[start], ti[start], tj[start], x, y], np.int64).tobytes()
                            some = some[np.ix_(used, used)]
                            block = [[_signed(name, 1)], [_signed(name, 2)], [int(told[start])], [cls[start + used]], *[[np.packbits(some == v, axis=None).tobytes()] for v in (1, 2)]]
                            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(block, _CANDIDATES)], schema=_CANDIDATES)

    return rows.mapInArrow(run, CANDIDATES)


def _group_pairs(cls, n, dense, low, key, tile, bounds: Bounds) -> np.ndarray:
    """The pairs (upper triangle) of a large group that are left: 1 where one is reported here alone, 2 where it is open."""
    m = len(cls)
    left = np.triu(bounds.sizes_fit(n[:, None], n[None, :]), 1)
    if tile is not None:
        left &= tile[:, None] != tile[None, :]
    # Pairs with a smaller key that both list are reported there.
    values, place, count = np.unique(low, return_inverse=True, return_counts=True)
    smaller = (count > 1) & (values < key)
    use = np.flatnonzero(smaller[place.reshape(-1)])
    of, row = place.reshape(-1)[use], use // low.shape[1]
    order = np.argsort(of, kind="stable")
    for rows in np.split(row[order], np.flatnonzero(np.diff(of[order])) + 1):
        left[np.ix_(rows, rows)] = False
    listed = (low == key).any(axis=1)
    out = np.zeros((m, m), np.uint8)
    i, j = np.nonzero(left)
    for s in range(0, len(i), 1 << 16):
        x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        fit = np.bitwise_count(dense[x] ^ dense[y]).sum(axis=1, dtype=np.int64) <= bounds.difference(n[x] + n[y])
        x, y = x[fit], y[fit]
        out[x, y] = np.where(listed[x] & listed[y], 1, 2)
    return out


def _signed(data: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, seed=seed) - (1 << 63)


def chosen_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the rows (id, doc_id, text) in ``wanted`` (id), once each, and of a few others.

    Only these texts are exchanged afterwards: a bit set of the wanted ids' hashes, of at most ``MOST_BITS`` bits
    (16 MB) whatever the input, goes to the tasks, and texts whose bit is clear stop there. The caller's join drops the others.
    """
    bits = 1 << 16
    n = wanted.count()
    while bits < 32 * n and bits < MOST_BITS:
        bits *= 2
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def choose(batches):
        table = shared.value
        for batch in batches:
            at = batch.column("p").to_numpy().astype(np.uint64)
            hit = np.flatnonzero((table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1))
            if len(hit):
                some = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("text")], ["id", "text"])

    found = rows.select("id", "text", place.alias("p")).mapInArrow(choose, "id long, text string")
    return found.groupBy("id").agg(F.first("text").alias("text"))


def verified(found: DataFrame, rows: DataFrame, classes: DataFrame, threshold: int, partitions: int) -> DataFrame:
    """Step 3. ``found``: candidates; ``classes``: (cls, id of one of its rows, n, rows) of every class.

    Rows (a, b, null) are links; rows (a, b, others) say that ``others`` documents link with class a, which is in a component with class b.
    """
    pairs = c.staged(found.where(F.col("bits").isNull()).groupBy("a", "b").agg(F.min("key").alias("key")), "parity-distinct")
    blocks = found.where(F.col("bits").isNotNull())
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("cls"), F.least("a", "low").alias("label"))
    nodes = nodes.join(classes.select("cls", "n"), "cls")
    # Sets that share their smallest neighbour lie in the same tile; a label with many shingles or sets gets many tiles.
    sizes = nodes.groupBy("label").agg(F.greatest(F.sum("n") / VERIFY_SHINGLES, F.count(F.lit(1)) / VERIFY_SETS).alias("tiles"))
    spread = F.pmod(F.xxhash64("cls"), F.ceil("tiles").cast("long"))
    tiles = c.staged(nodes.join(sizes, "label").select("cls", F.xxhash64("label", spread).alias("tile")), "parity-nodes")
    placed = pairs.join(tiles.withColumnsRenamed({"cls": "a", "tile": "ta"}), "a").join(tiles.withColumnsRenamed({"cls": "b", "tile": "tb"}), "b")
    placed = c.staged(placed.select("a", "b", "key", F.xxhash64(F.least("ta", "tb"), F.greatest("ta", "tb")).alias("task")), "parity-pairs")

    members = placed.select(F.col("task").alias("ta"), F.lit(0).cast("long").alias("tb"), F.explode(F.array("a", "b")).alias("cls")).distinct()
    members = members.unionByName(blocks.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.explode("classes").alias("cls")))
    members = c.staged(members.join(classes.select("cls", "id", "rows"), "cls"), "parity-members")
    texts = chosen_texts(rows, members.select("id").distinct())
    null = lambda kind: F.lit(None).cast(kind)
    sent = members.join(texts, "id").select("ta", "tb", F.lit(0).alias("kind"), F.col("cls").alias("a"), F.col("rows").alias("b"), "text", null("long").alias("key"), null("array<long>").alias("classes"), null("binary").alias("bits"), null("binary").alias("open"))
    asked = placed.select(F.col("task").alias("ta"), F.lit(0).cast("long").alias("tb"), F.lit(1).alias("kind"), "a", "b", null("string").alias("text"), "key", null("array<long>").alias("classes"), null("binary").alias("bits"), null("binary").alias("open"))
    whole = blocks.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), null("string").alias("text"), "key", "classes", "bits", "open")
    work = sent.unionByName(asked).unionByName(whole).repartition(partitions, "ta", "tb").sortWithinPartitions("ta", "tb", "kind")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("others", pa.int64())])

    def check(batches):
        held: dict[int, np.ndarray] = {}
        weight: dict[int, int] = {}
        current, asked_pairs = None, []

        def done():
            a, b = linked(held, np.concatenate([x for x, _ in asked_pairs]), threshold, pa.concat_arrays([x for _, x in asked_pairs]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)

        for batch in c.slices(batches, 4096):
            ta, tb, kind, a, b = (batch.column(i).to_numpy() for i in range(5))
            change = np.flatnonzero((ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, stop in zip([0, *change.tolist()], [*change.tolist(), len(ta)]):
                task = int(ta[start]), int(tb[start])
                if task != current:
                    if asked_pairs:
                        yield from done()
                    held, weight, asked_pairs, current = {}, {}, [], task
                if kind[start] == 0:
                    for k, w, t in zip(a[start:stop].tolist(), b[start:stop].tolist(), batch.column("text").slice(start, stop - start).to_pylist()):
                        held[int(k)], weight[int(k)] = shingles(t), int(w)
                elif kind[start] == 1:
                    part = batch.slice(start, stop - start)
                    asked_pairs.append((np.stack([part.column(x).to_numpy() for x in "ab"], axis=1), part.column("key")))
                else:
                    part = batch.slice(start, stop - start)
                    for block in zip(*(part.column(x).to_pylist() for x in ("classes", "bits", "open", "key"))):
                        rows = block_links(held, weight, *block, threshold)
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)
        if asked_pairs:
            yield from done()

    return work.mapInArrow(check, "a long, b long, others long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles that each two sets share: a product of 0/1 matrices, a slice of the shingles at a time."""
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # those of one set alone cannot be shared
    column = (np.cumsum(shared) - 1)[place]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    use = shared[place]
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, min((4 << 20) // len(sets), int(shared.sum())))
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        common += x @ x.T
    return common


def block_links(held: dict[int, np.ndarray], weight: dict[int, int], names: list[int], bits: bytes, unsure: bytes, key: int, threshold: int) -> list[tuple[int, int, int]]:
    """(class, smallest class of its component in the block, documents linked) for each class of a block that links."""
    n = len(names)
    asked, more = (np.unpackbits(np.frombuffer(x, np.uint8), count=n * n).reshape(n, n).astype(bool) for x in (bits, unsure))
    if more.any():
        bounds, least = Bounds(threshold), _U(key + (1 << 63))
        keys = [set_keys(held[k], bounds) for k in names]
        asked |= more & (common_counts([x[x < least] for x in keys]) == 0)
    common, size = common_counts([held[k] for k in names]), np.array([len(held[k]) for k in names])
    good = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        k = common[at : at + 256].astype(np.int64)
        good[at : at + 256] = asked[at : at + 256] & (100 * k >= threshold * (size[at : at + 256, None] + size[None, :] - k))
    good |= good.T
    others = good @ np.array([weight[k] for k in names], np.int64)
    out, open_ = [], good.any(axis=1)
    for start in sorted(range(n), key=names.__getitem__):
        if open_[start]:
            seen = np.zeros(n, bool)
            seen[start] = True
            edge = seen
            while edge.any():
                edge = good[edge].any(axis=0) & ~seen
                seen = seen | edge
            out += [(names[i], names[start], int(others[i])) for i in np.flatnonzero(seen).tolist()]
            open_ &= ~seen
    return out


def linked(sets: dict[int, np.ndarray], pairs: np.ndarray, threshold: int, told: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (rows of a, b) whose sets reach the threshold, and which no key below the one ``told`` has in both
    sets; one matrix product where many pairs meet few sets."""
    names = np.array(sorted(sets), np.int64)
    size = np.array([len(sets[k]) for k in names.tolist()], np.int64)
    i, j = (np.searchsorted(names, pairs[:, x]) for x in (0, 1))
    if len(pairs) <= 2 * len(names) or len(names) > 2 * VERIFY_SETS:
        ordered = [sets[k] for k in names.tolist()]
        common = np.fromiter((len(np.intersect1d(ordered[x], ordered[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())), np.int64, len(pairs))
    else:
        common = common_counts([sets[k] for k in names.tolist()])[i, j].astype(np.int64)
    good = 100 * common >= threshold * (size[i] + size[j] - common)
    if told is not None and told.null_count < len(told):
        bounds, keys, least = Bounds(threshold), {}, told.to_pylist()
        for x in np.flatnonzero(good & told.is_valid().to_numpy(zero_copy_only=False)).tolist():
            a, b = (keys[k] if k in keys else keys.setdefault(k, set_keys(sets[k], bounds)) for k in pairs[x].tolist())
            good[x] = np.intersect1d(a, b).min() >= _U(least[x] + (1 << 63))
    return pairs[good, 0], pairs[good, 1]


def _classified(docs: DataFrame, threshold: int, key: str, text: str, row: str | None) -> DataFrame:
    """A row per document: id, doc_id, n, n_similar, component_id, class_id, and the row ``stays`` of its component."""
    sketched = c.staged(sketch(docs, threshold, key, text, row), "parity-sketches")
    partitions = max(c.parts_for(docs), -(-4 * c.plan_bytes(docs) // (128 << 20)))
    shared = c.staged(shared_keys(sketched, partitions), "parity-shared")
    found = c.staged(candidates(shared, sketched, threshold, partitions), "parity-candidates")

    rows = sketched.select("id", "doc_id", "n", "cls", "salt")
    # Counted per salt first; both the classes and the way back to the rows come from this. Of ``best`` the key is ``low``.
    local = c.staged(rows.where(F.col("n") > 0).groupBy("cls", "n", "salt").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("low"), F.min_by("id", "doc_id").alias("best"), F.min("id").alias("id")), "parity-classes")
    classes = local.groupBy("cls").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.min_by("best", "low").alias("best"), F.min("id").alias("id"), F.max("n").alias("n"))
    links = c.staged(verified(found, identified(docs, key, text, row), classes, threshold, partitions), "parity-links")
    plain = links.where(F.col("others").isNull()).select("a", "b")
    both = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(classes.select(F.col("cls").alias("b"), "rows"), "b").groupBy("a").agg(F.sum("rows").alias("others"))
    degrees = counted.unionByName(links.where(F.col("others").isNotNull()).select("a", "others")).groupBy("a").agg(F.sum("others").alias("others")).withColumnRenamed("a", "cls")
    named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")
    known = classes.join(degrees, "cls", "left").join(named, "cls", "left")
    known = c.staged(known.select("cls", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), "low", "best", "id", "component"), "parity-known")
    whole = known.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("low").alias("c_low"), F.min_by("best", "low").alias("c_best"), F.min("id").alias("c_id"))
    answers = known.join(whole, "component", "left").select(
        "cls",
        "n_similar",
        F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("c_low")).alias("component_id"),
        F.col("low").alias("class_id"),
        F.when(F.col("component").isNull(), F.coalesce("best", "id")).otherwise(F.coalesce("c_best", "c_id")).alias("stays"),
    )
    joined = rows.join(local.select("cls", "salt").join(answers, "cls"), ["cls", "salt"], "left")
    own = F.col("n") == 0
    return joined.select("id", "doc_id", "n", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), *[F.when(own, F.col("doc_id")).otherwise(F.col(x)).alias(x) for x in ("component_id", "class_id")], F.when(own, F.col("id")).otherwise(F.col("stays")).alias("stays"))


def near_duplicates(docs: DataFrame, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, n_similar (documents linked directly), component_id, class_id."""
    return _classified(docs, threshold, key, text, None).select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id", "class_id")


def keep_one(docs: DataFrame, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only one row of each component: that of the smallest key, one of them if it comes again, any one if no key is there.

    Rows get numbers in a written table, so that those alike in everything are told apart.
    """
    number = "row_number"
    while number in {x.lower() for x in docs.columns}:
        number = "_" + number
    numbered = c.staged(docs.withColumn(number, F.monotonically_increasing_id()), "parity-rows")
    dropped = _classified(numbered, threshold, key, text, number).where(F.col("id") != F.col("stays")).select(F.col("id").alias(number))
    return numbered.join(dropped, number, "left_anti").select(*[numbered[f"`{x}`"] for x in docs.columns])


def op8_parity_join(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents at a Jaccard similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")
