r"""Secret scan: fixed patterns, then randomness tests with length-aware control of false discoveries.

Patterns (always reported): ``assign``, ``access`` and ``hex``. Beyond them every long run of key characters is
a candidate if one alphabet has all of them, and so is every long part of it between separators, as a key may stand in
a path or beside words. Of candidates that overlap, the run goes before its parts. A candidate's encoding is inferred from the characters it uses, and three tests ask whether it could
be uniform noise in that alphabet: chi-squared of the letter counts, Wald-Wolfowitz runs about the alphabet's
middle, and lag-one serial correlation. Fisher's method joins them into one p-value, which is uniform for
true keys and near 0 for words and identifiers.

The tests have less power on short strings, so the cut is set per encoding and length class from the whole
corpus: with the p-values' histogram, Storey's estimate of the random share says how many of those at or above
a cut are noise, and the lowest cut whose estimated false-discovery rate is within ``alpha`` is taken. Joint p-values of
uniform strings are not quite uniform (the tests are asymptotic and share their input), so the null is the histogram of
simulated strings of the same alphabet and length. No candidate with a p-value below 0.01 is reported. A class of few
candidates borrows from the lengths next to it, then from the other encodings; where all that is too little for a good estimate,
none below 0.05 is reported, and all from 0.5 are. The histogram counts distinct strings. Only
that histogram (encodings x length classes x bins, a fixed number of rows) reaches the driver.

Defined results: a null key stays null; a null or empty text has no span; texts of any length are scanned whole; equal texts get
equal spans; an empty table gives no row. Only key and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _common as c

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets from the most special to the most general.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    # For letters or digits alone, which are many words and numbers and few keys.
    ("digits", "0123456789"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
)
#: Where a run is parted, in order of preference: paths, words around base64, everything.
_SPLITS = [re.compile(f"[^{x}]{{20,}}") for x in ("/", "_-", "/+_-")]
_SETS = [(n, frozenset(a), {ch: i for i, ch in enumerate(a)}) for n, a in ENCODINGS]
_ALONE = [n for n, _ in ENCODINGS].index("digits")
BINS = 200
#: Bins below which nothing is reported: p-values under 0.01, under 0.05 where candidates are few.
FLOOR, THIN_FLOOR = 2, 10
#: Distinct candidates from which a cell stands for itself.
ENOUGH = 200
SPAN = T.StructType().add("start", "integer").add("kind", "integer").add("end", "integer")
CANDIDATE = T.StructType().add("start", "integer").add("end", "integer").add("cell", "integer").add("bin", "integer").add("hash", "long")
SCAN = T.StructType().add("doc_id", "long").add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("base", T.ArrayType(SPAN)).add("candidates", T.ArrayType(CANDIDATE))


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in _LONG.finditer(text) if runs is None else runs:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, run.start(), run.end())]
    return sorted(out)


def infer(value: str) -> int | None:
    """Number of the most special encoding with these characters, None if no one alphabet has them."""
    used = set(value.rstrip("="))
    alone = all(x.isdigit() for x in used) or all(x.isalpha() for x in used)
    return next((i for i, (_, letters, _) in enumerate(_SETS) if (i >= _ALONE) == alone and used <= letters), None)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(statistic: float, df: int) -> float:
    """Upper tail by Wilson and Hilferty's cube root."""
    v = 2 / (9 * df)
    return _upper_normal(((max(statistic, 0) / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def battery(value: str, encoding: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation, were ``value`` uniform in its alphabet."""
    place = _SETS[encoding][2]
    x = [place[ch] for ch in value.rstrip("=")]
    n, size = len(x), len(place)
    counts = [0] * size
    for v in x:
        counts[v] += 1
    uniform = chi_squared_p(sum(k * k for k in counts) * size / n - n, size - 1)
    high = [2 * v >= size for v in x]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = 2 * _upper_normal(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = 2.0 ** (1 - n)
    m = sum(x) / n
    total = sum((v - m) ** 2 for v in x)
    serial = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / total if total else 1.0
    serial_p = 2 * _upper_normal(abs(serial + 1 / n) * math.sqrt(n))
    return uniform, min(1.0, runs_p), min(1.0, serial_p)


def joint_p(ps: tuple[float, ...]) -> float:
    """Fisher's method; the tail of chi-squared with 6 degrees has a closed form."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(ps)))


def length_class(n: int) -> int:
    """Classes a quarter of an octave wide, from 20 characters; the last is open."""
    return min(15, int(4 * math.log2(n / 20)))


def parts(run: re.Match) -> list[tuple[int, int]]:
    """Places of the run and its parts, those first that are preferred."""
    start, value = run.start(), run[0].rstrip("=")
    found = dict.fromkeys([run.span()])
    if not value.isalnum():
        # The last part has the padding.
        found |= dict.fromkeys((start + m.start(), run.end() if m.end() == len(value) else start + m.end()) for split in _SPLITS for m in split.finditer(value))
    return list(found)


def candidates(text: str, runs: list[re.Match]) -> list[tuple[int, int, int, int, int]]:
    out = []
    for run in runs:
        for start, end in parts(run):
            value = text[start:end]
            encoding = infer(value)
            if encoding is not None:
                p = joint_p(battery(value, encoding))
                digest = hashlib.blake2b(value.encode(), digest_size=8).digest()
                out.append((start, end, encoding * 16 + length_class(len(value)), min(BINS - 1, int(p * BINS)), int.from_bytes(digest, "big", signed=True)))
    return out


def chosen(base: list[tuple[int, int]], random: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The random spans, in order of preference, that overlap neither a fixed pattern nor one chosen before."""
    starts, ends = [], []
    for a, b in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for a, b in random:
        at = bisect.bisect_right(ends, a)
        if at == len(starts) or starts[at] >= b:
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((a, b))
    return sorted(out)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and tested candidates of every text, in one pass without an exchange."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cell", pa.int32()), ("bin", pa.int32()), ("hash", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", span), ("candidates", candidate)])

    def run(batches):
        for batch in c.slices(batches):
            out = []
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                runs = list(_LONG.finditer(t))
                spans = base_spans(t, runs)
                digest = hashlib.sha256(",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans).encode()).hexdigest()
                n = [sum(s[1] == i for s in spans) for i in range(3)]
                out.append((k, *n, digest, [dict(zip(("start", "kind", "end"), s)) for s in spans], [dict(zip(("start", "end", "cell", "bin", "hash"), s)) for s in candidates(t, runs)]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return c.spread(rows).mapInArrow(run, SCAN)


def pooled(histogram: dict[int, list[int]]) -> dict[int, list[int]]:
    """Per cell its counts, with those of cells near by until they are ``ENOUGH``: lengths first, then encodings."""
    out = {}
    for cell, counts in histogram.items():
        encoding, length = divmod(cell, 16)
        # Words of letters alone say nothing about the other encodings.
        alike = [x for x in histogram if x // 16 != encoding and (x // 16 >= _ALONE) == (encoding >= _ALONE)]
        rings = [[encoding * 16 + x for x in {length - d, length + d} if 0 <= x < 16] for d in range(1, 16)] + [alike]
        for ring in rings:
            if sum(counts) >= ENOUGH:
                break
            counts = [sum(x) for x in zip(counts, *[histogram[x] for x in ring if x in histogram])]
        out[cell] = counts
    return out


@functools.cache
def null_tail(cell: int, rows: int = 4000) -> tuple[float, ...]:
    """Share of uniform strings of a cell's alphabet and length whose p-value is in bin b or above, for each b; by simulation."""
    import numpy as np

    encoding, length = divmod(cell, 16)
    size, n = len(ENCODINGS[encoding][1]), int(20 * 2 ** ((length + 0.5) / 4))
    x = np.random.default_rng(cell).integers(0, size, (rows, n))
    counts = np.stack([np.bincount(r, minlength=size) for r in x])
    high = 2 * x >= size
    up = high.sum(axis=1)
    mean = 2 * up * (n - up) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    d = x - x.mean(axis=1, keepdims=True)
    serial = (d[:, 1:] * d[:, :-1]).sum(axis=1) / (d * d).sum(axis=1)
    bins = np.zeros(BINS)
    for i in range(rows):
        uniform = chi_squared_p(float((counts[i].astype(float) ** 2).sum()) * size / n - n, size - 1)
        runs_p = 2 * _upper_normal(abs(runs[i] - mean[i]) / math.sqrt(var[i])) if var[i] > 0 else 1.0
        p = joint_p((uniform, min(1.0, runs_p), min(1.0, 2 * _upper_normal(abs(serial[i] + 1 / n) * math.sqrt(n)))))
        bins[min(BINS - 1, int(p * BINS))] += 1
    return tuple((bins[::-1].cumsum()[::-1] / rows).tolist())


def cuts(histogram: dict[int, list[int]], alpha: float, null=null_tail) -> dict[int, int]:
    """Per cell the lowest bin from which candidates count as random."""
    out = {}
    for cell, counts in pooled(histogram).items():
        tail, half = null(cell), BINS // 2
        upper = sum(counts[half:])
        strings = upper / max(tail[half], 1e-9)  # random ones in all
        thin = sum(counts) < ENOUGH  # for an estimate
        flagged, best = 0, half if thin else BINS
        for b in range(BINS - 1, (THIN_FLOOR if thin else FLOOR) - 1, -1):
            flagged += counts[b]
            if flagged and 1 - min(1.0, strings * tail[b] / flagged) <= alpha:
                best = min(best, b)
        out[cell] = best
    return out


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.05) -> DataFrame:
    """doc_id, counts and digest of base spans, and ``found``: array of (start, kind, end), with the random ones."""
    scanned = c.staged(scan(docs, key, text), "secrets")
    rows = scanned.where(F.size("candidates") > 0).select(F.explode("candidates").alias("x")).select("x.cell", "x.bin", "x.hash").distinct().groupBy("cell", "bin").count().collect()  # a fixed number of cells and bins
    histogram: dict[int, list[int]] = {}
    for cell, b, n in rows:
        histogram.setdefault(cell, [0] * BINS)[b] = n
    cut = cuts(histogram, alpha)
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    schema = T.StructType([*[SCAN[x] for x in columns], T.StructField("found", T.ArrayType(SPAN))])
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in c.slices(batches):
            out = []
            for base, tested in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
                random = [(x["start"], x["end"]) for x in tested if x["bin"] >= cut[x["cell"]]]
                more = chosen([(x["start"], x["end"]) for x in base], random) if random else []
                out.append(sorted(base + [{"start": a, "kind": 3, "end": b} for a, b in more], key=lambda x: (x["start"], x["kind"], x["end"])))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in columns], pa.array(out, span)], [*columns, "found"])

    return scanned.mapInArrow(run, schema)


def rendered(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_battery(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", rendered(F.col("found")).alias("spans"))
