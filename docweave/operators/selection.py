"""Row selection: append and overwrite modes, keys, limits, skip sets, file rules and projections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.answers import truthy
from ..functions.text import file_dir, file_name, file_stem, file_suffix

# Columns of inputs.


def parse_input(spec: str) -> tuple[str, int | None]:
    """``column:limit`` at the first colon; a limit that is not a positive number is none."""
    name, _, limit = spec.partition(":")
    limit = limit.strip()
    return name.strip(), int(limit) if re.fullmatch(r"[1-9]\d*", limit) else None


def parse_slice(spec: str) -> tuple[str, int | None, int | None]:
    """The older ``column[a:b]``."""
    m = re.fullmatch(r"\s*(.+?)\[(-?\d*):(-?\d*)\]\s*", spec)
    return (m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None) if m else (spec.strip(), None, None)


def sliced(text: Column, start: int | None, stop: int | None) -> Column:
    """Characters from ``start`` up to ``stop``; negative places count from the end."""
    n = F.length(text)
    at = lambda x, default: default if x is None else (F.greatest(n + x, F.lit(0)) if x < 0 else F.lit(x))
    a, b = at(start, F.lit(0)), at(stop, n)
    return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))


def limited(df: DataFrame, column: str, limit: int | None) -> Column:
    """Text of a column, cut to ``limit`` characters; '' for null or a column that is not there."""
    names = {x: x for x in df.columns}
    found = names.get(column) or names.get(column.rpartition(".")[2])
    if found is None:
        return F.lit("")
    text = F.coalesce(df[f"`{found}`"].cast("string"), F.lit(""))
    return F.substring(text, 1, limit) if limit else text


def with_limits(df: DataFrame, inputs: list[str]) -> DataFrame:
    """Only the input columns, as limited text."""
    return df.select(*[limited(df, *parse_input(x)).alias(parse_input(x)[0]) for x in inputs])


# Modes.


def select_rows(df: DataFrame, mode: str = "append", output: str | None = None, where: str | None = None, key: dict | None = None, limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """The rows a task works on.

    ``append`` takes rows whose output is null, ``overwrite`` all. A ``key`` (one column and value) replaces every other
    filter and excludes a limit. Rows are put in order and cut; a limit of 0 gives none.
    """
    if key is not None:
        if limit is not None:
            raise ValueError("a key and a limit exclude each other")
        (name, value), = key.items()
        return df.where(F.col(name) == F.lit(value))
    if where:
        df = df.where(where)
    if mode == "append" and output and output in df.columns:
        df = df.where(F.col(output).isNull())
    elif mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    return df if limit is None else df.orderBy(order).limit(limit)


def skip_done(df: DataFrame, audit: DataFrame, task: str, model: str, key: str = "sha1", output: DataFrame | None = None, direct: str | None = None, retry_failed: bool = False) -> DataFrame:
    """Rows without an attempt on record for this task and model, and without a stored result.

    Anti-joins: null keys match nothing, so such rows are never skipped. ``retry_failed`` lets failed attempts pass.
    """
    done = audit.where((F.col("enrichment_name") == task) & (F.col("model_used") == model))
    if retry_failed:
        done = done.where(F.col("error").isNull())
    df = df.join(done.select(F.col("sha1").alias("_done")).distinct(), df[key] == F.col("_done"), "left_anti")
    if output is not None:
        have = output.where(F.col("model_used") == model) if "model_used" in output.columns else output
        df = df.join(have.select(F.col(key).alias("_have")).distinct(), df[key] == F.col("_have"), "left_anti")
    if direct:
        df = df.where(~truthy(F.col(direct), dict(df.dtypes)[direct]))
    return df


def require(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which every named field is truthy and, as text, not blank."""
    kinds = dict(df.dtypes)
    tests = [truthy(F.col(f), kinds[f]) & (F.length(F.trim(F.col(f).cast("string"))) > 0) if kinds[f] == "string" else truthy(F.col(f), kinds[f]) for f in fields]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def first_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row per key, the first in ``order``; one exchange with partial aggregation, no window over a hot key.

    ``order`` must tell rows apart. Rows with a null key count as one group.
    """
    rest = [c for c in df.columns if c != key]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def add_sha1(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("sha1", F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def new_documents(df: DataFrame, known: DataFrame, key: str = "sha1", overwrite: bool = False) -> DataFrame:
    """Rows whose key is not known yet; all of them when overwriting."""
    return df if overwrite else df.join(known.select(F.col(key).alias("_known")).distinct(), df[key] == F.col("_known"), "left_anti")


# File rules.

_SYNC = [".dropbox", ".onedrive", ".sync", "FolderType", "Icon\r", "IgnoreList", "StreamsList", "conflict"]
_SYSTEM = ["desktop.ini", "Thumbs.db", ".DS_Store"]
_SUFFIXES = (
    "7z aac apk avi bz2 deb dll dylib exe flac flv gz iso m4a m4v mkv mov mp3 mp4 mpeg mpg ogg opus rar rpm so tar wav webm wma wmv xz zip"
).split()
_LEVELS = "DEBUG|ERROR|INFO|WARNING"


def skip_file(path: Column, text: Column | None = None) -> Column:
    """Hidden, system, synchronisation, media, archive, binary and log files."""
    name, suffix, stem = file_name(path), file_suffix(path), F.lower(file_stem(path))
    sync = reduce(lambda a, b: a | b, [name.contains(x) for x in _SYNC])
    skip = name.startswith(".") | name.isin(_SYSTEM) | sync | file_dir(path).rlike(r"(^|/)\.sync") | suffix.isin(["." + x for x in _SUFFIXES])
    skip = skip | stem.rlike(r"\.log|_log|-log|logfile|log$")
    if text is not None:
        head = F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n")
        skip = skip | (suffix.isin(".log", ".txt") & head.rlike(r"\d{4}-\d{2}-\d{2}") & head.rlike(_LEVELS))
    return F.coalesce(skip, F.lit(True))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression over a whole name."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in "!]") + 0)) > i:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[:1] == "!" else f"[{body}]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + "$"


def file_globs(path: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Base names that some include pattern fits and no exclude pattern; both are comma lists."""
    name = file_name(path)
    any_of = lambda spec: reduce(lambda a, b: a | b, [name.rlike(glob_regex(p.strip())) for p in spec.split(",") if p.strip()], F.lit(False))
    good = any_of(include) if include and include.strip() else F.lit(True)
    return good & ~any_of(exclude) if exclude and exclude.strip() else good


_OVERRIDES = ("good", "ocr", "manual")


def manual_overrides(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Each document with the text of its side file, if one of over 50 characters exists: good, then ocr, then manual.

    Side files (``stem--good.txt`` and so on) are matched by folder and stem, and are no documents themselves.
    """
    stem, folder = file_stem(F.col(path)), file_dir(F.col(path))
    kind = F.regexp_extract(file_name(F.col(path)), r"^.+--(good|ocr|manual)\.txt$", 1)
    side = files.withColumn("_kind", kind).where((F.col("_kind") != "") & (F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")) > 50))
    rank = reduce(lambda acc, k: F.when(F.col("_kind") == k[1], k[0]).otherwise(acc), enumerate(_OVERRIDES), F.lit(9))
    best = side.select(folder.alias("_dir"), F.regexp_replace(stem, "--(good|ocr|manual)$", "").alias("_stem"), rank.alias("_rank"), F.col(text).alias("_text")).groupBy("_dir", "_stem").agg(F.min_by("_text", "_rank").alias("_text"))
    docs = files.withColumn("_kind", kind).where(F.col("_kind") == "").drop("_kind")
    joined = docs.join(best, (file_dir(F.col(path)) == F.col("_dir")) & (file_stem(F.col(path)) == F.col("_stem")), "left")
    return joined.select(*[F.coalesce("_text", F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns], F.col("_text").isNotNull().alias("overridden"))


# Metadata.

_KEEP = (
    "Content-Length Content-Type Creation-Date Last-Modified Message:Raw-Header:Snapshot-Content-Location Source X-Parsed-By author content_type created "
    "creator date dc:creator dc:subject dc:title dcterms:created dcterms:modified extraction_method file_type keywords language mhtml_boundary mhtml_date "
    "mhtml_from mhtml_subject mhtml_subject_decoded mime_version modified ocr_applied ocr_attempted ocr_failed ocr_file_path ocr_languages "
    "original_file_path original_file_type original_url processing_method resourceName save_date source source_url subject text_quality_issue title url"
).split()
_PARTS = "author|content|creator|date|mhtml_|ocr_|source|title|url"


def allowed_metadata(metadata: Column) -> Column:
    """Entries with a listed key, or whose key speaks of dates, titles, authors, sources or contents."""
    return F.map_filter(metadata, lambda k, _: k.isin(_KEEP) | F.lower(k).rlike(_PARTS))


def merge_metadata(extracted: Column, manifest: Column) -> Column:
    """Both maps; the manifest wins, and is not filtered."""
    none = F.create_map().cast("map<string,string>")
    extracted, manifest = F.coalesce(extracted, none), F.coalesce(manifest, none)
    return F.map_concat(F.map_filter(extracted, lambda k, _: ~F.map_contains_key(manifest, k)), manifest)


def document_columns(df: DataFrame, metadata: str = "metadata", keys: list[str] | None = None) -> DataFrame:
    """The document's columns, then one text column ``metadata_<key>`` per key, '' where it is missing."""
    base = [c for c in df.columns if c != metadata]
    return df.select(*base, *[F.coalesce(F.try_element_at(F.col(metadata), F.lit(k)), F.lit("")).alias("metadata_" + re.sub(r"\W", "_", k)) for k in keys or []])


def newest(df: DataFrame, n: int, by: str = "created_at", tie: str = "enrichment_id") -> DataFrame:
    """The last ``n`` rows, newest first."""
    return df.orderBy(F.desc(by), F.desc(tie)).limit(n)


def latest_per(df: DataFrame, keys: list[str], by: str = "created_at", tie: str = "enrichment_id") -> DataFrame:
    """The newest row of each key; one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def best_file(files: DataFrame, key: str = "doi", score: str = "validation_score", kind: str = "file_type", tie: str = "path") -> DataFrame:
    """The best usable file of each key: PDF before MHTML before others, then the higher score (null last).

    Scores below 3 and paths marked as failed are out.
    """
    usable = files.where((F.col(score) >= 3) | F.col(score).isNull()).where(~F.col(tie).contains("--FAILED"))
    rank = F.when(F.col(kind) == "pdf", 1).when(F.col(kind) == "mhtml", 2).otherwise(3)
    w = Window.partitionBy(key).orderBy(rank, F.desc_nulls_last(score), tie)
    return usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
