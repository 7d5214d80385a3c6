"""Folders of documents as tables: listing, rules, hashing, extraction, metadata, new rows only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import clean_lines, file_name, file_suffix
from ..operators.selection import allowed_metadata, file_globs, first_per_key, merge_metadata, skip_file
from . import extract as _extract

MANIFEST = "manifest.json"


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content of every file below ``path`` (or of the one file).

    Names that start with a dot or an underscore are not listed; Spark takes them for its own.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, metadata) from a JSON object of objects of scalars."""
    import json

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file that a person wrote
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError(f"the manifest is not JSON: {e}") from e
    if not isinstance(data, dict):
        raise ValueError("a manifest is an object of file names")
    for name, entry in data.items():
        if not isinstance(entry, dict):
            raise ValueError(f"manifest entry {name} is not an object")
        for k, v in entry.items():
            if isinstance(v, (dict, list)):
                raise ValueError(f"manifest entry {name}: {k} is not a scalar")
    shown = lambda v: "" if v is None else str(v)
    rows = [(n, {k: shown(v) for k, v in e.items()}) for n, e in data.items()]
    return spark.createDataFrame(rows, "filename string, metadata map<string,string>")


def find_manifest(folder: str) -> str | None:
    """The manifest in the input's root, if there is one; on any file system."""
    from pyarrow import fs

    if "://" not in folder:
        at = os.path.join(folder, MANIFEST)
        return at if os.path.isfile(at) else None
    system, at = fs.FileSystem.from_uri(folder)
    return f"{folder.rstrip('/')}/{MANIFEST}" if system.get_file_info(f"{at.rstrip('/')}/{MANIFEST}").type == fs.FileType.File else None


def read_bytes(path: str) -> bytes:
    """A file's bytes, on whatever file system, from inside a task."""
    import re

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with system.open_input_file(at) as f:
        return f.read()


def extracted(files: DataFrame, html: str = "default") -> DataFrame:
    """Adds content, error and the metadata found in the file; one pass, a file at a time where ``files`` has no content but paths."""
    smart = html == "smart"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors, metas = [], [], []
            for i, (suffix, path) in enumerate(zip(pdf["suffix"], pdf["path"])):
                meta: dict[str, str] = {}
                data = pdf["content"][i] if "content" in pdf else read_bytes(path)
                if suffix in (".html", ".htm", ".mhtml", ".mht"):
                    try:
                        page = _extract.mhtml_html(data) if suffix.startswith(".mht") else _extract.decode_bytes(data)
                        meta = _extract.mhtml_metadata(data) if suffix.startswith(".mht") else {}
                        meta["title"] = _extract.html_title(page)
                        text = _extract.html_smart(page) if smart or suffix.startswith(".mht") else _extract.html_text(page)
                        error = None if text.strip() else "no text in it"
                        text = text if error is None else None
                    except Exception as e:  # noqa: BLE001 - a bad file is a row with an error
                        text, error = None, f"{type(e).__name__}: {e}"
                else:
                    text, error = _extract.extract(suffix, data, path)
                texts.append(text)
                errors.append(error)
                metas.append({k: str(v) for k, v in meta.items() if v})
            yield pd.DataFrame({"sha1": pdf["sha1"], "path": pdf["path"], "modified": pdf["modified"], "text": texts, "error": errors, "metadata": metas})

    rows = files.select("sha1", "path", F.col("modificationTime").alias("modified"), file_suffix(F.col("path")).alias("suffix"), *[x for x in ("content",) if x in files.columns])
    return rows.mapInPandas(run, "sha1 string, path string, modified timestamp, text string, error string, metadata map<string,string>")


def ingest(spark: SparkSession, folder: str, known: DataFrame | None = None, include: str | None = None, exclude: str | None = None, limit: int | None = None, manifest: str | None = "auto", html: str = "default", overwrite: bool = False) -> DataFrame:
    """Documents of a folder with sha1, filename, filepath, content, file_modified, metadata, status and error.

    Order of work: listing, globs, limit by path, skip rules, hash, first file of each hash, known hashes out, and only
    then extraction. ``manifest``: "auto", a path, or None / "" for none. The manifest itself is no document.
    """
    files = list_files(spark, folder).where(file_globs(F.col("path"), include, exclude)).where(file_name(F.col("path")) != MANIFEST)
    if limit is not None:
        names = files.select("path").orderBy("path").limit(limit)
        files = files.join(names, "path", "left_semi")
    head: Column = F.when(file_suffix(F.col("path")).isin(".log", ".txt"), F.decode(F.substring("content", 1, 65536), "ISO-8859-1"))
    files = files.where(~skip_file(F.col("path"), F.coalesce(head, F.lit(""))))
    # Keys and paths are exchanged; contents are read where they are extracted, and only those that are wanted.
    files = files.select("path", "modificationTime", F.sha1("content").alias("sha1"))
    files = first_per_key(files, "sha1", "path")
    if known is not None and not overwrite:
        files = files.join(known.select("sha1").distinct(), "sha1", "left_anti")
    docs = extracted(files, html)
    at = find_manifest(folder) if manifest == "auto" else manifest or None
    extra = read_manifest(spark, at) if at else spark.createDataFrame([], "filename string, metadata map<string,string>")
    extra = extra.withColumnsRenamed({"filename": "_name", "metadata": "_more"})
    docs = docs.withColumn("filename", file_name(F.col("path"))).join(extra, F.col("filename") == F.col("_name"), "left")
    return docs.select("sha1", "filename", F.col("path").alias("filepath"), F.when(F.col("error").isNull(), clean_lines(F.col("text"))).alias("content"), F.col("modified").alias("file_modified"), merge_metadata(allowed_metadata(F.col("metadata")), F.col("_more")).alias("metadata"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error")


def counters(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
