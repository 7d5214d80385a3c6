"""Plugins: classes named ``Plugin`` in Python files, and JSON records as a Python data source."""

from __future__ import annotations

import glob
import hashlib
import importlib.util
import json
import os
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import authors_of, bibtex_key, year_of


class Ingester(Protocol):
    """What a plugin offers: a name, a description, a target table, and rows for it."""

    name: str
    description: str
    target_table: str

    def ingest(self, spark: SparkSession, config: dict, limit: int | None = None) -> DataFrame: ...


def discover(*folders: str) -> dict[str, Ingester]:
    """Plugins by name from ``*.py`` files; those that start with an underscore are skipped, later folders win."""
    found: dict[str, Ingester] = {}
    for folder in folders:
        for path in sorted(glob.glob(os.path.join(folder, "*.py"))):
            stem = os.path.basename(path)[:-3]
            if stem.startswith("_"):
                continue
            spec = importlib.util.spec_from_file_location(f"docweave_plugin_{stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if (cls := getattr(module, "Plugin", None)) is not None:
                plugin = cls()
                found[plugin.name] = plugin
    return found


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class JsonRecords(DataSource):
    """Files that each hold a JSON list of objects: (record_id, record), the id a hash of the sorted object."""

    @classmethod
    def name(cls):
        return "json_records"

    def schema(self):
        return "record_id string, record string"

    def reader(self, schema):
        return _JsonReader(self.options)


class _JsonReader(DataSourceReader):
    def __init__(self, options):
        path = options.get("path", "")
        self.paths = sorted(glob.glob(os.path.join(path, "*.json"))) if os.path.isdir(path) else [path]

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            data = json.load(f)
        for row in data if isinstance(data, list) else [data]:
            text = json.dumps(row, sort_keys=True, ensure_ascii=False)
            yield hashlib.sha1(text.encode()).hexdigest(), text


def json_records(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(JsonRecords)
    return spark.read.format("json_records").option("path", path).load()


# Bibliographies.

ITEM = "key string, data struct<itemType:string,title:string,abstractNote:string,date:string,DOI:string,url:string,publicationTitle:string,citationKey:string,extra:string,creators:array<struct<creatorType:string,firstName:string,lastName:string,name:string>>,tags:array<struct<tag:string>>>"
ATTACHMENT = "parent string, key string, data struct<itemType:string,linkMode:string,contentType:string,filename:string>"


def usable_items(items: DataFrame) -> DataFrame:
    return items.where(~F.col("data.itemType").isin("attachment", "note", "annotation"))


def usable_attachments(attachments: DataFrame) -> DataFrame:
    """Stored files that are PDF or HTML by type or name."""
    d = F.col("data")
    kind = F.coalesce(d["contentType"], F.lit("")).isin("application/pdf", "text/html") | F.lower(F.coalesce(d["filename"], F.lit(""))).rlike(r"\.(pdf|html?)$")
    return attachments.where(d["linkMode"].isin("imported_file", "imported_url") & kind)


def literature(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row per usable item, with its first usable attachment if it has one; items with an abstract alone stay."""
    first = usable_attachments(attachments).groupBy(F.col("parent").alias("_parent")).agg(F.min_by(F.struct(F.col("key").alias("attachment_key"), F.col("data.filename").alias("filename")), "key").alias("a"))
    rows = usable_items(items).join(first, F.col("key") == F.col("_parent"), "left")
    d = F.col("data")
    title = F.coalesce(d["title"], F.lit(""))
    return rows.select(
        F.sha1(F.concat_ws("_", "key", title).cast("binary")).alias("sha1"), F.col("key").alias("item_key"), title.alias("title"), authors_of(d["creators"]).alias("authors"), year_of(d["date"]).alias("year"), d["abstractNote"].alias("abstract"), d["DOI"].alias("doi"), d["publicationTitle"].alias("publication"),
        F.coalesce(d["citationKey"], F.nullif(bibtex_key(d["extra"]), F.lit(""))).alias("citation_key"), F.transform(d["tags"], lambda t: t["tag"]).alias("tags"), F.col("a.attachment_key").alias("attachment_key"), F.col("a.filename").alias("filename"),
        F.when(F.col("a").isNotNull(), "success").when(F.length(F.coalesce(d["abstractNote"], F.lit(""))) > 0, "abstract_only").otherwise("no_attachment").alias("status"),
    )


def fetch_json(url: str, headers: dict[str, str]) -> tuple[list[dict], dict[str, str]]:
    """The transport that is used where none is given: a page's records and the answer's headers."""
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:  # noqa: S310 - the caller's service
        return json.load(answer), dict(answer.headers)


def paged_records(spark: SparkSession, url: str, headers: dict[str, str] | None = None, size: int = 100, transport=fetch_json) -> DataFrame:
    """(record) JSON texts of a service that takes ``start`` and ``limit`` and tells ``Total-Results``; each page is fetched by a task.

    The result is to be written before it is used twice: every evaluation asks the service again.
    """
    headers, mark = dict(headers or {}), "&" if "?" in url else "?"
    told = {k.lower(): v for k, v in transport(f"{url}{mark}start=0&limit=1", headers)[1].items()}
    total = int(told["total-results"])

    def run(batches):
        for pdf in batches:
            for start in pdf["id"]:
                records, _ = transport(f"{url}{mark}start={start}&limit={size}", headers)
                yield pd.DataFrame({"record": [json.dumps(r, ensure_ascii=False) for r in records]}, dtype=object)

    return spark.range(0, total, size, max(1, -(-total // size))).mapInPandas(run, "record string")


def collection(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and attachments, as ``literature`` takes them, of a service's records."""
    items = records.select(F.from_json("record", ITEM).alias("r")).select("r.*")
    attached = records.select(F.from_json("record", "key string, data struct<itemType:string,parentItem:string,linkMode:string,contentType:string,filename:string>").alias("r"))
    attached = attached.where("r.data.itemType = 'attachment'").select(F.col("r.data.parentItem").alias("parent"), F.col("r.key").alias("key"), F.col("r.data").dropFields("parentItem").alias("data"))
    return usable_items(items), attached


def literature_counters(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """How many items had a text, an abstract alone, nothing, or were known before."""
    status = F.col("status")
    if known is not None:
        rows = rows.join(known.select(F.col("sha1").alias("_known")).distinct(), F.col("sha1") == F.col("_known"), "left")
        status = F.when(F.col("_known").isNotNull(), "skipped").otherwise(status)
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def doi_files(cache: DataFrame, projects: DataFrame, validation: DataFrame) -> DataFrame:
    """DOI records of projects, with the validation of their files found by ``doi#type``."""
    joined = cache.join(projects, "doi")
    return joined.join(validation, F.concat_ws("#", joined["doi"], joined["file_type"]) == validation["validation_key"], "left").drop("validation_key")
