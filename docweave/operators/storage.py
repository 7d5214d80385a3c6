"""State as tables: upserts, direct columns, audit log, prompt registry, versioned folders."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.answers import meaningful

AUDIT = T.StructType().add("enrichment_id", "string").add("sha1", "string").add("enrichment_name", "string").add("raw_json", "string").add("model_used", "string").add("prompt_id", "string").add("full_prompt", "string").add("error", "string").add("attempt", "integer").add("created_at", "timestamp")
PROMPTS = T.StructType().add("prompt_id", "string").add("enrichment_name", "string").add("prompt_text", "string").add("system_prompt", "string").add("prompt_hash", "string").add("created_at", "timestamp")


def cleaned(updates: DataFrame, keys: list[str], clear_nulls: bool = False) -> DataFrame:
    """Values that say nothing become null; rows with nothing left go (unless nulls are meant to clear)."""
    kinds = dict(updates.dtypes)
    values = [c for c in updates.columns if c not in keys]
    out = updates.select(*keys, *[meaningful(F.col(c), kinds[c]).alias(c) for c in values])
    if clear_nulls or not values:
        return out
    return out.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in values]))


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], stamps: tuple[str, str] | None = None, now: Column | None = None, clear_nulls: bool = False, replace: bool = False) -> DataFrame:
    """``table`` with ``updates`` merged in by ``keys``; columns that either lacks are added.

    Only values that say something overwrite (``clear_nulls``: all; ``replace``: the whole row). ``stamps`` names the
    columns for creation, which is kept, and change. One row per key is expected in either.
    """
    now = F.current_timestamp() if now is None else now
    stamp = list(stamps or ())
    fresh = updates if replace else cleaned(updates, keys, clear_nulls)
    columns = [c for c in dict.fromkeys([*table.columns, *fresh.columns]) if c not in keys and c not in stamp]
    old = table.select(*[F.col(c).alias(f"o_{c}") for c in table.columns], F.lit(True).alias("o_"))
    new = fresh.select(*[F.col(c).alias(f"n_{c}") for c in fresh.columns], F.lit(True).alias("n_"))
    joined = old.join(new, reduce(lambda a, b: a & b, [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]), "full_outer")
    has = F.col("n_").isNotNull()

    def merged(c: str) -> Column:
        if c not in fresh.columns:
            return F.when(has, F.lit(None)).otherwise(F.col(f"o_{c}")) if replace else F.col(f"o_{c}")
        if c not in table.columns:
            return F.col(f"n_{c}")
        if replace or clear_nulls:
            return F.when(has, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        return F.coalesce(f"n_{c}", f"o_{c}")

    out = [F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys] + [merged(c).alias(c) for c in columns]
    if stamp:
        was = F.col(f"o_{stamp[0]}") if stamp[0] in table.columns else F.lit(None).cast("timestamp")
        changed = F.col(f"o_{stamp[1]}") if stamp[1] in table.columns else F.lit(None).cast("timestamp")
        out += [F.coalesce(was, now).alias(stamp[0]), F.when(has, now).otherwise(changed).alias(stamp[1])]
    return joined.select(*out)


def upsert_derived(table: DataFrame, results: DataFrame, key: str = "sha1", now: Column | None = None, clear_nulls: bool = False) -> DataFrame:
    """Results into a derived table, one row per (key, model) where both know the model, else per key."""
    keys = [key, "model_used"] if "model_used" in results.columns else [key]
    return upsert(table, results, keys, ("created_at", "updated_at"), now, clear_nulls)


def update_column(table: DataFrame, results: DataFrame, column: str, key: str = "sha1") -> DataFrame:
    """A direct column: new values that say something replace the old ones; rows are never added."""
    kind = dict(results.dtypes)[column]
    new = results.select(F.col(key).alias("_key"), meaningful(F.col(column), kind).alias("_new")).where(F.col("_new").isNotNull())
    joined = table.join(new, table[key] == new["_key"], "left")
    value = F.coalesce("_new", F.col(column)) if column in table.columns else F.col("_new")
    return joined.select(*[F.col(c) for c in table.columns if c != column], value.alias(column), F.col("_new").isNotNull().alias("metadata_updated"))


def insert_new(table: DataFrame, rows: DataFrame, key: str = "sha1", overwrite: bool = False) -> DataFrame:
    """Rows appended unless their key is known; with ``overwrite`` they replace it. New columns are added."""
    if overwrite:
        kept = table.join(rows.select(F.col(key).alias("_k")).distinct(), table[key] == F.col("_k"), "left_anti")
        return kept.unionByName(rows, allowMissingColumns=True)
    fresh = rows.join(table.select(F.col(key).alias("_k")).distinct(), rows[key] == F.col("_k"), "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def check_compatible(table: DataFrame, key: str = "sha1") -> None:
    if key not in table.columns:
        raise ValueError(f"the table has no key column {key}")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    columns = sorted(a.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# Registry and audit.


def prompt_hash(name: Column, prompt: Column, system: Column) -> Column:
    return F.sha2(F.concat_ws("|", name, prompt, F.coalesce(system, F.lit(""))), 256)


def register_prompts(registry: DataFrame, prompts: DataFrame, now: Column | None = None) -> DataFrame:
    """The registry with unknown prompts added; ids come from the hash, so runs agree on them."""
    hashed = prompts.withColumn("prompt_hash", prompt_hash(F.col("enrichment_name"), F.col("prompt_text"), F.col("system_prompt"))).dropDuplicates(["enrichment_name", "prompt_hash"])
    fresh = hashed.join(registry.select("enrichment_name", "prompt_hash"), ["enrichment_name", "prompt_hash"], "left_anti")
    fresh = fresh.withColumn("prompt_id", F.substring("prompt_hash", 1, 32)).withColumn("created_at", F.current_timestamp() if now is None else now)
    return registry.select(*PROMPTS.names).unionByName(fresh.select(*PROMPTS.names))


def prompt_usage(registry: DataFrame, audit: DataFrame) -> DataFrame:
    """How often each prompt was used, newest first."""
    used = audit.groupBy("prompt_id").agg(F.count("enrichment_id").alias("n_used"))
    return registry.join(used, "prompt_id", "left").select("prompt_id", "enrichment_name", "prompt_text", "created_at", F.coalesce("n_used", F.lit(0)).alias("n_used")).orderBy(F.desc("created_at"), "prompt_id")


def attempt_id(key: Column, name: Column, model: Column, attempt: Column, run: str | None = None) -> Column:
    """An id that a retried task makes again, as it is a hash; attempts of different runs (``run``) differ."""
    return F.sha2(F.concat_ws("|", key, name, model, attempt.cast("string"), *([F.lit(run)] if run else [])), 256)


def history(audit: DataFrame, key: str | None = None, name: str | None = None) -> DataFrame:
    """Attempts of a document or task, newest first."""
    out = audit if key is None else audit.where(F.col("sha1") == key)
    out = out if name is None else out.where(F.col("enrichment_name") == name)
    return out.orderBy(F.desc("created_at"), F.desc("enrichment_id"))


class Conflict(RuntimeError):
    """Another writer changed the table between the reading and the writing."""


class Table:
    """A table as versioned folders and numbered pointers, so that a rewrite is seen whole or not at all.

    A pointer file names the folders of a version. The next version is made by renaming a finished file to the next number, which
    fails if another writer has taken it: an append then tries again after that writer's, a replacement raises ``Conflict``
    because its rows came from an older version. Readers take the version they find.
    """

    KEEP = 20  # pointers; older ones go, with folders that no pointer names

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._seen: int | None = None

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self) -> list[int]:
        return [int(n) for n in self._names("_pointers") if n.isdigit()]

    def _folders(self, version: int) -> list[str]:
        return json.loads(bytes(self._fs().open(self._hadoop(f"_pointers/{version:012d}")).readAllBytes()).decode())

    def _pointer(self) -> tuple[int, list[str]]:
        versions = self._versions()
        return (versions[-1], self._folders(versions[-1])) if versions else (-1, [])

    def _point(self, folders: list[str], version: int) -> None:
        """Publish ``folders`` as ``version``; ``Conflict`` if that is there."""
        new = self._hadoop(f"_pointers/.new-{uuid.uuid4().hex}")
        out = self._fs().create(new, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        jvm, at = self.spark._jvm, self._hadoop(f"_pointers/{version:012d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            context.rename(context.makeQualified(new), context.makeQualified(at), options)
        except Exception as e:
            self._fs().delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path}: version {version} is there already") from e
            raise

    def exists(self) -> bool:
        return bool(self._versions())

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", str(len(folders) > 1).lower()).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        self._seen, folders = self._pointer()
        if not folders:
            if self.schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], self.schema)
        return self._load(folders)

    def _write(self, df: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def append(self, df: DataFrame, tries: int = 100) -> DataFrame:
        """Add rows; returns them as they were written."""
        name = self._write(df)
        for _ in range(tries):
            version, folders = self._pointer()
            try:
                self._point([*folders, name], version + 1)
                return self._load([name])
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} other writers were faster")

    def replace(self, df: DataFrame) -> None:
        """The rows instead of those that this object read last."""
        name = self._write(df)
        version = self._pointer()[0] if self._seen is None else self._seen
        self._point([name], version + 1)
        self._seen = version + 1
        self.vacuum()

    def compact(self, above: int = 50) -> None:
        """One folder instead of more than ``above``."""
        version, folders = self._pointer()
        if len(folders) > above:
            self._point([self._write(self._load(folders))], version + 1)
            self.vacuum()

    def vacuum(self, keep: int | None = None) -> None:
        """Remove all but the last ``keep`` pointers, and the folders that only removed ones name; a folder being written has no name yet."""
        versions = self._versions()
        old, kept = versions[: -(keep or self.KEEP)], versions[-(keep or self.KEEP) :]
        named = {f for v in kept for f in self._folders(v)}
        for v in old:
            for f in self._folders(v):
                if f not in named:
                    self._fs().delete(self._hadoop(f), True)
            self._fs().delete(self._hadoop(f"_pointers/{v:012d}"), False)
