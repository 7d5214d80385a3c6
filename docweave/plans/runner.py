"""The three verbs and a query over a workspace: a folder of versioned tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import assembly as asm, enrichment as enr, search, selection as sel, storage as st
from ..sources import config as cf, export as ex, files as fl
from . import sql

DOCUMENTS, AUDIT, PROMPTS = "documents", "enrichment_responses", "prompts"
DOCUMENT_SCHEMA = "sha1 string, filename string, filepath string, content string, file_modified timestamp, metadata map<string,string>"


class Workspace:
    """Tables by name below one folder, local or shared."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, (root if "://" in root else "file://" + os.path.abspath(root)).rstrip("/")

    def table(self, name: str) -> st.Table:
        from pyspark.sql.types import StructType

        known = {DOCUMENTS: StructType.fromDDL(DOCUMENT_SCHEMA), AUDIT: st.AUDIT, PROMPTS: st.PROMPTS}
        return st.Table(self.spark, f"{self.root}/{name}", known.get(name))

    def names(self) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_pointers")))

    def has(self, name: str) -> bool:
        return name in self.names()

    def frames(self) -> dict[str, DataFrame]:
        """Every table as it is now. Documents also answer to the older name of their text."""
        out = {n: self.table(n).read() for n in self.names()}
        if DOCUMENTS in out and "raw_content" not in out[DOCUMENTS].columns and "content" in out[DOCUMENTS].columns:
            out[DOCUMENTS] = out[DOCUMENTS].withColumn("raw_content", F.col("content"))
        return out


def ingest(ws: Workspace, folder: str, table: str = DOCUMENTS, overwrite: bool = False, fulltext: bool = False, **options) -> dict[str, int]:
    """Files of a folder into a table; returns how many succeeded, failed and were known."""
    into = ws.table(table)
    known = into.read() if ws.has(table) or into.schema is not None else None
    if known is not None:
        st.check_compatible(known)
    found = fl.ingest(ws.spark, folder, known=known, overwrite=overwrite, **options).persist()
    try:
        counts = {r.status: r.n for r in fl.counters(found).collect()}
        rows = found.where("status = 'success'").drop("status", "error")
        if overwrite and known is not None:
            into.replace(st.insert_new(known, rows, overwrite=True))
        else:
            into.append(rows)  # keys already known were left out before the extraction
    finally:
        found.unpersist()
    if fulltext:
        ws.table(f"{table}_fts").replace(search.postings(into.read(), "sha1", ["content", "filename"]))
    return {"success": counts.get("success", 0), "failed": counts.get("failed", 0)}


@dataclass
class Outcome:
    task: str
    model: str
    n_rows: int
    cost: float
    n_results: int = 0
    n_rejected: int = 0
    stopped: str | None = None
    updates: str | None = None


def enrich(ws: Workspace, config: dict, names: str | None = None, model: str | None = None, table: str | None = None, limit: int | None = None, overwrite: bool = False, where: str | None = None, key: dict | None = None, retry_failed: bool = False, threshold: float = 5.0, confirm: Callable[[float], bool] | None = None, factory: Callable[[], enr.Provider] | None = None, folder: str = ".", log_updates: bool = False) -> list[Outcome]:
    """Tasks of a configuration: rows chosen, prompts made, models asked, answers audited and results stored.

    For each model: rows with an attempt on record or a stored result are skipped unless overwriting; a cost above
    ``threshold`` needs ``confirm``. Every table of a task is worked on, and results come from the written audit. A model must be
    on the price list or have a registered provider. ``log_updates`` also writes the results as JSON lines below ``updates``.
    """
    out = []
    for plan in [cf.plan_task(t, config) for t in cf.choose_tasks(config, names)]:
        mode = "overwrite" if overwrite else plan.mode
        sources = [table] if table else plan.tables or [None]
        for source in sources:
            for one in [m.strip() for m in model.split(",")] if model else plan.models:
                out.append(_enrich_one(ws, config, plan, source, one, mode, limit, where, key, retry_failed, threshold, confirm, factory, folder, log_updates))
    return out


def check_inputs(inputs: list[str], rows: DataFrame, frames: dict[str, DataFrame], source: str, task: str) -> None:
    """Every input column must be in the query's rows, or in the table that it names."""
    missing = []
    for spec in inputs:
        table, _, column = asm.parse_input(spec)[0].rpartition(".")
        there = rows.columns if table in ("", source) else frames[table].columns if table in frames else []
        if column not in there:
            missing.append(f"{task}: no input column {spec.partition(':')[0]}; there are {', '.join(sorted(there)) or 'no such table'}")
    if missing:
        raise cf.ConfigError(missing)


def _enrich_one(ws, config, plan, source, model, mode, limit, where, key, retry_failed, threshold, confirm, factory, folder, log_updates=False) -> Outcome:
    if factory is None and not enr.served(model):
        if not asm.allowed_model(model):
            raise cf.ConfigError([f"{plan.name}: unknown model {model}"])
        factory = enr.provider_for(model)
    frames = ws.frames()
    named = config.get("sql_queries") or {}
    base = (config.get("tables") or {}).get(source) or {}
    text = (base.get("base_query") if isinstance(base, dict) else None) or plan.query or f"SELECT * FROM {source}"
    source = source or DOCUMENTS
    rows = sql.run_query(ws.spark, text, frames, named, rowid=True)
    if plan.key not in rows.columns:
        if "rowid" not in rows.columns or source not in frames or plan.key not in frames[source].columns:
            raise cf.ConfigError([f"{plan.name}: the query has no column {plan.key}"])
        keys = sql.with_rowid(frames[source]).select(F.col("rowid").alias("_rowid"), plan.key)  # found by the row id
        rows = rows.join(keys, rows["rowid"] == keys["_rowid"]).drop("_rowid")
    check_inputs(plan.inputs, rows, frames, source, plan.name)
    direct = plan.output_column if plan.output_column in rows.columns else None
    rows = sel.select_rows(rows, mode, direct, where or plan.where, key, limit, order="rowid" if "rowid" in rows.columns else plan.key)
    audit = ws.table(AUDIT)
    if mode == "append":
        stored = frames.get(plan.output_table) if plan.output_table else None
        rows = sel.skip_done(rows, audit.read(), plan.name, model, plan.key, stored, direct, retry_failed)
    prompt = cf.with_appended_file(plan.prompt, plan.append_file, folder)
    inputs = asm.assemble(rows, frames, plan.inputs, plan.key, default=source)
    bare = [asm.parse_input(x)[0] for x in plan.inputs]
    task = enr.Task(plan.name, prompt, bare, plan.schema, model, plan.system, plan.key)
    asked = enr.with_prompts(inputs, task)
    cost = asm.estimate_cost(asked, "full_prompt", [model], plan.schema.output_tokens()).first()
    outcome = Outcome(plan.name, model, cost.n_rows, cost.cost)
    if not cost.n_rows:
        return outcome
    if asm.needs_confirmation(cost.cost, threshold) and not (confirm and confirm(cost.cost)):
        outcome.stopped = f"the estimated cost of ${cost.cost:.2f} is above ${threshold:.2f}"
        return outcome
    wanted = ws.spark.createDataFrame([(plan.name, prompt, plan.system)], "enrichment_name string, prompt_text string, system_prompt string")
    prompts = ws.table(PROMPTS)
    prompts.replace(st.register_prompts(prompts.read(), wanted))
    prompt_id = prompts.read().where((F.col("enrichment_name") == plan.name) & (F.col("prompt_hash") == st.prompt_hash(F.lit(plan.name), F.lit(prompt), F.lit(plan.system).cast("string")))).first().prompt_id
    run = uuid.uuid4().hex
    fresh = audit.append(enr.audited(enr.call_model(asked, task, factory), task, prompt_id, run=run))  # as written, and nothing else
    audit.compact()
    latest = sel.latest_per(fresh, ["sha1"])
    results = enr.results(latest, task)
    if log_updates:
        outcome.updates = f"{ws.root}/updates/{plan.name}-{run}"
        results.write.json(outcome.updates)
    outcome.n_results, outcome.n_rejected = results.count(), enr.rejected(latest, task).count()
    results = results.withColumnRenamed("sha1", plan.key)
    if plan.output_table:
        into = ws.table(plan.output_table)
        old = into.read() if ws.has(plan.output_table) else results.limit(0)
        into.replace(st.upsert_derived(old, results, plan.key))
    elif ws.has(source):
        into = ws.table(source)
        into.replace(st.update_column(into.read().drop("metadata_updated"), results, plan.output_column, plan.key))
    return outcome


def export(ws: Workspace, config: dict, names: str | None = None, folder: str = ".") -> dict[str, int]:
    """Exports of a configuration; returns files or rows written per export."""
    exports = config.get("exports") or {}
    if isinstance(exports, list):
        exports = {e.get("name", str(i)): e for i, e in enumerate(exports)}
    wanted = [n.strip() for n in names.split(",")] if names else list(exports)
    out = {}
    for name in wanted:
        if name not in exports:
            raise cf.ConfigError([f"no such export: {name}"])
        e = exports[name]
        rows = sql.run_query(ws.spark, e["query"], ws.frames(), config.get("sql_queries"))
        target = os.path.join(folder, e.get("output_dir", name))
        formats = e.get("formats") or [e.get("format", "md")]
        native = [f for f in formats if f in ("csv", "json", "jsonl", "parquet", "txt")]
        rows = sel.require(rows, e.get("required_fields") or [])
        for fmt in native:
            ex.export_table(rows, os.path.join(target, fmt), fmt)
        count = rows.count() if native else 0
        if len(native) < len(formats):
            template = e.get("template")
            if template and os.path.isfile(os.path.join(folder, template)):
                with open(os.path.join(folder, template), encoding="utf-8") as f:
                    template = f.read()
            done = ex.export_documents(rows, os.path.abspath(target), template or ex.PARALLEL, e.get("output_naming", "{sha1}"), "{sha1}", formats=tuple(f for f in formats if f not in native))
            count += len(done.collect())  # a small row per file
        out[name] = count
    return out


def query(ws: Workspace, text: str, config: dict | None = None) -> DataFrame:
    return sql.run_query(ws.spark, text, ws.frames(), (config or {}).get("sql_queries"))
