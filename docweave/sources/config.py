"""YAML configuration: imports, named queries, environment variables, tasks and their checks."""

from __future__ import annotations

import difflib
import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..plans.schema import Schema, SchemaError, compile_schema


class ConfigError(ValueError):
    """A configuration that cannot be used; ``problems`` lists why."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def _loader(folder: str):
    class Loader(yaml.SafeLoader):
        pass

    def imported(loader, node):
        with open(os.path.join(folder, loader.construct_scalar(node)), encoding="utf-8") as f:
            return yaml.safe_load(f)  # imports do not nest

    Loader.add_constructor("!import", imported)
    return Loader


def _expanded(value: Any) -> Any:
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: _expanded(v) for k, v in value.items()}
    return [_expanded(v) for v in value] if isinstance(value, list) else value


def load_config(path: str) -> dict:
    """The file with imports read (relative to it), named queries of imports merged, and ``${NAME}`` filled in."""
    folder = os.path.dirname(os.path.abspath(path))
    with open(path, encoding="utf-8") as f:
        config = yaml.load(f, _loader(folder)) or {}  # noqa: S506 - a safe loader with one more tag
    if not isinstance(config, dict):
        raise ConfigError(["the configuration is not a mapping"])
    queries = config.get("sql_queries")
    if isinstance(queries, dict):
        merged: dict[str, Any] = {}
        for k, v in queries.items():
            merged.update(v if isinstance(v, dict) else {k: v})
        config["sql_queries"] = merged
    return _expanded(config)


@dataclass
class TaskPlan:
    name: str
    schema: Schema
    prompt: str
    inputs: list[str]
    query: str | None = None
    tables: list[str] = field(default_factory=list)
    output_table: str | None = None
    output_column: str | None = None
    key: str = "sha1"
    models: list[str] = field(default_factory=lambda: ["stub"])
    system: str | None = None
    where: str | None = None
    mode: str = "append"
    append_file: str | None = None

    @property
    def storage(self) -> str:
        return "separate_table" if self.output_table else "direct_column"


def plan_task(task: dict, config: dict | None = None) -> TaskPlan:
    """A task's plan: its schema compiled, its storage chosen. Several fields need an output table."""
    config, problems = config or {}, []
    name = task.get("name")
    if not name:
        problems.append("a task needs a name")
    for part in ("schema", "prompt"):
        if not task.get(part):
            problems.append(f"{name}: needs a {part}")
    inputs = task.get("input") or {}
    query = task.get("query") or (inputs.get("query") if isinstance(inputs, dict) else None)
    table = task.get("table") or task.get("tables")
    if not query and not table:
        problems.append(f"{name}: needs a query or a table")
    schema = None
    if task.get("schema"):
        try:
            schema = compile_schema(task["schema"], task.get("output_column") or name, bool(task.get("all_fields_optional")))
        except SchemaError as e:
            problems.append(f"{name}: {e}")
    if schema and not schema.is_simple and not task.get("output_table"):
        problems.append(f"{name}: several fields need an output_table")
    if problems:
        raise ConfigError(problems)
    tables = [t.strip() for t in table.split(",")] if isinstance(table, str) else list(table or [])
    known = config.get("tables") or {}
    if tables == ["all"]:
        tables = list(known)
    query = (config.get("sql_queries") or {}).get(query, query) if query else query
    systems = config.get("system_prompts") or {}
    models = task.get("models") or task.get("model") or config.get("default_model") or "stub"
    columns = inputs.get("input_columns") if isinstance(inputs, dict) else None
    return TaskPlan(
        name, schema, task["prompt"], task.get("input_columns") or columns or ["content"], query, tables, task.get("output_table"), schema.names[0] if schema.is_simple and not task.get("output_table") else None, task.get("key_column", "sha1"),
        [m.strip() for m in models.split(",")] if isinstance(models, str) else [m["name"] if isinstance(m, dict) else m for m in models], systems.get(task.get("system_prompt"), task.get("system_prompt")), task.get("where"), "overwrite" if task.get("overwrite") else "append", task.get("append_file"),
    )


def with_appended_file(prompt: str, path: str | None, folder: str) -> str:
    """The prompt, a blank line and the file's text."""
    if not path:
        return prompt
    with open(os.path.join(folder, path), encoding="utf-8") as f:
        return f"{prompt}\n\n{f.read()}"


def choose_tasks(config: dict, wanted: str | None) -> list[dict]:
    """Tasks named in a comma or space list, each once, in the configuration's order; all when nothing is named."""
    tasks = config.get("enrichments") or []
    if not wanted or not wanted.strip():
        return tasks
    names = list(dict.fromkeys(x for x in re.split(r"[,\s]+", wanted.strip()) if x))
    found = [t for t in tasks if t.get("name") in names]
    if not found:
        near = [m for n in names for m in difflib.get_close_matches(n, [t.get("name", "") for t in tasks], cutoff=0.4)]
        raise ConfigError([f"no such task: {', '.join(names)}" + (f"; did you mean {', '.join(dict.fromkeys(near))}?" if near else "")])
    return found


def lint(config: dict) -> list[str]:
    """Everything that is wrong or doubtful in a configuration, without raising."""
    out: list[str] = []
    tasks = config.get("enrichments")
    if not isinstance(tasks, list) or not tasks:
        out.append("there are no enrichments")
        tasks = []
    seen: set[str] = set()
    for t in tasks:
        if t.get("name") in seen:
            out.append(f"{t['name']}: the name is used twice")
        seen.add(t.get("name"))
        try:
            plan = plan_task(t, config)
            for f in plan.schema.fields:
                if f.choices and len(set(f.choices)) < len(f.choices):
                    out.append(f"{plan.name}.{f.name}: repeated choices")
        except ConfigError as e:
            out += e.problems
        body = t.get("schema")
        for k, v in (body.items() if isinstance(body, dict) else ()):
            if isinstance(v, dict) and v.get("type") == "number":
                out.append(f"{t.get('name')}.{k}: 'number' is read as float; say 'integer' or 'float'")
            if isinstance(v, dict) and {"enum", "enum_list"} <= set(v):
                out.append(f"{t.get('name')}.{k}: both enum and enum_list")
        heat = t.get("temperature")
        if heat is not None and not (isinstance(heat, (int, float)) and 0 <= heat <= 2):
            out.append(f"{t.get('name')}: temperature must be from 0 to 2")
    for name, export in (config.get("exports") or {}).items() if isinstance(config.get("exports"), dict) else ():
        for fmt in export.get("formats", []) if isinstance(export, dict) else ():
            if fmt not in ("csv", "json", "jsonl", "md", "txt", "html", "parquet"):
                out.append(f"export {name}: unknown format {fmt}")
    return out
