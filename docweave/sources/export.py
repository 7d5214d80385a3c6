"""Exports: templates, file names, Markdown and HTML documents, and native formats."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.selection import require

_BAD = re.compile(r"[^\w.\- ]+")
_BLOCK = re.compile(r"\{%\s*(for\s+(\w+)\s+in\s+([\w.]+)|if\s+(not\s+)?([\w.]+)|else|endfor|endif)\s*%\}|\{\{\s*([\w.]+)(\s*\|\s*(\w+))?\s*\}\}")


def _lookup(path: str, scope: dict):
    value = scope
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else getattr(value, part, None)
    return value


_FILTERS: dict[str, Callable] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "escape": html.escape}


def render(template: str, scope: dict) -> str:
    """``{{ name|filter }}``, ``{% for x in xs %}`` and ``{% if [not] x %}`` with else; unknown names are empty."""

    def walk(at: int, scope: dict, show: bool) -> tuple[str, int, str]:
        out = []
        while m := _BLOCK.search(template, at):
            out.append(template[at : m.start()])
            at = m.end()
            word = (m[1] or "").split()[0] if m[1] else ""
            if m[6]:
                value = _lookup(m[6], scope)
                text = "" if value is None else str(value)
                out.append(_FILTERS.get(m[8], lambda x: x)(text) if m[8] else text)
            elif word == "for":
                items = (_lookup(m[3], scope) or []) if show else []
                body_at, end = at, None
                for item in items:
                    text, end, _ = walk(body_at, {**scope, m[2]: item}, show)
                    out.append(text)
                at = end if end is not None else walk(body_at, scope, False)[1]
            elif word == "if":
                good = bool(_lookup(m[5], scope)) != bool(m[4])
                text, at, why = walk(at, scope, show and good)
                other = ""
                if why == "else":
                    other, at, _ = walk(at, scope, show and not good)
                out.append(text if good else other)
            else:
                return "".join(out), at, word
        out.append(template[at:])
        return "".join(out), len(template), "end"

    return walk(0, scope, True)[0]


#: Line pairs of a translation, with front matter.
PARALLEL = "---\ntitle: {{ title }}\nsource: {{ sha1 }}\n---\n\n{% for line in lines %}{{ line.zh }}\n\n*{{ line.en }}*\n\n{% endfor %}"


def export_name(pattern: str, fallback: str, columns: list[str]) -> Column:
    """``{column}`` filled in; where one is null or unknown, the fallback pattern. Unsafe signs become underscores."""

    def filled(p: str) -> Column:
        parts = re.split(r"\{(\w+)\}", p)
        if any(n not in columns for n in parts[1::2]):
            return F.lit(None).cast("string")
        return F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(parts)])

    return F.regexp_replace(F.coalesce(filled(pattern), filled(fallback)), r"(?U)[^\w.\- ]+", "_")


def rendered(rows: DataFrame, template: str, name: Column) -> DataFrame:
    """(name, body): each row through the template. JSON text that holds a list or object is read first."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def opened(v):
            if isinstance(v, str) and v[:1] in "[{":
                try:
                    return json.loads(v)
                except ValueError:
                    return v
            return None if isinstance(v, float) and v != v else v

        for pdf in batches:
            body = [render(template, {k: opened(v) for k, v in zip(columns, row)}) for row in pdf[columns].itertuples(index=False, name=None)]
            yield pd.DataFrame({"name": pdf["_name"], "body": body})

    return rows.withColumn("_name", name).mapInPandas(run, "name string, body string")


def to_html(body: str, title: str = "") -> str:
    """A small page: headings, paragraphs, emphasis."""
    out = []
    for block in re.split(r"\n{2,}", re.sub(r"(?s)\A---\n.*?\n---\n", "", body).strip()):
        text = re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", html.escape(block))
        text = re.sub(r"\*(.+?)\*", r"<em>\1</em>", text)
        m = re.match(r"(#{1,6}) (.*)", text)
        out.append(f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>" if m else f"<p>{text}</p>")
    return f"<!DOCTYPE html><meta charset=\"utf-8\"><title>{html.escape(title)}</title>\n" + "\n".join(out)


def export_documents(rows: DataFrame, folder: str, template: str, pattern: str, fallback: str = "{sha1}", required: list[str] | None = None, formats: tuple[str, ...] = ("md",)) -> DataFrame:
    """One file per row and format, written by the tasks; returns (name, format, bytes). Names must be distinct."""
    rows = require(rows, required or [])
    docs = rendered(rows, template, export_name(pattern, fallback, rows.columns))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as afs

        fs, path = afs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(path, recursive=True)
        for pdf in batches:
            out = []
            for name, body in zip(pdf["name"], pdf["body"]):
                for fmt in formats:
                    data = (to_html(body, name) if fmt == "html" else body).encode()
                    with fs.open_output_stream(f"{path}/{name}.{fmt}") as f:
                        f.write(data)
                    out.append((name, fmt, len(data)))
            yield pd.DataFrame(out, columns=["name", "format", "bytes"])

    return docs.mapInPandas(write, "name string, format string, bytes long")


def export_table(rows: DataFrame, path: str, fmt: str) -> None:
    """Native sinks; lists and maps become JSON text where the format is flat."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    if fmt == "csv":
        rows.select(*flat).write.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        rows.write.json(path)
    elif fmt == "parquet":
        rows.write.parquet(path)
    elif fmt == "txt":
        rows.select(F.concat_ws("\t", *[c.cast("string") for c in flat])).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


# XML answers: a parent row and child tables.


def xml_tables(rows: DataFrame, key: str, xml: str, schema: str, children: dict[str, str]) -> dict[str, DataFrame]:
    """``parent`` and a table per child: arrays inside the parsed XML, exploded; nested structs are flattened with underscores."""
    parsed = rows.select(F.col(key), F.from_xml(F.col(xml), schema).alias("x"))
    kinds = {f.name: f.dataType for f in parsed.schema["x"].dataType.fields}
    flat = lambda base, fields: [F.col(f"{base}.{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for f in fields if hasattr(f.dataType, "fields") for g in f.dataType.fields] + [F.col(f"{base}.{f.name}").alias(f.name) for f in fields if not hasattr(f.dataType, "fields") and f.dataType.typeName() != "array"]
    out = {"parent": parsed.select(key, *flat("x", [f for f in parsed.schema["x"].dataType.fields if f.name not in children]))}
    for path, table in children.items():
        element = kinds[path].elementType
        each = parsed.select(key, F.posexplode(f"x.{path}").alias("position", "c"))
        out[table] = each.select(key, "position", *flat("c", element.fields)) if hasattr(element, "fields") else each.select(key, "position", F.col("c").alias(table))
    return out
