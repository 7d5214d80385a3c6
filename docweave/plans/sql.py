"""User SQL: named queries over tables, and the few SQLite spellings that Spark lacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

_STRING = re.compile(r"('(?:[^']|'')*')")


def _outside(text: str, change) -> str:
    """``change`` applied to the parts of the text that are not string literals."""
    parts = _STRING.split(text)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def translate(sql: str) -> str:
    """Case-insensitive LIKE, ``date('now', ...)``, GROUP_CONCAT, json_extract and rowid, as Spark says them."""

    def days(m):
        n, unit = int(m[1]), m[2].lower().rstrip("s")
        return f"add_months(current_date(), {n * (12 if unit == 'year' else 1)})" if unit in ("month", "year") else f"date_add(current_date(), {n})"

    # Literals are put out of reach first; the patterns see their numbers.
    literals: list[str] = []

    def hide(m):
        literals.append(m[0])
        return f"\0{len(literals) - 1}\0"

    def literal(n: str) -> str:
        return literals[int(n)]

    def ago(m):
        if literal(m[1]).lower() != "'now'":
            return m[0]
        if m[2] is None:
            return "current_date()"
        step = re.fullmatch(r"(?i)'([+-]?\d+)\s+(days?|months?|years?)'", literal(m[2]))
        return days(step) if step else m[0]

    sql = _STRING.sub(hide, sql)
    sql = re.sub(r"(?i)\b(?:date|datetime)\(\s*\0(\d+)\0\s*(?:,\s*\0(\d+)\0\s*)?\)", ago, sql)
    sql = re.sub(r"(?i)\bgroup_concat\(\s*(distinct\s+)?([^(),]+?)\s*\)", r"listagg(\1\2, ',')", sql)
    sql = re.sub(r"(?i)\bgroup_concat\(\s*([^(),]+?)\s*,\s*(\0\d+\0)\s*\)", r"listagg(\1, \2)", sql)
    sql = re.sub(r"(?i)\bjson_extract\(", "get_json_object(", sql)
    sql = re.sub(r"(?i)\bjson_array_length\(", "json_array_length(", sql)
    sql = re.sub(r"(?i)\bnot\s+like\b", "NOT ILIKE", sql)
    sql = re.sub(r"(?i)(?<!i)\blike\b", "ILIKE", sql)
    sql = re.sub(r"(?i)\b(?:\w+\.)?rowid\s*,\s*\*", "*", sql)  # a view that has row ids has them first
    return re.sub("\0(\\d+)\0", lambda m: literal(m[1]), sql)


def names_rowid(sql: str) -> bool:
    return any(re.search(r"(?i)\browid\b", p) for p in _STRING.split(sql)[::2])


def with_rowid(df: DataFrame) -> DataFrame:
    """A ``rowid`` in front: ``doc_id`` where there is one, else a hash of the row's key. It stays the same as long as the row has its key."""
    if "rowid" in df.columns:
        return df
    keys = [c for c in ("sha1", "model_used", "enrichment_id", "prompt_id") if c in df.columns] or df.columns
    return df.select((F.col("doc_id") if "doc_id" in df.columns else F.xxhash64(*keys)).alias("rowid"), "*")


_REJECTED = re.compile(r"(?i)^\s*(insert|update|delete|drop|alter|create|attach|pragma|replace|vacuum)\b")


def run_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], named: dict[str, str] | None = None, dialect: str = "sqlite", rowid: bool = False) -> DataFrame:
    """A named or literal query over ``tables``, which are seen under their names for this query only.

    A query that says ``rowid`` sees one in every table; with ``rowid`` one that selects ``*`` does too.
    """
    sql = (named or {}).get(sql, sql).strip().rstrip(";")
    if _REJECTED.match(sql):
        raise ValueError("only queries are run here")
    wanted = dialect == "sqlite" and (names_rowid(sql) or rowid and re.search(r"(?i)\bselect\s+\*\s+from\b", sql) is not None)
    sql = translate(sql) if dialect == "sqlite" else sql
    used = {n: with_rowid(df) if wanted else df for n, df in tables.items() if re.search(rf"\b{re.escape(n)}\b", sql)}
    return _scoped(spark, sql, used)


def _scoped(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Temporary views with private names, put in place of the tables' names outside of literals."""
    import uuid

    tag = uuid.uuid4().hex[:8]
    for name, df in tables.items():
        view = f"_{name}_{tag}"
        df.createOrReplaceTempView(view)
        sql = _outside(sql, lambda p, n=name, v=view: re.sub(rf"(?i)\b(from|join|,)(\s+){re.escape(n)}\b(?!\s*\()(\s+(?:as\s+)?(?!where\b|join\b|left\b|right\b|inner\b|full\b|cross\b|group\b|order\b|limit\b|on\b|using\b|union\b|having\b|anti\b|semi\b|intersect\b|except\b)\w+)?", lambda m: f"{m[1]}{m[2]}{v}{m[3] or ' ' + n}", p))
    return spark.sql(sql)
