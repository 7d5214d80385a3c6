"""Validation and coercion of model answers as Column functions.

Each returns a struct ``(value, error)``: exactly one is set, so a bad answer is a row with a message and
never an exception inside the job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import language_fits, strip

_TRUE, _FALSE = ("true", "yes", "1", "on"), ("false", "no", "0", "off")
_BOOLS = {**{x: True for x in (*_TRUE, "t", "y")}, **{x: False for x in (*_FALSE, "f", "n")}}


def _result(value: Column, ok: Column, message: Column) -> Column:
    good = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(good, value).alias("value"), F.when(~good, message).alias("error"))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, "^[\"']+|[\"']+$", "")


def _choice_map(choices: list[str], case_sensitive: bool) -> Column:
    """Choice as written by how it is compared; of choices alike but for case the first holds."""
    table: dict[str, str] = {}
    for ch in choices:
        table.setdefault(ch if case_sensitive else ch.lower(), ch)
    if not table:
        raise ValueError("an enumeration needs choices")
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def enum_answer(answer: Column, choices: list[str], case_sensitive: bool = True) -> Column:
    """One of the choices, after white space and then quotes are taken off; returned as the choice is written."""
    bare = _unquoted(strip(answer))
    found = F.try_element_at(_choice_map(choices, case_sensitive), bare if case_sensitive else F.lower(bare))
    return _result(found, found.isNotNull(), F.concat(F.lit("not one of the choices: "), F.coalesce(bare, F.lit("null"))))


def enum_list_answer(answer: Column, choices: list[str], case_sensitive: bool = True, min_items: int = 0, max_items: int | None = None, unique: bool = True) -> Column:
    """A JSON array, a JSON string, values parted by commas, or one value; every item must be a choice.

    Repeated items go first (unless ``unique`` is off); the bounds hold for what remains.
    """
    bare = strip(answer)
    array = F.from_json(bare, "array<string>")
    looks_json = bare.rlike(r"^[\[{]") | bare.rlike(r"^-?\d+(\.\d+)?$|^(true|false|null)$")
    single = F.get_json_object(F.concat(F.lit('{"x":'), bare, F.lit("}")), "$.x")
    commas = F.transform(F.split(bare, ","), lambda x: _unquoted(strip(x)))
    items = F.when(bare.startswith("["), array).when(bare.rlike(r'^"[^"]*"$'), F.array(single)).when(looks_json, F.lit(None)).when(bare.contains(","), commas).otherwise(F.array(_unquoted(bare)))
    table = _choice_map(choices, case_sensitive)
    mapped = F.transform(items, lambda x: F.try_element_at(table, x if case_sensitive else F.lower(x)))
    allowed = F.coalesce(F.forall(mapped, lambda x: x.isNotNull()), F.lit(False))
    kept = F.array_distinct(mapped) if unique else mapped
    enough = F.size(kept) >= (min_items or 0)
    few = F.size(kept) <= max_items if max_items else F.lit(True)
    message = F.when(items.isNull(), "not a list").when(~allowed, "an item is not one of the choices").when(~enough, F.lit(f"fewer than {min_items} items")).otherwise(F.lit(f"more than {max_items} items"))
    return _result(kept, items.isNotNull() & allowed & enough & few, message)


def simple_answer(answer: Column, kind: str, lang: str | None = None) -> Column:
    """string, integer, float or boolean out of free text; the language counts for strings only."""
    bare = strip(answer)
    if kind in ("boolean", "bool"):
        low = F.lower(bare)
        return _result(low.isin(*_TRUE), low.isin(*_TRUE, *_FALSE), F.concat(F.lit("not a boolean: "), F.coalesce(bare, F.lit("null"))))
    if kind in ("integer", "int"):
        value = F.when(bare.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(bare, F.lit("_"), F.lit(""))).try_cast("long")
        return _result(value, value.isNotNull(), F.concat(F.lit("not an integer: "), F.coalesce(bare, F.lit("null"))))
    if kind in ("float", "number", "double"):
        value = F.when(bare.rlike(r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)$"), bare).try_cast("double")
        return _result(value, value.isNotNull(), F.concat(F.lit("not a number: "), F.coalesce(bare, F.lit("null"))))
    if kind in ("string", "str"):
        fits = language_fits(bare, lang)
        return _result(bare, bare.isNotNull() & fits, F.when(bare.isNull(), "missing").otherwise(F.lit(f"not in language {lang}")))
    raise ValueError(f"unknown kind {kind}")


def lax(value: Column, kind: str) -> Column:
    """A JSON value's text as a typed value, the lenient way: '5' and 5.0 are integers, 5.5 is none; 'yes' is true."""
    bare = strip(value)
    if kind == "integer":
        real = bare.try_cast("double")
        whole = F.when(real == F.floor(real), real.cast("long"))
        return F.coalesce(F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("long")), F.when(bare.rlike(r"^[+-]?\d+\.0*$"), whole))
    if kind == "float":
        return bare.try_cast("double")
    if kind == "boolean":
        table = F.create_map(*[F.lit(x) for pair in _BOOLS.items() for x in pair])
        return F.try_element_at(table, F.lower(bare))
    return value


def truthy(value: Column, data_type: str) -> Column:
    """Neither null, empty, blank zero nor false."""
    if data_type == "string":
        return F.coalesce(F.length(value) > 0, F.lit(False))
    if data_type == "boolean":
        return F.coalesce(value, F.lit(False))
    if data_type.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value != 0, F.lit(False))


def meaningful(value: Column, data_type: str) -> Column:
    """The value, or null for what says nothing: blank text, any-case 'null', an empty list or map."""
    if data_type == "string":
        bare = strip(value)
        return F.when((bare != "") & (F.lower(bare) != "null"), value)
    if data_type.startswith(("array", "map")):
        return F.when(F.size(value) > 0, value)
    return value
