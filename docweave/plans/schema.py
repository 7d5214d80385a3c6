"""Output schemas declared in YAML, compiled to Spark types and check columns.

A field is a kind (``string``, ``integer``, ``float``/``number``, ``boolean``, ``array``, ``object``), a bare list of
choices, or a mapping with ``type``, ``enum``, ``enum_list`` and constraints. A whole schema may itself be one field;
it then takes the task's output column as its name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field as _field
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions import answers
from ..functions.text import language_fits, place_name

_KINDS = {"string": "string", "str": "string", "integer": "integer", "int": "integer", "float": "float", "number": "float", "boolean": "boolean", "bool": "boolean", "array": "array", "list": "array", "object": "object", "dict": "object"}
_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType()}
CONVERTERS = {"chinese_to_pinyin": place_name}


class SchemaError(ValueError):
    """A schema that cannot be compiled."""


@dataclass
class Field:
    name: str
    kind: str = "string"
    choices: list[str] | None = None
    many: bool = False
    items: "Field | None" = None
    properties: list["Field"] = _field(default_factory=list)
    optional: bool = False
    case_sensitive: bool = True
    unique: bool = True
    minimum: float | None = None
    maximum: float | None = None
    exclusive_minimum: float | None = None
    exclusive_maximum: float | None = None
    multiple_of: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_items: int | None = None
    max_items: int | None = None
    pattern: str | None = None
    default: Any = None
    description: str | None = None
    lang: str | None = None
    convert: str | None = None

    @property
    def data_type(self) -> T.DataType:
        if self.many:
            return T.ArrayType(T.StringType())
        if self.choices:
            return T.StringType()
        if self.kind == "array":
            return T.ArrayType(self.items.data_type if self.items else T.StringType())
        if self.kind == "object":
            return T.StructType([T.StructField(p.name, p.data_type) for p in self.properties]) if self.properties else T.MapType(T.StringType(), T.StringType())
        return _TYPES[self.kind]

    def instructions(self) -> str:
        """The field's form in words."""
        if self.choices:
            names = ", ".join(json.dumps(x, ensure_ascii=False) for x in self.choices)
            out = f"a JSON array of values from {names}" if self.many else f"exactly one of {names}, spelt as here"
        else:
            out = {"string": "text", "integer": "a whole number", "float": "a number", "boolean": "true or false", "array": "a JSON array", "object": "a JSON object"}[self.kind]
        told = [(self.minimum, "at least {}"), (self.maximum, "at most {}"), (self.min_length, "at least {} characters"), (self.max_length, "at most {} characters"), (self.min_items, "at least {} items"), (self.max_items, "at most {} items"), (self.pattern, "matching {}"), (self.lang and {"zh": "Chinese", "en": "English"}.get(self.lang, self.lang), "in {}"), (self.unique and self.many or None, "none of them twice"), (self.optional or None, "null if unknown"), (self.description, "{}")]
        return "; ".join([out, *[text.format(v) for v, text in told if v is not None]])

    # Raw values arrive as the text of their JSON value.
    def value(self, raw: Column) -> Column:
        """The typed value, null where it cannot be one. Converted last."""
        if self.many:
            out = answers.enum_list_answer(raw, self.choices, self.case_sensitive, self.min_items or 0, self.max_items, self.unique)["value"]
        elif self.choices:
            out = answers.enum_answer(raw, self.choices, self.case_sensitive)["value"]
        elif self.kind in ("array", "object"):
            out = F.from_json(raw, self.data_type)
        elif self.kind == "string":
            out = raw
        else:
            out = answers.lax(raw, self.kind)
        if self.default is not None:
            out = F.coalesce(out, F.when(raw.isNull(), F.lit(self.default)))
        if self.convert and self.convert in CONVERTERS:
            change = CONVERTERS[self.convert]
            out = F.transform(out, change) if isinstance(self.data_type, T.ArrayType) else change(out)
        return out

    def errors(self, raw: Column) -> Column:
        """Array of messages for this field; empty when it is good."""
        value, name = self.value(raw), self.name
        checks: list[tuple[Column, str]] = []
        missing = raw.isNull() if self.default is None else F.lit(False)
        wrong = value.isNull() & raw.isNotNull()
        if isinstance(self.data_type, T.ArrayType):
            size = F.size(value)
            checks += [(size < self.min_items, f"{name}: fewer than {self.min_items} items")] if self.min_items else []
            checks += [(size > self.max_items, f"{name}: more than {self.max_items} items")] if self.max_items is not None else []
            checks += [(F.size(F.array_distinct(value)) < size, f"{name}: repeated items")] if self.unique and not self.many and self.kind == "array" and getattr(self, "_unique_items", False) else []
            lang = self.lang or (self.items.lang if self.items else None)
            if lang:
                checks.append((~F.forall(value, lambda x: language_fits(x, lang)), f"{name}: an item is not in language {lang}"))
        elif isinstance(self.data_type, T.StringType):
            n = F.length(value)
            checks += [(n < self.min_length, f"{name}: shorter than {self.min_length}")] if self.min_length else []
            checks += [(n > self.max_length, f"{name}: longer than {self.max_length}")] if self.max_length is not None else []
            checks += [(~value.rlike(self.pattern), f"{name}: does not match the pattern")] if self.pattern else []
            checks += [(~language_fits(value, self.lang), f"{name}: not in language {self.lang}")] if self.lang else []
        elif self.kind in ("integer", "float"):
            for limit, bad, text in (
                (self.minimum, lambda v, x: v < x, "below"),
                (self.maximum, lambda v, x: v > x, "above"),
                (self.exclusive_minimum, lambda v, x: v <= x, "not above"),
                (self.exclusive_maximum, lambda v, x: v >= x, "not below"),
                (self.multiple_of, lambda v, x: v % F.lit(x) != 0, "not a multiple of"),
            ):
                if limit is not None:
                    checks.append((bad(value, limit), f"{name}: {text} {limit}"))
        found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks]
        found.append(F.when(wrong, F.lit(f"{name}: not a valid {'choice' if self.choices else self.kind}")))
        if not self.optional:
            found.append(F.when(missing, F.lit(f"{name}: missing")))
        return F.filter(F.array(*found), lambda x: x.isNotNull())


_CONSTRAINTS = {"minimum": "minimum", "maximum": "maximum", "exclusiveMinimum": "exclusive_minimum", "exclusiveMaximum": "exclusive_maximum", "multipleOf": "multiple_of", "minLength": "min_length", "maxLength": "max_length", "minItems": "min_items", "maxItems": "max_items", "min_items": "min_items", "max_items": "max_items", "pattern": "pattern", "default": "default", "description": "description", "lang": "lang", "convert": "convert", "case_sensitive": "case_sensitive", "unique_items": "unique"}


def compile_field(name: str, spec: Any, optional: bool = False) -> Field:
    if isinstance(spec, list):
        return Field(name, choices=[str(x) for x in spec], optional=optional)
    if isinstance(spec, str):
        spec = {"type": spec}
    if not isinstance(spec, dict):
        raise SchemaError(f"{name}: a field is a kind, a list of choices or a mapping")
    more = {_CONSTRAINTS[k]: v for k, v in spec.items() if k in _CONSTRAINTS}
    optional = optional or bool(spec.get("optional") or spec.get("nullable"))
    if "convert" in more and more["convert"] not in CONVERTERS:
        raise SchemaError(f"{name}: unknown converter {more['convert']}")
    for key, many in (("enum_list", True), ("enum", False)):
        if key in spec:
            choices = spec[key]
            if isinstance(choices, dict):
                more |= {_CONSTRAINTS[k]: v for k, v in choices.items() if k in _CONSTRAINTS}
                choices = choices.get("choices")
            if not choices:
                raise SchemaError(f"{name}: no choices")
            return Field(name, choices=[str(x) for x in choices], many=many, optional=optional, **more)
    kind = _KINDS.get(str(spec.get("type", "string")).lower())
    if kind is None:
        raise SchemaError(f"{name}: unknown type {spec['type']}")
    if spec.get("choices"):
        return Field(name, choices=[str(x) for x in spec["choices"]], optional=optional, **more)
    out = Field(name, kind, optional=optional, **more)
    if "uniqueItems" in spec:
        out._unique_items = bool(spec["uniqueItems"])  # type: ignore[attr-defined]
    if kind == "array" and "items" in spec:
        out.items = compile_field("item", spec["items"])
    if kind == "object" and spec.get("properties"):
        required = spec.get("required")
        out.properties = [compile_field(k, v, required is not None and k not in required) for k, v in spec["properties"].items()]
    return out


@dataclass
class Schema:
    fields: list[Field]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type) for f in self.fields])

    @property
    def is_simple(self) -> bool:
        return len(self.fields) == 1

    def parse(self, raw_json: Column) -> Column:
        """JSON text of an object to a struct (fields..., errors array)."""
        of = lambda f: F.get_json_object(raw_json, f"$['{f.name}']")
        unreadable = F.when(F.try_parse_json(raw_json).isNull(), F.array(F.lit("the answer is not JSON"))).otherwise(F.array().cast("array<string>"))
        errors = F.concat(unreadable, *[f.errors(of(f)) for f in self.fields])
        return F.struct(*[f.value(of(f)).alias(f.name) for f in self.fields], errors.alias("errors"))

    def instructions(self) -> str:
        """What a prompt for free text says about the form of the answer."""
        if not self.is_simple:
            return "Answer with one JSON object and nothing else. It has these keys:\n" + "\n".join(f"- {f.name}: {f.instructions()}" for f in self.fields)
        return f"Answer with the value alone, without explanation: {self.fields[0].instructions()}"

    def output_tokens(self) -> int:
        """Estimated tokens of one answer: 50, and for each field by its kind. A field of choices counts as short text."""
        total = 50
        for f in self.fields:
            if isinstance(f.data_type, T.ArrayType) and not f.many:
                total += 10 * (f.max_items if f.max_items is not None else 5)
            elif isinstance(f.data_type, T.StringType) or f.many:
                total += (f.max_length if f.max_length is not None else 100) // 8
            else:
                total += 5
        return total


def complexity(spec: Any) -> dict[str, Any]:
    """How a schema is stored: one field goes into a column, several into a table of their own."""
    names = compile_schema(spec).names if isinstance(spec, dict) and spec else []
    return {"field_count": len(names), "is_simple": len(names) == 1, "is_complex": len(names) > 1, "field_names": names, "requires_separate_table": len(names) > 1}


def compile_schema(spec: Any, output: str | None = None, all_optional: bool = False) -> Schema:
    """A mapping of fields, or a single field that takes the name ``output``."""
    single = not isinstance(spec, dict) or bool({"enum", "enum_list"} & set(spec)) or isinstance(spec.get("type"), str) and spec["type"] in _KINDS and set(spec) <= {"type", "choices", "optional", "nullable", "items", "properties", "required", *_CONSTRAINTS}
    if single:
        return Schema([compile_field(output or "value", spec, all_optional)])
    all_optional = all_optional or bool(spec.get("all_fields_optional"))
    body = spec.get("fields") if isinstance(spec.get("fields"), dict) else {k: v for k, v in spec.items() if k != "all_fields_optional"}
    if not body:
        raise SchemaError("the schema has no fields")
    return Schema([compile_field(k, v, all_optional) for k, v in body.items()])
