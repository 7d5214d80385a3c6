import textwrap

import pytest
from pyspark.sql import functions as F, types as T

from docweave.plans.schema import SchemaError, compile_schema
from docweave.sources import config as cf


def parse(spark, schema, *answers):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    return [r.p for r in rows.select("i", schema.parse(F.col("a")).alias("p")).orderBy("i").collect()]


def test_types():
    s = compile_schema({"a": "string", "b": {"type": "integer"}, "c": "number", "d": {"type": "boolean"}, "e": {"type": "array", "items": {"type": "integer"}}, "f": ["x", "y"], "g": {"enum_list": ["x"]}, "h": {"type": "object", "properties": {"n": "integer"}}, "i": "dict"})
    assert [f.dataType for f in s.struct] == [T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.ArrayType(T.LongType()), T.StringType(), T.ArrayType(T.StringType()), T.StructType([T.StructField("n", T.LongType())]), T.MapType(T.StringType(), T.StringType())]


def test_constraints(spark):
    s = compile_schema({"year": {"type": "integer", "minimum": 2000, "maximum": 2025}, "name": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}, "tags": {"type": "array", "items": {"type": "string", "lang": "zh"}, "maxItems": 2}, "note": {"type": "string", "optional": True}, "kind": {"type": "string", "default": "x"}})
    good, bad, none = parse(spark, s, '{"year": "2020", "name": "abc", "tags": ["中"]}', '{"year": 1999, "name": "ABCDE", "tags": ["a", "中", "文"]}', "nothing")
    assert (good.year, good.name, good.tags, good.note, good.kind, good.errors) == (2020, "abc", ["中"], None, "x", [])
    assert sorted(bad.errors) == ["name: does not match the pattern", "name: longer than 4", "tags: an item is not in language zh", "tags: more than 2 items", "year: below 2000"]
    assert "the answer is not JSON" in none.errors


def test_choices_and_conversion(spark):
    s = compile_schema({"tone": {"enum": ["Good", "bad"], "case_sensitive": False}, "topics": {"enum_list": ["a", "b"], "max_items": 1}, "place": {"type": "string", "convert": "chinese_to_pinyin"}})
    one, two = parse(spark, s, '{"tone": "GOOD", "topics": ["a", "a"], "place": "四川省"}', '{"tone": "ugly", "topics": ["a", "b"], "place": "x"}')
    assert (one.tone, one.topics, one.place, one.errors) == ("Good", ["a"], "Sichuan Province", [])
    assert sorted(two.errors) == ["tone: not a valid choice", "topics: not a valid choice"]


def test_whole_schemas_that_are_one_field():
    assert compile_schema("boolean", "ok").names == ["ok"]
    assert compile_schema(["a", "b"], "kind").fields[0].choices == ["a", "b"]
    f = compile_schema({"enum_list": ["a", "b"], "min_items": 1}, "kinds").fields[0]
    assert (f.name, f.many, f.min_items) == ("kinds", True, 1)
    assert compile_schema({"enum": ["a"]}, "lang").names == ["lang"]
    for wrong in ({"a": {"enum": []}}, {"a": "colour"}, {"a": {"type": "string", "convert": "nope"}}, {}):
        with pytest.raises(SchemaError):
            compile_schema(wrong)


def test_output_tokens():
    # A field of choices alone counts as short text.
    assert compile_schema({"a": "string", "b": {"type": "array", "maxItems": 3}, "c": "integer", "d": {"enum": ["x"]}}).output_tokens() == 50 + 12 + 30 + 5 + 12


YAML = """
    default_model: gpt-4o-mini
    sql_queries: !import queries.yml
    system_prompts: {strict: Be strict.}
    tables: {a: {}, b: {}}
    home: ${DOCWEAVE_TEST_HOME}
    enrichments:
      - name: one
        query: recent
        prompt: What?
        schema: boolean
        output_column: ok
        system_prompt: strict
      - name: two
        table: all
        prompt: What?
        output_table: two
        model: gpt-4o, gpt-4o-mini
        input: {input_columns: ["content:100"]}
        schema: {x: {type: number}, y: [p, q]}
      - name: bad
        table: a
        prompt: What?
        schema: {x: string, y: string}
        temperature: 3
"""


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("DOCWEAVE_TEST_HOME", "here")
    (tmp_path / "queries.yml").write_text("recent: SELECT * FROM documents\n")
    (tmp_path / "c.yml").write_text(textwrap.dedent(YAML))
    (tmp_path / "more.txt").write_text("appended")
    c = cf.load_config(str(tmp_path / "c.yml"))
    assert c["home"] == "here"
    one, two = (cf.plan_task(t, c) for t in c["enrichments"][:2])
    assert (one.query, one.storage, one.output_column, one.system, one.models) == ("SELECT * FROM documents", "direct_column", "ok", "Be strict.", ["gpt-4o-mini"])
    assert (two.tables, two.storage, two.models, two.inputs) == (["a", "b"], "separate_table", ["gpt-4o", "gpt-4o-mini"], ["content:100"])
    with pytest.raises(cf.ConfigError, match="output_table"):
        cf.plan_task(c["enrichments"][2], c)
    assert [t["name"] for t in cf.choose_tasks(c, "two, one two")] == ["one", "two"]
    assert len(cf.choose_tasks(c, None)) == 3
    with pytest.raises(cf.ConfigError, match="did you mean"):
        cf.choose_tasks(c, "tow")
    problems = cf.lint(c)
    assert any("number" in p for p in problems) and any("temperature" in p for p in problems) and any("output_table" in p for p in problems)
    assert cf.with_appended_file("p", "more.txt", str(tmp_path)) == "p\n\nappended" and cf.with_appended_file("p", None, "") == "p"
