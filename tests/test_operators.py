import datetime

import pytest
from pyspark.sql import functions as F

from docweave.operators import assembly as asm, enrichment as enr, providers, search, selection as sel, storage as st
from docweave.plans import sql as user_sql
from docweave.plans.schema import compile_schema, complexity



def NOW():  # noqa: N802 - a constant that needs a session
    return F.lit(datetime.datetime(2024, 1, 1))


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# Selection.


def test_input_columns(spark):
    assert [sel.parse_input(x) for x in ("a", "a:10", "t.a:5", "a:-1", "a:x", "a:0", "a:1:2")] == [("a", None), ("a", 10), ("t.a", 5), ("a", None), ("a", None), ("a", None), ("a", None)]
    assert sel.parse_slice("a[1:3]") == ("a", 1, 3) and sel.parse_slice("a") == ("a", None, None)
    assert [one(spark, sel.sliced(F.lit("abcdef"), *s)) for s in ((1, 3), (None, 2), (-2, None), (4, 1))] == ["bc", "ab", "ef", ""]
    df = spark.createDataFrame([("héllo", None, 3)], "a string, b string, n int")
    assert tuple(sel.with_limits(df, ["a:2", "t.a", "b", "n", "missing"]).first()) == ("hé", "héllo", "", "3", "")


def test_modes(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "done", "x"), (3, None, "y")], "doc_id int, out string, g string")
    ids = lambda **k: [r.doc_id for r in sel.select_rows(df, output="out", **k).orderBy("doc_id").collect()]
    assert ids() == [1, 3] and ids(mode="overwrite") == [1, 2, 3] and ids(where="g = 'x' OR g = 'y'") == [1, 3]
    assert ids(limit=1) == [1] and ids(limit=0) == [] and ids(key={"doc_id": 2}) == [2]
    with pytest.raises(ValueError):
        ids(key={"doc_id": 2}, limit=1)
    with pytest.raises(ValueError):
        ids(mode="other")


def test_skip_set(spark):
    df = spark.createDataFrame([("a", ""), ("b", "v"), ("c", "v"), ("d", None), (None, None)], "sha1 string, direct string")
    audit = spark.createDataFrame([("a", "t", "m", None), ("b", "t", "m", "failed"), ("c", "other", "m", None), (None, "t", "m", None)], "sha1 string, enrichment_name string, model_used string, error string")
    keys = lambda **k: sorted((r.sha1 or "-") for r in sel.skip_done(df, audit, "t", "m", **k).collect())
    assert keys() == ["-", "c", "d"]  # failed attempts count, null keys never
    assert keys(retry_failed=True) == ["-", "b", "c", "d"]
    assert keys(direct="direct") == ["-", "d"]
    stored = spark.createDataFrame([("d", "m"), ("c", "m2")], "sha1 string, model_used string")
    assert keys(output=stored) == ["-", "c"]


def test_first_and_new(spark):
    df = sel.add_sha1(spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, "")], "doc_id int, text string"))
    first = sel.first_per_key(df, "sha1", "doc_id")
    assert sorted(r.doc_id for r in first.collect()) == [1, 2] and first.columns == df.columns
    known = first.where("doc_id = 1")
    assert sorted(r.doc_id for r in sel.new_documents(df, known).collect()) == [2, 4]
    assert sel.new_documents(df, known, overwrite=True).count() == 4


def test_file_rules(spark):
    names = {"/in/a.pdf": False, "/in/.b": True, "/in/Thumbs.db": True, "/in/x conflict.txt": True, "/.sync/y/a.txt": True, "/in/A.MP4": True, "/in/server_log.txt": True, "/in/blog.md": True, "/in/catalog.txt": True, "/in/logic.txt": False, "/in/t.txt": True, "/in/Icon\r": True}
    head = "2024-01-01 INFO started\n"
    df = spark.createDataFrame([(k, head if k == "/in/t.txt" else "plain") for k in names], "p string, t string")
    assert {r.p: r.s for r in df.select("p", sel.skip_file(F.col("p"), F.col("t")).alias("s")).collect()} == names
    globs = [("*.pdf", None), ("a*,?.b", "ab*"), (None, "*.b"), ("[!a]*", None)]
    got = [[one(spark, sel.file_globs(F.lit("/d/" + n), *g)) for n in ("a.pdf", "x.b", "ab.c")] for g in globs]
    assert got == [[True, False, False], [True, True, False], [True, False, True], [False, True, False]]


def test_overrides(spark):
    long = "y" * 60
    files = spark.createDataFrame([("/d/a.pdf", "auto"), ("/d/a--ocr.txt", long), ("/d/a--good.txt", "short"), ("/d/a--manual.txt", "m" * 60), ("/d/b.pdf", "b"), ("/e/b--good.txt", long)], "path string, text string")
    assert rows(sel.manual_overrides(files), "path") == [("/d/a.pdf", long, True), ("/d/b.pdf", "b", False)]


def test_metadata(spark):
    df = spark.createDataFrame([({"title": "a", "X-Date-y": "b", "junk": "c"}, {"junk": "kept", "title": "m"}), (None, None)], "a map<string,string>, b map<string,string>")
    got = [r.m for r in df.select(sel.merge_metadata(sel.allowed_metadata(F.col("a")), F.col("b")).alias("m")).collect()]
    assert got == [{"title": "m", "X-Date-y": "b", "junk": "kept"}, {}]
    flat = sel.document_columns(df.select(F.col("a").alias("metadata"), F.lit(1).alias("id")), keys=["title", "no"])
    assert [r.asDict() for r in flat.collect()][0] == {"id": 1, "metadata_title": "a", "metadata_no": ""}


def test_require(spark):
    df = spark.createDataFrame([("a", 1), (" ", 1), ("a", 0), (None, 1)], "s string, n int")
    assert sel.require(df, ["s", "n"]).count() == 1 and sel.require(df, []).count() == 4


def test_windows(spark):
    files = spark.createDataFrame([("d", "html", 9.0, "p1"), ("d", "pdf", None, "p2"), ("d", "pdf", 3.0, "p3"), ("d", "pdf", 5.0, "x--FAILED"), ("e", "pdf", 2.0, "p4"), ("f", "epub", None, "p5"), ("f", "mhtml", None, "p6")], "doi string, file_type string, validation_score double, path string")
    assert [(r.doi, r.path) for r in sel.best_file(files).orderBy("doi").collect()] == [("d", "p3"), ("f", "p6")]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "sha1 string, created_at int, enrichment_id string")
    assert rows(sel.latest_per(log, ["sha1"]), "sha1") == [("a", 2, "z"), ("b", 1, "w")]
    assert [r.enrichment_id for r in sel.newest(log, 2).collect()] == ["z", "y"]


# Assembly.


def test_assemble(spark):
    keys = spark.createDataFrame([("a", "text of a"), ("b", None), (None, "n")], "sha1 string, content string")
    review = spark.createDataFrame([("a", "m2", 2, "late"), ("a", "m1", 1, "early"), (None, "m1", 3, "never")], "sha1 string, model_used string, id int, content string")
    out = asm.assemble(keys, {"review": review}, ["content:4", "review.content", "review.none", "gone.x"])
    assert out.columns == ["sha1", "content", "review.content", "review.none", "gone.x"]
    assert {tuple(r) for r in out.collect()} == {("a", "text", "early", None, None), ("b", None, None, None, None), (None, "n", None, None, None)}
    assert asm.assemble(keys, {"review": review}, ["review.content"], model="m2").where("sha1 = 'a'").first()[1] == "late"


def test_templates(spark):
    f = lambda t, **v: one(spark, asm.fill_template(t, {k.replace("__", "."): F.lit(x) for k, x in v.items()}))
    assert f("{a} and {b} {c}", a="1", b=None) == "1 and  {c}"
    assert f("{a}", a="{b}", b="x") == "x"  # filled in turn
    assert f("{t.a} {a}", t__a="v") == "v v"
    assert f("{rowid}", rowid="9") == "{rowid}"
    assert one(spark, asm.full_prompt("Q", {"a": F.lit("1"), "b": F.lit(None).cast("string")})) == "Q\n\na: 1\nb: "


def test_tokens(spark):
    assert one(spark, asm.estimate_tokens(F.lit("abcdefg"))) == 1
    assert asm.CONTEXT["gpt-4"] == 8192 and one(spark, asm.context_limit("?")) == 8192 and one(spark, asm.context_limit(F.lit("gpt-4o"))) == 128000
    assert one(spark, asm.available_tokens(F.lit("x" * 400), "gpt-4")) == 8192 - 100 - 2000
    assert one(spark, asm.available_tokens(F.lit("x" * 40000), "gpt-4")) == 0


def test_truncation(spark):
    def plain(prompt, text, limit=8192, margin=2000):
        room = limit - margin - len(prompt) // 4
        if len(text) // 4 <= room:
            return text
        if room <= 0:
            return ""
        cut = text[: room * 4]
        at = cut.rfind(" ")
        return cut[:at] if len(cut) < len(text) and at > room * 4 * 0.8 else cut

    for prompt, text in (("p", "short"), ("p" * 24000, "word " * 400), ("p" * 24000, "x" * 2000), ("p" * 40000, "text"), ("p" * 24000, "a" + " " + "b" * 3000), ("p" * 24000, "y" * 771)):
        assert one(spark, asm.truncate_input(F.lit(prompt), F.lit(text), "gpt-4")) == plain(prompt, text)
    long = one(spark, asm.truncate_in_prompt(F.lit("Q: " + "z" * 40000), F.lit("z" * 40000), "gpt-4"))
    assert long.startswith("Q: zzz") and long.endswith("... [TRUNCATED]") and len(long) // 4 <= 8192 - 2000 + 10
    assert one(spark, asm.truncate_in_prompt(F.lit("Q: z"), F.lit("z"), "gpt-4")) == "Q: z"


def test_costs(spark):
    assert asm.price_of("gpt-4o-mini") == (0.15, 0.60) and asm.price_of("o3-mini-2031-01-01") == (1.1, 4.4) and asm.price_of("what") == (2.5, 10.0)
    assert len(asm.PRICES) >= 60 and asm.allowed_model("gemini-2.5-flash") and not asm.allowed_model("what")
    prompts = spark.createDataFrame([("x" * 400,), (None,)], "p string")
    r = asm.estimate_cost(prompts, "p", ["gpt-4o-mini"], 100).first()
    assert (r.n_rows, r.input_tokens, r.output_tokens) == (2, 500, 200) and r.cost == pytest.approx(500 * 0.15e-6 + 200 * 0.6e-6)
    assert asm.estimate_cost_by_sample(10, "x" * 400, "gpt-4o-mini", 100) == pytest.approx(10 * (300 * 0.15 + 100 * 0.6) / 1e6)
    assert asm.needs_confirmation(5.01) and not asm.needs_confirmation(5.0)
    assert asm.estimate_cost(prompts.limit(0), "p", ["gpt-4"], 1).first().input_tokens == 0


def test_messages_and_fan_out(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 0, "system", "s"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    assert rows(asm.flatten_messages(df), "conv_id") == [(1, "Instructions: s\n\nUser: a\n\nAssistant: b"), (2, "User: ")]
    keys = spark.createDataFrame([("a",), ("b",)], "sha1 string")
    done = spark.createDataFrame([("a", "m1"), ("a", "m1"), ("z", "m2")], "sha1 string, model_used string")
    assert asm.fan_out(keys, ["m1", "m2"]).count() == 4
    assert rows(asm.progress(keys, done, ["m1", "m2"]), "model") == [("m1", 1, 1), ("m2", 0, 2)]


# Storage.


def test_upsert(spark):
    old = spark.createDataFrame([("a", "m", 1, "keep"), ("b", "m", 2, "old")], "sha1 string, model_used string, n int, s string")
    new = spark.createDataFrame([("b", "m", None, "new"), ("b", "m2", 5, "x"), ("c", "m", None, "null"), ("a", "m", None, "  ")], "sha1 string, model_used string, n int, s string")
    got = st.upsert_derived(old, new, now=NOW())
    assert [(r.sha1, r.model_used, r.n, r.s, r.updated_at is not None) for r in got.orderBy("sha1", "model_used").collect()] == [("a", "m", 1, "keep", False), ("b", "m", 2, "new", True), ("b", "m2", 5, "x", True)]
    again = st.upsert_derived(got, new, now=NOW())
    assert st.same_rows(got, again)  # a second run changes nothing
    cleared = st.upsert(old, new, ["sha1", "model_used"], clear_nulls=True)
    assert cleared.where("sha1 = 'b' AND model_used = 'm'").first().n is None
    whole = st.upsert(old, new.drop("n"), ["sha1", "model_used"], replace=True)
    assert whole.where("sha1 = 'b' AND model_used = 'm'").first().n is None and whole.where("sha1 = 'a'").first().n is None
    wide = st.upsert(old, spark.createDataFrame([("a", "m", [1])], "sha1 string, model_used string, extra array<int>"), ["sha1", "model_used"])
    assert wide.where("sha1 = 'a'").first().extra == [1]


def test_direct_column(spark):
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "sha1 string, out string")
    new = spark.createDataFrame([("a", "z"), ("b", "null"), ("c", "w")], "sha1 string, out string")
    assert rows(st.update_column(table, new, "out"), "sha1") == [("a", "z", True), ("b", "y", False)]
    assert st.update_column(table, new.withColumnRenamed("out", "fresh"), "fresh").columns == ["sha1", "out", "fresh", "metadata_updated"]


def test_insert(spark):
    table = spark.createDataFrame([("a", "x")], "sha1 string, c string")
    new = spark.createDataFrame([("a", "y", 1), ("b", "z", 2)], "sha1 string, c string, n int")
    assert rows(st.insert_new(table, new), "sha1") == [("a", "x", None), ("b", "z", 2)]
    assert rows(st.insert_new(table, new, overwrite=True), "sha1") == [("a", "y", 1), ("b", "z", 2)]
    with pytest.raises(ValueError):
        st.check_compatible(table.drop("sha1"))


def test_prompt_registry(spark):
    none = spark.createDataFrame([], st.PROMPTS)
    wanted = spark.createDataFrame([("t", "p", None), ("t", "p", ""), ("t", "q", "s")], "enrichment_name string, prompt_text string, system_prompt string")
    first = st.register_prompts(none, wanted, NOW())
    assert first.count() == 2 and st.register_prompts(first, wanted, NOW()).count() == 2
    hash_ = first.where("prompt_text = 'p'").first().prompt_hash
    import hashlib

    assert hash_ == hashlib.sha256(b"t|p|").hexdigest()
    audit = spark.createDataFrame([(first.first().prompt_id, "e1"), (first.first().prompt_id, "e2")], "prompt_id string, enrichment_id string")
    assert sorted(r.n_used for r in st.prompt_usage(first, audit).collect()) == [0, 2]


def test_versioned_table(spark, tmp_path):
    t = st.Table(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "a int").schema)
    assert t.read().count() == 0
    t.append(spark.range(2).select(F.col("id").cast("int").alias("a")))
    before = t.read()
    t.append(spark.createDataFrame([(5, "x")], "a int, b string"))
    assert sorted(r.a for r in t.read().collect()) == [0, 1, 5] and set(t.read().columns) == {"a", "b"}
    t.replace(t.read().where("a > 0"))
    assert sorted(r.a for r in t.read().collect()) == [1, 5] and before.count() == 2  # a reader keeps its version
    with pytest.raises(FileNotFoundError):
        st.Table(spark, f"file://{tmp_path}/none").read()


# Enrichment.


SCHEMA = compile_schema({"tone": {"enum": ["calm", "loud"]}, "score": {"type": "integer", "minimum": 0, "maximum": 10}, "quote": {"type": "string", "lang": "zh", "optional": True}})


class Scripted:
    """Answers by the text; counts nothing, so that it can live in a worker."""

    tries = 0

    def generate_structured(self, prompt, system, model, fields, temperature):
        if "boom" in prompt:
            raise RuntimeError("no service")
        if "prose" in prompt:
            return "I think it is calm"
        if "fence" in prompt:
            return '```json\n{"tone": "loud", "score": 1}\n```'
        if "range" in prompt:
            return '{"tone": "calm", "score": 99}'
        if "latin" in prompt:
            Scripted.tries += 1
            return '{"tone": "calm", "score": 1, "quote": "%s"}' % ("中" if Scripted.tries % 2 == 0 else "latin")
        return '{"tone": "calm", "score": 2}'


def test_run_task(spark, tmp_path):
    docs = spark.createDataFrame([(x, f"the {x} text") for x in ("ok", "boom", "prose", "fence", "range", "latin")], "sha1 string, content string").coalesce(1)
    task = enr.Task("t", "Rate {content}", ["content"], SCHEMA, "m")
    log = st.Table(spark, f"file://{tmp_path}/audit", st.AUDIT)
    got = {r.sha1: (r.tone, r.score, r.quote) for r in enr.run_task(docs, task, log, Scripted).collect()}
    assert got == {"ok": ("calm", 2, None), "fence": ("loud", 1, None), "latin": ("calm", 1, "中")}
    audit = log.read()
    assert audit.count() == 6 and audit.where("sha1 = 'latin'").first().attempt == 2 and audit.select("enrichment_id").distinct().count() == 6
    bad = {r.sha1: r.error for r in enr.rejected(audit, task).collect()}
    assert set(bad) == {"boom", "prose", "range"} and "no service" in bad["boom"] and bad["range"] == "score: above 10"
    left = sel.skip_done(docs, audit, "t", "m")
    assert left.count() == 0 and sel.skip_done(docs, audit, "t", "m", retry_failed=True).count() == 2
    again = enr.run_task(left, task, log, Scripted)
    assert log.read().count() == 6 and again.count() == 3


def test_stub_is_deterministic_and_valid(spark):
    docs = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(30)], "sha1 string, content string")
    schema = compile_schema({"a": {"enum_list": ["x", "y"]}, "b": {"type": "float", "minimum": 0, "maximum": 1}, "c": "boolean", "d": {"type": "integer", "minimum": 1900, "maximum": 2100}, "e": {"type": "array", "items": "string"}, "f": {"type": "string", "lang": "zh"}, "g": "dict"})
    task = enr.Task("t", "{content}", ["content"], schema)
    calls = enr.audited(enr.call_model(enr.with_prompts(docs, task), task), task, now=NOW())
    assert enr.results(calls, task).count() == 30 and enr.rejected(calls, task).count() == 0
    assert st.same_rows(calls, enr.audited(enr.call_model(enr.with_prompts(docs, task), task), task, now=NOW()))
    assert enr.provider_for("stub-2") is enr.StubProvider
    for model in ("anything", "claude-x", "my-stub"):
        with pytest.raises(providers.ModelError):
            enr.provider_for(model)


def test_agreement(spark):
    d = spark.createDataFrame([("a", "m1", "x"), ("a", "m2", "x"), ("b", "m1", "x"), ("b", "m2", "y"), ("c", "m1", "x")], "sha1 string, model_used string, tone string")
    assert rows(enr.agreement(d, "tone", "m1", "m2"), "sha1") == [("a", "x", "x", True), ("b", "x", "y", False)]


def test_translation(spark):
    def translate(lines):
        if "bad" in lines:
            raise RuntimeError("x")
        return [x.upper() for x in lines]

    docs = spark.createDataFrame([(1, "a\n\nb\nc\nd"), (2, "ok\nbad\nx\ny"), (3, None)], "id int, t string")
    import json

    got = {r.id: json.loads(r.lines) for r in enr.translate_lines(docs, "id", "t", translate).collect()}
    assert got == {1: {"1": "A", "2": "B", "3": "C", "4": "D"}, 2: {"1": "", "2": "", "3": "", "4": "Y"}, 3: {}}


# Search and SQL.


def test_search(spark):
    docs = spark.createDataFrame([(1, "The café, the end"), (2, "cafe"), (3, None)], "id int, t string")
    assert [r.id for r in search.search_all(docs, ["THE", "Café"], ["t"]).collect()] == [1]
    p = search.postings(docs, "id", ["t"])
    assert p.where("id = 1 AND term = 'the'").first().tf == 2
    assert [r.id for r in search.bm25(p, "id", ["the", "cafe"], 3, 2.0).collect()] in ([1, 2], [2, 1])


def test_user_sql(spark):
    t = user_sql.translate("SELECT rowid, GROUP_CONCAT(a), 'like rowid' FROM t WHERE a LIKE 'x%' AND b NOT LIKE '%y' AND d > date('now','-30 days')")
    assert t == "SELECT rowid, listagg(a, ','), 'like rowid' FROM t WHERE a ILIKE 'x%' AND b NOT ILIKE '%y' AND d > date_add(current_date(), -30)"
    docs = spark.createDataFrame([(1, "Abc"), (2, "xyz")], "doc_id int, name string")
    run = lambda q, **k: user_sql.run_query(spark, q, {"docs": docs}, **k)
    assert [r.rowid for r in run("SELECT rowid FROM docs WHERE name LIKE 'a%';").collect()] == [1]
    assert user_sql.translate("SELECT 'json_extract(x) date(''now'')', date('now'), GROUP_CONCAT(a, ' like ') FROM t") == "SELECT 'json_extract(x) date(''now'')', current_date(), listagg(a, ' like ') FROM t"
    rows = run("SELECT rowid, * FROM docs")
    assert rows.columns[0] == "rowid" and rows.columns.count("rowid") == 1 and "rowid" not in run("SELECT * FROM docs").columns
    assert run("all", named={"all": "SELECT d.name FROM docs d JOIN docs AS e ON d.doc_id = e.doc_id"}).count() == 2
    assert run("WITH c AS (SELECT * FROM docs) SELECT count(*) AS n FROM c").first().n == 2
    assert run("SELECT docs.name FROM docs ORDER BY docs.name LIMIT 1").first().name == "Abc"
    assert run("SELECT x FROM VALUES (1) v(x)").first().x == 1
    with pytest.raises(ValueError):
        run("DROP TABLE docs")


# Providers and free text.


def test_services_speak_their_protocols(monkeypatch):
    seen = []

    def chat(url, headers, body):
        seen.append((url, headers, body))
        return {"choices": [{"message": {"content": '{"tone": "calm"}'}}]}

    def gemini(url, headers, body):
        seen.append((url, headers, body))
        return {"candidates": [{"content": {"parts": [{"text": "ca"}, {"text": "lm"}]}}]}

    for name in ("OPENAI_API_KEY", "GEMINI_API_KEY", "GOOGLE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(providers.ModelError, match="OPENAI_API_KEY"):
        providers.service("gpt-4o")
    monkeypatch.setenv("OPENAI_API_KEY", "k1")
    monkeypatch.setenv("GOOGLE_API_KEY", "k2")
    fields = [{"name": "tone", "kind": "string", "choices": ["calm", "loud"], "many": False}, {"name": "n", "kind": "integer", "minimum": 1}]
    one = providers.service("gpt-4o", chat)()
    assert one.generate_structured("p", "s", "gpt-4o", fields, 0.5) == '{"tone": "calm"}' and one.max_context_tokens("gpt-4") == 8192 and one.count_tokens("x" * 40, "gpt-4o") == 10
    url, headers, body = seen[-1]
    assert url.startswith("https://api.openai.com/") and headers == {"Authorization": "Bearer k1"} and [m["role"] for m in body["messages"]] == ["system", "user"] and body["temperature"] == 0.5
    assert body["response_format"]["json_schema"]["schema"]["properties"] == {"tone": {"type": "string", "enum": ["calm", "loud"]}, "n": {"type": "integer", "minimum": 1}}
    other = providers.service("gemini-2.5-flash", gemini)()
    assert other.generate_text("p", "s", "gemini-2.5-flash") == "calm"
    url, headers, body = seen[-1]
    assert "gemini-2.5-flash:generateContent" in url and headers == {"x-goog-api-key": "k2"} and body["systemInstruction"]["parts"][0]["text"] == "s"
    with pytest.raises(providers.ModelError, match="no answer"):
        providers.OpenAIProvider("k", lambda *a: {"choices": []}).generate_text("p")


class Talker(enr.StubProvider):
    def generate_text(self, prompt, system=None, model="stub", temperature=0.0):
        assert "exactly one of" in prompt
        return next(v for k, v in {"fence": "```\n\"loud\"\n```", "plain": "calm", "object": 'so: {"tone": "loud"}', "wrong": "rather calm"}.items() if k in prompt)


def test_free_text_answers(spark):
    task = enr.Task("t", "Rate {content}", ["content"], compile_schema({"enum": ["calm", "loud"]}, "tone"), "stub", free_text=True)
    docs = spark.createDataFrame([(x, f"the {x} text") for x in ("fence", "plain", "object", "wrong")], "sha1 string, content string")
    calls = enr.call_model(enr.with_prompts(docs, task), task, Talker)
    audit = enr.audited(calls, task, run="r1")
    assert {r.sha1: r.tone for r in enr.results(audit, task).collect()} == {"fence": "loud", "plain": "calm", "object": "loud"}
    assert audit.first().enrichment_id != enr.audited(calls, task, run="r2").first().enrichment_id
    two = compile_schema({"a": "integer", "b": {"enum_list": ["x", "y"]}})
    assert two.instructions().count("\n") == 2 and "a JSON array of values from" in two.instructions()
    assert complexity({"a": "string"})["is_simple"] and complexity({"a": "string", "b": "string"})["requires_separate_table"] and complexity(None)["field_count"] == 0


# Versions of a table.


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    row = lambda n: spark.createDataFrame([(n,)], "n int")
    a, b = st.Table(spark, path), st.Table(spark, path)
    a.append(row(1))
    real, raced = a._pointer, []

    def slow():
        found = real()
        if not raced:
            raced.append(b.append(row(2)))  # the other writer comes between
        return found

    a._pointer = slow
    assert [r.n for r in a.append(row(3)).collect()] == [3]
    a._pointer = real
    assert sorted(r.n for r in a.read().collect()) == [1, 2, 3]
    old = a.read()
    b.append(row(4))
    with pytest.raises(st.Conflict):
        a.replace(old)
    a.replace(a.read().where("n > 2"))
    assert sorted(r.n for r in b.read().collect()) == [3, 4]


def test_old_versions_go(spark, tmp_path):
    t = st.Table(spark, f"file://{tmp_path}/t")
    t.KEEP = 3
    for n in range(8):
        t.append(spark.createDataFrame([(n,)], "n int"))
    t.compact(above=4)
    assert t.read().count() == 8 and len(t._folders(t._versions()[-1])) == 1
    for _ in range(4):
        t.replace(t.read())
    assert len(t._versions()) == 3 and len([x for x in t._names("") if x.startswith("v-")]) == 3 and t.read().count() == 8
