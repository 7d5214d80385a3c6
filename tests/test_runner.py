import textwrap

import pytest

from docweave import __main__ as cli
from docweave.plans import runner
from docweave.sources.config import ConfigError, load_config

CONFIG = """
    sql_queries: {all: "SELECT rowid, * FROM documents", short: "SELECT sha1, content FROM documents WHERE content LIKE '%SHORT%'"}
    enrichments:
      - name: tone
        query: "SELECT * FROM documents"
        prompt: "Tone of {content}"
        input_columns: ["content:100"]
        schema: {enum: [calm, loud]}
        output_column: tone
      - name: facts
        table: documents
        prompt: Facts
        input_columns: [content, documents.filename]
        output_table: facts
        model: stub, stub-2
        schema: {year: {type: integer, minimum: 1900, maximum: 2100}, ok: boolean}
      - name: review
        table: documents
        prompt: "Check {facts.year}"
        input_columns: ["facts.year", "content:5"]
        output_table: review
        schema: {good: boolean, note: {type: string, optional: true}}
    exports:
      notes: {query: "SELECT d.sha1, d.filename, f.year FROM documents d JOIN facts f ON d.sha1 = f.sha1 WHERE f.model_used = 'stub'", template: "year {{ year }}", output_naming: "{filename}", required_fields: [year], formats: [md, csv], output_dir: out}
"""


@pytest.fixture
def ws(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    for i in range(5):
        (docs / f"d{i}.txt").write_text(f"document number {i} " + ("short" if i == 0 else "with a longer text"))
    (tmp_path / "c.yml").write_text(textwrap.dedent(CONFIG))
    w = runner.Workspace(spark, str(tmp_path / "ws"))
    assert runner.ingest(w, str(docs), fulltext=True) == {"success": 5, "failed": 0}
    return w


def test_lifecycle(spark, ws, tmp_path):
    config = load_config(str(tmp_path / "c.yml"))
    assert runner.ingest(ws, str(tmp_path / "in")) == {"success": 0, "failed": 0}  # nothing is new
    assert ws.table("documents").read().count() == 5
    assert runner.ingest(ws, str(tmp_path / "in"), overwrite=True)["success"] == 5 and ws.table("documents").read().count() == 5
    assert ws.table("documents_fts").read().where("term = 'short'").count() == 1

    first = runner.enrich(ws, config, "tone,facts")
    assert [(o.task, o.model, o.n_rows, o.n_results) for o in first] == [("tone", "stub", 5, 5), ("facts", "stub", 5, 5), ("facts", "stub-2", 5, 5)]
    assert {r.tone for r in ws.table("documents").read().collect()} <= {"calm", "loud"}
    facts = ws.table("facts").read()
    assert facts.count() == 10 and dict(facts.dtypes)["year"] == "bigint"
    assert [o.n_rows for o in runner.enrich(ws, config, "tone,facts")] == [0, 0, 0]  # a second run finds nothing to do
    assert ws.table("enrichment_responses").read().count() == 15 and ws.table("prompts").read().count() == 2

    again = runner.enrich(ws, config, "facts", model="stub", overwrite=True)
    assert again[0].n_rows == 5 and ws.table("facts").read().count() == 10 and ws.table("enrichment_responses").read().count() == 20
    stopped = runner.enrich(ws, config, "review", threshold=0.0)
    assert stopped[0].stopped and not ws.has("review")
    done = runner.enrich(ws, config, "review", threshold=0.0, confirm=lambda cost: True, limit=2)
    assert done[0].n_results == 2 and ws.table("review").read().count() == 2
    prompt = ws.table("enrichment_responses").read().where("enrichment_name = 'review'").first().full_prompt
    assert prompt.startswith("Check ") and "{facts.year}" not in prompt and "content: docum" in prompt

    assert runner.export(ws, config, folder=str(tmp_path)) == {"notes": 10}
    assert (tmp_path / "out/d1.txt.md").read_text().startswith("year ")
    assert runner.query(ws, "short", config).count() == 1
    with pytest.raises(ConfigError):
        runner.export(ws, config, "nothing")
    with pytest.raises(ConfigError):
        runner.enrich(ws, config, "nothing")


def test_command_line(spark, ws, tmp_path, capsys):
    config, root = str(tmp_path / "c.yml"), str(tmp_path / "ws")
    assert cli.main(["lint", config]) == 0
    assert cli.main(["ingest", root, str(tmp_path / "in")]) == 0
    assert cli.main(["enrich", root, config, "--enrichments", "tone", "--limit", "3"]) == 0
    assert cli.main(["query", root, "SELECT count(*) AS n FROM documents WHERE tone IS NOT NULL", "--config", config]) == 0
    assert "|3" in capsys.readouterr().out
    assert cli.main(["enrich", root, config, "--enrichments", "zzz"]) == 2
    assert cli.main(["query", root, "DROP TABLE documents"]) == 2


def test_models_columns_and_row_ids(spark, ws, tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    base = {"prompt": "x {content}", "input_columns": ["content"], "schema": {"enum": ["a", "b"]}, "output_table": "o", "table": "documents"}
    go = lambda more, **k: runner.enrich(ws, {"enrichments": [{"name": "t", **base, **more}]}, **k)
    with pytest.raises(ConfigError, match="unknown model"):
        go({"model": "no-such-model"})
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        go({"model": "gpt-4o"})
    with pytest.raises(ConfigError, match="no input column nothing"):
        go({"input_columns": ["content", "nothing"]})
    with pytest.raises(ConfigError, match="facts.year"):
        go({"input_columns": ["facts.year"]})
    # No key in the query, but row ids; results are logged.
    done = go({"query": "SELECT rowid, content FROM documents", "model": "stub"}, log_updates=True)
    assert done[0].n_results == 5 and spark.read.json(done[0].updates).count() == 5
    assert {r.sha1 for r in ws.table("o").read().collect()} == {r.sha1 for r in ws.table("documents").read().collect()}
    assert runner.query(ws, "SELECT rowid, * FROM documents").columns[0] == "rowid"
    go({"model": "stub"}, overwrite=True)
    audit = ws.table("enrichment_responses").read()
    assert audit.count() == audit.select("enrichment_id").distinct().count() == 10
