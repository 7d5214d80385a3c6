import csv
import glob
import hashlib
import io
import json
import os
import textwrap
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.operators.storage import Table
from docweave.sources import export as ex, extract as xt, files as fl, plugins as pl, programs as pr
from docweave.streaming import ingest as stream

HTML = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style><script>var t="</p>";</script></head><body><!-- BODY --><h1>Head <em>line</em></h1><p>One\n  two<br>three</p><div>in<span>line</span></div><noscript>no</noscript><ul><li>x<li>y</ul>tail</body></html>'


def docx(*paragraphs, table=(), title=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
        if title:
            z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
    return buf.getvalue()


def epub():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns="v"><manifest><item id="a" href="z.html"/><item id="b" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/z.html", "<p>first</p>")
        z.writestr("OPS/a.html", "<p>second</p>")
    return buf.getvalue()


MHTML = textwrap.dedent("""\
    From: <Saved by Browser>
    Snapshot-Content-Location: https://example.org/page
    Subject: =?utf-8?Q?Caf=C3=A9?=
    Date: Mon, 1 Jan 2024 00:00:00 -0000
    MIME-Version: 1.0
    X-Other-Thing: v
    Content-Type: multipart/related; type="text/html"; boundary="--B"

    ----B
    Content-Type: text/html
    Content-Transfer-Encoding: quoted-printable

    <html><head><link rel=3D"stylesheet" href=3D"cid:s"><title>T</title></head><body><script>bad()</script><p>Caf=C3=A9 au lait</p></body></html>
    ----B
    Content-Type: text/css
    Content-Location: cid:s

    p{color:red}
    ----B--
    """).encode()


def test_html():
    assert xt.html_title(HTML) == "A & B" and xt.html_title(None) == "" and xt.html_title("<p>x") == ""
    assert xt.html_text(HTML).split("\n") == ["A & B", "Head", "line", "One", "  two".strip(), "three", "in", "line", "no", "x", "y", "tail"] or xt.html_text(HTML).split("\n") == ["A & B", "Head", "line", "One", "  two", "three", "in", "line", "no", "x", "y", "tail"]
    assert xt.html_smart(HTML) == "A & B\nHead line\n\nOne two\nthree\n\nin line\nx\ny\ntail"
    assert xt.html_smart("<p>cafÃ©</p><p></p><p>b") == "café\n\nb"
    assert xt.html_smart("") == "" and xt.html_text("a < b") == "a < b"


def test_html_references(spark, tmp_path):
    from docweave.plans import catalog

    page = "<title>{0}</title><p>{0}</p>"
    cut = {"R&amp;D &amp": ("R&D &amp", "R&D &"), "x&ampy; &lt": ("x&ampy; &lt", "x&y; <"), "a & b &a &": ("a & b &a &",) * 2, "&copy; &#38; &#x26;&nosuch;": ("© & &&nosuch;",) * 2, "&amp;amp": ("&amp",) * 2}
    pages = [page.format(x) for x in cut]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    read = lambda f: [r[1] for r in f(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert read(catalog.html_title) == [x for x, _ in cut.values()]
    assert read(catalog.html_default) == read(catalog.html_smart) == [f"{x}\n{x}" for x, _ in cut.values()]
    # Files are read as HTML has it.
    assert [xt.html_title(x) for x in pages] == [x for _, x in cut.values()] and [xt.html_text(x) for x in pages] == [xt.html_smart(x) for x in pages] == [f"{x}\n{x}" for _, x in cut.values()]


def test_documents():
    assert xt.docx_text(docx("one", "", "two", table=[("a", "b"), ("c", "d")])) == "one\ntwo\na | b\nc | d"
    assert xt.docx_title(docx("para", title="T")) == "T" and xt.docx_title(docx("para " * 40))[:5] == "para "
    assert xt.epub_text(epub()) == "first\n\nsecond"
    assert xt.extract(".txt", " é \n".encode("cp1252")) == ("é", None)
    assert xt.extract(".xyz", b"")[1] == ".xyz: unsupported"
    assert xt.extract(".txt", None) == (None, "no text in it") and "BadZipFile" in xt.extract(".docx", b"no")[1]
    xt.register_extractor(".FOO", lambda b: "foo")
    assert xt.extract(".foo", b"") == ("foo", None)


def test_mhtml():
    html = xt.mhtml_html(MHTML)
    assert "<style>p{color:red}" in html and "bad()" not in html
    assert xt.extract(".mhtml", MHTML)[0].endswith("Café au lait")
    m = xt.mhtml_metadata(MHTML)
    assert (m["original_url"], m["source_url"], m["mhtml_boundary"], m["mhtml_x_other_thing"], m["mhtml_subject_decoded"], m["save_date"][:3]) == ("https://example.org/page", "https://example.org/page", "--B", "v", "Café", "Mon")
    archive = b'<html><head><meta name="X-Archive-Original-URL" content="http://a/"><meta name="X-Archive-Title" content="T"></head></html>'
    assert xt.mhtml_metadata(archive)["x_archive_original_url"] == "http://a/" and xt.mhtml_metadata(archive)["title"] == "T"
    assert xt.mhtml_html(b"junk <html><p>x</p></html>") == "<html><p>x</p></html>"


@pytest.fixture
def folder(tmp_path):
    def put(name, data):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("a.txt", "Some text\n-----\nmore!!!!!!")
    put("sub/copy.md", "Some text\n-----\nmore!!!!!!")
    put("page.html", HTML)
    put("doc.docx", docx("one"))
    put("bad.docx", b"broken")
    put("film.mp4", b"x")
    put(".hidden", "x")
    put("manifest.json", json.dumps({"page.html": {"title": "From manifest", "n": 3}, "gone.txt": {"x": True}}))
    return str(tmp_path / "in")


def test_ingest(spark, folder):
    docs = {r.filename: r for r in fl.ingest(spark, folder).collect()}
    assert set(docs) == {"a.txt", "page.html", "doc.docx", "bad.docx"}
    assert docs["a.txt"].content == "Some text\nmore!!" and docs["a.txt"].sha1 == hashlib.sha1(b"Some text\n-----\nmore!!!!!!").hexdigest()
    assert docs["page.html"].metadata == {"title": "From manifest", "n": "3"} and docs["bad.docx"].status == "failed" and docs["bad.docx"].content is None
    assert {r.status: r.n for r in fl.counters(fl.ingest(spark, folder)).collect()} == {"success": 3, "failed": 1}
    known = spark.createDataFrame([(docs["a.txt"].sha1,)], "sha1 string")
    assert {r.filename for r in fl.ingest(spark, folder, known=known).collect()} == {"page.html", "doc.docx", "bad.docx"}
    assert fl.ingest(spark, folder, known=known, overwrite=True).count() == 4
    assert [r.metadata["title"] for r in fl.ingest(spark, folder, include="*.html", manifest="").collect()] == ["A & B"]
    assert {r.filename for r in fl.ingest(spark, folder, include="*.txt,*.docx", exclude="bad*").collect()} == {"a.txt", "doc.docx"}
    assert [r.filename for r in fl.ingest(spark, folder, limit=1).collect()] == ["a.txt"]  # hidden files are not even listed
    assert fl.ingest(spark, folder, limit=0).count() == 0
    assert {r.content for r in fl.ingest(spark, folder, include="*.html", html="smart").collect()} == {"A & B\nHead line\nOne two\nthree\nin line\nx\ny\ntail"}


@pytest.mark.parametrize("text", ["[1]", "{", '{"a": 1}', '{"a": {"b": []}}'])
def test_bad_manifests(spark, tmp_path, text):
    (tmp_path / "manifest.json").write_text(text)
    with pytest.raises(ValueError):
        fl.read_manifest(spark, str(tmp_path / "manifest.json"))


def test_plugins(tmp_path, spark):
    for name, body in (("one.py", "class Plugin:\n    name = 'x'\n    v = 1\n"), ("_skip.py", "raise SystemExit"), ("none.py", "a = 1\n")):
        (tmp_path / name).write_text(body)
    other = tmp_path / "more"
    other.mkdir()
    (other / "two.py").write_text("class Plugin:\n    name = 'x'\n    v = 2\n")
    assert pl.discover(str(tmp_path))["x"].v == 1 and pl.discover(str(tmp_path), str(other))["x"].v == 2
    data = tmp_path / "json"
    data.mkdir()
    (data / "a.json").write_text('[{"b": 1, "a": 2}, {"c": 3}]')
    got = {r.record: r.record_id for r in pl.json_records(spark, str(data)).collect()}
    assert got['{"a": 2, "b": 1}'] == hashlib.sha1(b'{"a": 2, "b": 1}').hexdigest() and len(got) == 2


def test_literature(spark):
    author = lambda **k: {"creatorType": "author", **k}
    items = [{"key": "A", "data": {"itemType": "book", "title": "T", "date": "May 1999", "creators": [author(firstName="A", lastName="B"), author(name="Org"), {"creatorType": "editor", "lastName": "E"}], "tags": [{"tag": "x"}], "extra": "@book{key1,"}}, {"key": "N", "data": {"itemType": "note"}}, {"key": "C", "data": {"itemType": "report", "title": "U", "abstractNote": "About"}}]
    files = [{"parent": "A", "key": "f2", "data": {"linkMode": "imported_file", "filename": "b.pdf"}}, {"parent": "A", "key": "f1", "data": {"linkMode": "imported_url", "contentType": "text/html", "filename": "c"}}, {"parent": "C", "key": "f3", "data": {"linkMode": "linked_file", "filename": "d.pdf"}}]
    read = lambda rows, schema: spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")
    got = {r.item_key: r for r in pl.literature(read(items, pl.ITEM), read(files, pl.ATTACHMENT)).collect()}
    assert set(got) == {"A", "C"}
    a = got["A"]
    assert (a.authors, a.year, a.citation_key, a.tags, a.attachment_key, a.status, a.sha1) == ("A B; Org", 1999, "key1", ["x"], "f1", "success", hashlib.sha1(b"A_T").hexdigest())
    assert got["C"].status == "abstract_only"


def test_doi_files(spark):
    cache = spark.createDataFrame([("d1", "pdf"), ("d2", "pdf"), ("d3", "pdf")], "doi string, file_type string")
    projects = spark.createDataFrame([("d1",), ("d2",)], "doi string")
    validation = spark.createDataFrame([("d1#pdf", 4.0)], "validation_key string, validation_score double")
    assert sorted((r.doi, r.validation_score) for r in pl.doi_files(cache, projects, validation).collect()) == [("d1", 4.0), ("d2", None)]


def test_render():
    assert ex.render("{{ a|upper }}{{ none }}{% if x %}Y{% else %}N{% endif %}{% for i in xs %}[{{ i.n }}{% if not i.n %}-{% endif %}]{% endfor %}.", {"a": "b", "x": 0, "xs": [{"n": 1}, {"n": 0}]}) == "BN[1][0-]."
    assert ex.render("{% for i in xs %}{{ i }}{% endfor %}end", {"xs": []}) == "end"
    body = ex.render(ex.PARALLEL, {"title": "T", "sha1": "s", "lines": [{"zh": "中", "en": "en"}]})
    assert body.startswith("---\ntitle: T") and "中\n\n*en*" in body
    page = ex.to_html("---\na: b\n---\n# H <x>\n\ntext **b** *i*", "t")
    assert "<h1>H &lt;x&gt;</h1>" in page and "<p>text <b>b</b> <em>i</em></p>" in page and "a: b" not in page


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a/b", ["x"], 1), ("s2", None, [], 2), ("s3", "c", None, 0)], "sha1 string, title string, tags array<string>, n int")
    done = ex.export_documents(rows, str(tmp_path / "out"), "# {{ title }}\n", "{title}-{n}", required=["n"], formats=("md", "html"))
    assert sorted((r.name, r.format) for r in done.collect()) == [("a_b-1", "html"), ("a_b-1", "md"), ("s2", "html"), ("s2", "md")]
    assert (tmp_path / "out/a_b-1.md").read_text() == "# a/b\n" and "<h1>a/b</h1>" in (tmp_path / "out/a_b-1.html").read_text()
    for fmt in ("csv", "json", "parquet", "txt"):
        ex.export_table(rows.coalesce(1), str(tmp_path / fmt), fmt)
        assert glob.glob(str(tmp_path / fmt / "part-*"))
    with open(glob.glob(str(tmp_path / "csv" / "*.csv"))[0]) as f:
        assert next(csv.DictReader(f))["tags"] == '["x"]'
    with pytest.raises(ValueError):
        ex.export_table(rows, str(tmp_path / "z"), "docx")


def test_streams(spark, tmp_path):
    source, at = tmp_path / "src", str(tmp_path / "table")
    source.mkdir()
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs((1, "a"), (2, "b"), (3, "a")).write.mode("append").parquet(f"file://{source}")
    table = Table(spark, f"file://{at}", spark.createDataFrame([], "sha1 string, text string, created_at timestamp, updated_at timestamp").schema)

    def run():
        s = stream.watch(spark, f"file://{source}", "doc_id long, text string").select("sha1", "text")
        stream.upsert_stream(s, table, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.text for r in table.read().collect())

    assert run() == ["a", "b"]
    docs((4, "b"), (5, "c")).write.mode("append").parquet(f"file://{source}")
    assert run() == ["a", "b", "c"] and run() == ["a", "b", "c"]


def test_late_events(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    got = [(str(r.window_start), r.event_type, r.n) for r in stream.activity(rows).orderBy("window_start").collect()]
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]
    rows.coalesce(1).write.parquet(f"{tmp_path}/e")
    s = stream.watch(spark, f"{tmp_path}/e", rows.schema, text="event_type", event_time="ts")
    q = s.writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_type for r in spark.table("late").collect()) == ["a", "b"]


def test_xml(spark):
    rows = spark.createDataFrame([(1, "<row><total>3</total><evidence><cn>中</cn><en>e</en></evidence><item><name>a</name></item><item><name>b</name></item></row>")], "k int, x string")
    t = ex.xml_tables(rows, "k", "x", "total int, evidence struct<cn:string,en:string>, item array<struct<name:string>>", {"item": "items"})
    assert t["parent"].first().asDict() == {"k": 1, "evidence_cn": "中", "evidence_en": "e", "total": 3}
    assert [(r.position, r.name) for r in t["items"].orderBy("position").collect()] == [(0, "a"), (1, "b")]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


# Outside programs, played by scripts.


@pytest.fixture
def programs_at(tmp_path, monkeypatch):
    def install(**scripts):
        for name, body in scripts.items():
            p = tmp_path / "bin" / name
            p.parent.mkdir(exist_ok=True)
            p.write_text("#!/bin/sh\n" + body)
            p.chmod(0o755)
        monkeypatch.setenv("PATH", f"{tmp_path}/bin:/usr/bin:/bin")

    return install


def test_pdf_by_the_first_program_that_can(programs_at, tmp_path):
    text = "a page of plain words " * 10
    programs_at(pdftotext=f"grep -q scan $1 || echo '{text}'")
    assert pr.pdf_text(b"x") == (text.strip(), "pdftotext")
    with pytest.raises(pr.Unreadable, match="mutool"):
        pr.pdf_text(b"scan")
    programs_at(mutool="echo '=== === ==='")
    assert pr.pdf_text(b"scan")[1] == "mutool, poor"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.pdf").write_bytes(b"scan")
    programs_at(ocrmypdf="for last; do :; done; echo seen > $last")
    path = f"file:{tmp_path}/in/s.pdf"
    assert pr.pdf_text(b"scan", path)[1] == "ocrmypdf" and os.path.isfile(tmp_path / "in/s--OCR.pdf")
    assert pr.pdf_text(b"scan", path) == (text.strip(), "ocr cache") and pr.ocr_path("a--OCR.pdf") == "a--OCR.pdf"
    assert xt.extract(".pdf", b"x") == (text.strip(), None)


def test_other_programs(programs_at, monkeypatch):
    assert "is one of them installed?" in xt.extract(".djvu", b"x")[1]
    programs_at(djvutxt="cat $1", antiword="exit 1", catdoc="cat $1", **{"ebook-convert": "cp $1 $2"}, w3m="for last; do :; done; sed s/.p.// $last")
    assert [xt.extract(s, b"words")[0] for s in (".djvu", ".doc", ".mobi", ".azw3")] == ["words"] * 4 and pr.page_text(b"<p>hi") == "hi"
    programs_at(djvutxt="sleep 5")
    monkeypatch.setattr(pr, "TEXT_SECONDS", 0.2)
    assert xt.extract(".djvu", b"x")[0] is None


def test_ingest_reads_contents_last(spark, tmp_path):
    """The content is in no exchange of the plan."""
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/f{i}.txt").write_text(f"text number {i % 3}")
    docs = fl.ingest(spark, f"file://{tmp_path}/in", known=spark.createDataFrame([(hashlib.sha1(b"text number 2").hexdigest(),)], "sha1 string"))
    assert sorted(r.content for r in docs.collect()) == ["text number 0", "text number 1"]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in "".join(x for x in plan.split("\n") if "Join" in x or "Aggregate" in x)


def test_a_collection_comes_in_pages(spark):
    def served(url, headers):
        assert headers == {"Key": "k"}
        start, limit = (int(x.rpartition("=")[2]) for x in url.split("?")[1].split("&")[-2:])
        items = [{"key": f"i{n}", "data": {"itemType": "book", "title": f"T{n}", "abstractNote": "A" if n % 2 else "", "date": "1999"}} for n in range(25)]
        files = [{"key": f"a{n}", "data": {"itemType": "attachment", "parentItem": f"i{n}", "linkMode": "imported_file", "contentType": "application/pdf", "filename": "x.pdf"}} for n in range(5)]
        return (items + files)[start : start + limit], {"Total-Results": "30"}

    records = pl.paged_records(spark, "https://library.test/items?v=3", {"Key": "k"}, size=7, transport=served)
    assert records.rdd.getNumPartitions() == 5 and records.count() == 30
    rows = pl.literature(*pl.collection(records))
    assert {r.status: r.n for r in pl.literature_counters(rows).collect()} == {"success": 5, "abstract_only": 10, "no_attachment": 10}
    known = rows.where("item_key = 'i1'")
    assert {r.status: r.n for r in pl.literature_counters(rows, known).collect()} == {"success": 4, "skipped": 1, "abstract_only": 10, "no_attachment": 10}
