import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from docweave.llm import feistel_pii as pii, rule_ledger as rl
from docweave.llm.piece_encoder import load

from .conftest import make_rows
from .test_corpus import brute_dedup, brute_near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with distinct keys."""
    at = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "src0" if k % 3 else "src1", len(t or "")) for k, t in make_rows(11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def brute(rows):
    """Kept documents after each of the first four stages, by plain Python."""
    measurer, stages = rl._Measurer(), []
    env = lambda m: dict(zip(rl.MEASURES, m))
    fails = lambda t: any(eval(r.fails.replace(" AND ", " and "), {}, env(measurer(t or ""))) for r in rl.RULES)  # noqa: E731, S307 - rules are this repository's
    rows = [(k, t) for k, t in rows if not fails(t)]
    stages.append(rows)
    keep = {k for (k, _, _, good, _) in brute_dedup(rows) if good}
    rows = [(k, t) for k, t in rows if k in keep]
    stages.append(rows)
    keep = {k for (k, _, _, comp) in brute_near(rows) if k == comp}
    rows = [(k, t) for k, t in rows if k in keep]
    stages.append(rows)
    permute = pii.Permutation(b"a public key for tests").forth
    rows = [(k, pii.treat(t, permute)[0]) for k, t in rows]
    stages.append(rows)
    return stages


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows), name
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    tokenizer = load(P.path("word_bpe_49k.json"))
    pieces = Counter()
    for k, t in want[-1]:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), 4096)):
            pieces[(k, i, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    run = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in run) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_length_alone_rejects_no_document(spark, tmp_path):
    words = [a + b + d for a in "bcdfghklmn" for b in "aeiou" for d in "bcdfghklmn"]
    text = " ".join(words[(i * i // 7 + i) % 500] + words[i % 499] for i in range(1_000_100))
    docs = spark.createDataFrame([(1, text, "en", "src0", len(text)), (2, "too short", "en", "src0", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.failed_bits for r in rl.apply_rules(docs).where("doc_id = 1").collect()] == [rl.BIT["too_many_words"]]
    assert [r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()] == [1]
    assert rl.keep_good(docs, "strict-1").count() == 0  # a stored version stays as it was


def test_nulls_repeats_ties_and_clashing_columns(spark, tmp_path):
    """Two clusters with null keys, repeated rows and copies: one row of each stays, no cluster is lost, other columns pass."""
    r = np.random.default_rng(3)
    prose = lambda: " ".join("".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(80))
    a, b, z = prose(), prose(), prose()
    texts = [(1, a), (1, a), (None, a + " more"), (7, b), (None, b + " other"), (None, b + " other"), (None, z), (None, z), (None, z.replace(" ", "\n", 1)), (None, None), (3, ""), (3, ""), (4, "too short")]
    rows = [(k, t, "h", 5, None, 9) for k, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, h string, row_number long, n_words int, id long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.columns == ["doc_id", "text", "h", "row_number", "n_words", "id"]
    assert sorted((x.doc_id or 0, x.text[:20]) for x in docs.collect()) == sorted([(0, z[:20]), (1, a[:20]), (7, b[:20])])
    assert sorted(x.doc_id or 0 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 7]


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
