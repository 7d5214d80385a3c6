import base64
import gzip
import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import _common as c, components, grace_dedup as gd, parity_join as pj, warc_writer as ww

from .conftest import words_of


# Exact duplicates.


def brute_dedup(pairs):
    groups = defaultdict(list)
    for k, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k is None, k))
    out, stays = Counter(), set()
    for k, t in pairs:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[bare], key=lambda x: (x[0], x[1], x[2] or 0))
        first = (-len(t or ""), k is None, k) == best and bare not in stays  # of rows that tie fully one
        if first:
            stays.add(bare)
        out[(k, best[2], len(groups[bare]), first, hashlib.sha256(bare.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bound", [96 << 20, 3000, 1])
def test_dedup(docs, pairs, bound):
    """With small bounds tables are closed and buckets spilt again and again."""
    assert Counter(map(tuple, gd.dedup(docs, bound=bound).collect())) == brute_dedup(pairs)


def test_open_table_compares_contents():
    t = gd.OpenTable(4)
    for i in range(200):
        assert t.find(7, b"%d" % i) == (i, True)  # all hashes equal
    for i in range(200):
        assert t.find(7, b"%d" % i) == (i, False)


def test_grace_recursion_with_equal_hashes(tmp_path):
    """Records that no hash bit parts end in one table after the last level."""
    records = [(0, i, 1, 3, i, 5, b"%d" % (i % 7)) for i in range(50)]
    got = sorted(gd.Grace(str(tmp_path), 100).solve(iter(records)))
    assert got == sorted((0, i, i % 7, 8 if i % 7 == 0 else 7, i < 7) for i in range(50))
    assert not list(tmp_path.iterdir())


def test_a_hot_content_costs_one_content(tmp_path, monkeypatch):
    """Copies from ever so many splits, larger in sum than the bound, are never held or spilt."""
    hot = b"boilerplate " * 2000
    monkeypatch.setattr(gd, "spill_files", lambda *a: pytest.fail("spilt"))
    answers = list(gd.Grace(str(tmp_path), 1 << 20).solve((split, 0, 2, 9, split, gd.content_hash(hot), hot) for split in range(20_000)))
    assert len(answers) == 20_000 and {a[2:4] for a in answers} == {(0, 40_000)} and [a[0] for a in answers if a[4]] == [0]


@pytest.mark.parametrize("bound", [96 << 20, 3000, 1])
def test_repeated_rows_and_null_keys(spark, bound):
    rows = [(1, "A a"), (1, "A a"), (None, "B b"), (None, "Bb "), (None, "B b"), (2, "A  a"), (3, None), (None, ""), (None, "C")]
    docs = spark.createDataFrame([(*r, r[0], {"x": 1}) for r in rows], "doc_id long, text string, h long, c0 map<string, int>").repartition(3)
    got = gd.dedup(docs, bound=bound).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_dedup(rows)
    kept = gd.keep_first(docs, bound=bound)
    assert kept.columns == docs.columns
    # The longest of each group; one of the rows that tie.
    assert sorted((r.doc_id or -1, (r.text or "").replace(" ", "")) for r in kept.collect()) == [(-1, "Bb"), (-1, "C"), (2, "Aa"), (3, "")]


def test_keys_and_texts_of_other_types(spark):
    docs = spark.createDataFrame([("7", 12, 1), ("8", 12, 2), ("9", None, 3)], "doc_id string, text int, as1 int")
    assert sorted(map(tuple, gd.keep_first(docs).collect()))[0] == ("7", 12, 1) and gd.keep_first(docs).count() == 2


def test_best_rows_forget_replaced_ones(spark):
    best = gd.BestRows(0, 1, 1 << 20)
    for n in range(1, 900):
        best.add(pa.RecordBatch.from_pylist([{"k": n, "t": "a" + " " * n}, {"k": n, "t": f"b{n}"}]), False)
    got = [r for batch in best.rows() for r in batch.to_pylist()]
    assert len(got) == 900 and {"k": 899, "t": "a" + " " * 899} in [{k: r[k] for k in "kt"} for r in got]


@pytest.mark.parametrize("bound", [96 << 20, 3000, 1])
def test_keep_first(docs, pairs, bound):
    kept = gd.keep_first(docs, bound=bound)
    assert kept.columns == docs.columns
    want = Counter({k: n for (k, _, _, good, _), n in brute_dedup(pairs).items() if good})
    assert Counter(r.doc_id for r in kept.collect()) == want


# Near duplicates.


def brute_near(pairs, threshold=80):
    sets = []
    for _, t in pairs:
        w = words_of("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    common = Counter((a, b) for at in inverted.values() for i, b in enumerate(at) for a in at[:i])
    root, similar = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            similar[a] += 1
            similar[b] += 1
            root[find(a)] = find(b)
    low = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return Counter((k, len(sets[i]), similar[i], low.get(find(i))) for i, (k, _) in enumerate(pairs))


def columns(df):
    return Counter((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in df.collect())


def test_near(docs, pairs):
    assert columns(pj.near_duplicates(docs)) == brute_near(pairs)


@pytest.mark.parametrize("threshold", [50, 95, 100])
def test_thresholds(spark, threshold):
    r = random.Random(threshold)
    rows = []
    for _ in range(60):
        base = [r.choice("abcdefgh") for _ in range(r.randrange(1, 50))]
        for _ in range(3):
            x = list(base)
            for _ in range(r.randrange(0, 3)):
                x[r.randrange(len(x))] = r.choice("xyz")
            rows.append((len(rows), " ".join(x)))
    assert columns(pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold)) == brute_near(rows, threshold)


def test_large_groups_are_tiled(spark, monkeypatch):
    """A cluster far above a tile, whose texts all differ, and a passage that many other documents share."""
    monkeypatch.setattr(pj, "TILE", 8)
    monkeypatch.setattr(pj, "VERIFY_SHINGLES", 2000)
    r = random.Random(2)
    base = [str(i) for i in range(120)]
    rows = []
    for i in range(70):
        x = list(base)
        for _ in range(r.randrange(1, 4)):
            x[r.randrange(len(x))] = f"q{i}"
        rows.append((len(rows), " ".join(x)))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(60):
        rows.append((len(rows), passage + " " + " ".join(f"w{i}_{j}" for j in range(r.randrange(30, 90)))))
    assert columns(pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_near(rows)


def test_shared_keys_prefix_is_lossless():
    """Any two sets within the bound share one of the keys that both emit."""
    r = np.random.default_rng(5)
    bounds = pj.Bounds(80)
    for n in [*range(4, 40), 63, 64, 65, 100, 127, 128, 300, 1000]:
        for _ in range(12):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            m = int(r.integers(0, bounds.keep(n) + 1))
            gone = int(r.integers(0, m + 1))
            b = np.unique(np.concatenate((a[gone:], r.integers(0, 1 << 63, m - gone, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
                assert np.intersect1d(pj.set_keys(a, bounds), pj.set_keys(b, bounds)).size


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(6)
    for _ in range(100):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 300), dtype=np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(pj.dense_sketch(pj.mix(s)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_linked_by_product_is_linked_by_intersection():
    r = np.random.default_rng(7)
    sets = {i: np.unique(r.integers(0, 60, r.integers(20, 50), dtype=np.uint64)) for i in range(20)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    one_by_one = [p for p in pairs if len(pj.linked({k: sets[k] for k in p}, np.array([p]), 50)[0])]
    a, b = pj.linked(sets, np.array(pairs), 50)
    assert list(zip(a.tolist(), b.tolist())) == one_by_one and one_by_one
    # The same as a block: documents linked, and components.
    asked, weight = np.zeros((20, 20), bool), {i: i + 1 for i in sets}
    asked[tuple(zip(*pairs))] = True
    got = pj.block_links(sets, weight, list(sets), np.packbits(asked, axis=None).tobytes(), bytes(50), 0, 50)
    want = Counter()
    for a, b in one_by_one:
        want[a] += weight[b]
        want[b] += weight[a]
    assert {k: n for k, _, n in got} == want


def test_keep_one(docs, pairs):
    kept = pj.keep_one(docs)
    assert kept.columns == docs.columns
    near = brute_near(pairs)
    want = Counter({k: n if size == 0 else 1 for (k, size, _, comp), n in near.items() if k == comp})
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_null_keys_link_nothing_and_one_row_stays(spark):
    """Two clusters whose null keys are all they have in common, repeated rows, and a cluster without any key."""
    a, b, z = (" ".join(f"{x}{i}" for i in range(60)) for x in "abz")
    rows = [(1, a), (1, a), (None, a + " x"), (7, b), (None, b + " y"), (None, b + " y"), (None, z), (None, z + " w"), (None, z), (5, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1, {"x": 1}) for r in rows], "doc_id long, text string, row_number int, id map<string, int>").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in pj.near_duplicates(docs).collect()}
    assert got == {(1, 56, 2, 1), (None, 57, 2, 1), (7, 56, 2, 7), (None, 57, 2, 7), (None, 56, 2, None), (None, 57, 2, None), (5, 0, 0, 5), (None, 0, 0, None)}
    kept = pj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept.collect()) == [(0, ""), (0, ""), (0, "z"), (1, "a"), (5, ""), (7, "b")]


@pytest.mark.parametrize("tile,shingles", [(1024, 1 << 21), (100, 5000)])
def test_templates_go_as_blocks(spark, monkeypatch, tile, shingles):
    """Texts that differ in one word each: every two link, and what leaves a block grows with its sets."""
    monkeypatch.setattr(pj, "TILE", tile)
    monkeypatch.setattr(pj, "VERIFY_SHINGLES", shingles)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:30], f"slot{i}", *words[30:]])) for i in range(600)] + [(600 + i, " ".join([*words[:10], f"x{i}", *words[10:]])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert columns(pj.near_duplicates(docs)) == brute_near(rows)
    sketched = c.staged(pj.sketch(docs, 80), "x")
    found = c.staged(pj.candidates(c.staged(pj.shared_keys(sketched, 4), "x"), sketched, 80, 4), "x")
    assert found.where("bits is not null").count() and found.where("bits is null").count() < (10_000 if tile == 1024 else 70_000)


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)] + [(5000, 5000)]
    r.shuffle(edges)
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


# WARC.


def brute_warc(rows, least=0):
    best: dict = {}
    for k, _, h in rows:
        b = (h or "").encode()
        best[b] = max(best.get(b, -1), -1 if k is None else k)
    out = Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        revisit = len(b) >= least and best[b] >= 0 and best[b] != k
        out[(k, len(b), digest, "revisit" if revisit else "response", best[b] if revisit else None)] += 1
    return out


WARC_ROWS = [(i, f"http://x/{i}", [None, "", "same", "héllo\r\n\r\nx", "y" * 70000, f"own {i}"][i % 6]) for i in range(60)] + [(3, "http://x/3", "héllo\r\n\r\nx"), (None, None, "same"), (None, "bad\r\nurl", "alone"), (61, None, "z")]


@pytest.mark.parametrize("roll,least", [(1 << 30, 0), (2000, 0), (1 << 30, 5)])
def test_warc(spark, roll, least):
    pages = spark.createDataFrame([(*r, 1, "d") for r in WARC_ROWS], "page_id long, url string, html string, n int, digest string").repartition(3)
    folder = c.fresh_dir(spark, "w")
    manifest = ww.write_warc(pages, folder, least=least, roll_bytes=roll)
    assert Counter(map(tuple, ww.read_warc(manifest, folder).collect())) == brute_warc(WARC_ROWS, least)


def test_warc_bytes_are_the_same_again(spark):
    pages = spark.createDataFrame(WARC_ROWS, "page_id long, url string, html string")
    folder = c.fresh_dir(spark, "w")
    first = ww.write_warc(pages.limit(1).withColumn("at", F.expr("timestamp '2020-01-02 03:04:05'")), folder, date="at").first()
    fs, path = c.filesystem(folder)
    assert b"WARC-Date: 2020-01-02T03:04:05Z" in gzip.decompress(fs.open_input_file(f"{path}/{first.file}").read())
    sums = []
    for parts in (1, 5):
        folder = c.fresh_dir(spark, "w")
        m = ww.write_warc(pages.repartition(parts), folder).orderBy("part", "roll").collect()
        fs, path = c.filesystem(folder)
        data = b"".join(gzip.decompress(fs.open_input_file(f"{path}/{x.file}").read()) for x in m)
        sums.append(hashlib.sha256(data).hexdigest())
        assert b"bad url" in data and data.count(b"WARC/1.1\r\n") == len(WARC_ROWS) + len(m) == data.count(b"WARC-Record-ID") and data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for x in m:
            assert hashlib.sha256(fs.open_input_file(f"{path}/{x.file}").read()).hexdigest() == x.sha256
        assert not [f.path for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(path)) if "_temporary" in f.path]
    assert sums[0] == sums[1]


def test_empty_tables(spark, empty):
    assert gd.dedup(empty).count() == 0 and gd.keep_first(empty).count() == 0
    assert pj.near_duplicates(empty).count() == 0 and pj.keep_one(empty).count() == 0
    folder = c.fresh_dir(spark, "w")
    assert ww.read_warc(ww.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder), folder).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert c.fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert json.dumps(c.parts_for(spark.range(10))) and c.parts_for(spark.range(10)) >= 4
