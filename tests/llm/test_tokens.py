import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import example, given, settings, strategies as hs
from tokenizers import Tokenizer

from docweave.llm import merge_replay, packing, token_planes as tp
from docweave.llm import _common as c
from docweave.llm.piece_encoder import ByteLevelPieces, WordPieces, load

BYTE, WORD = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
BYTE_PIECES, WORD_PIECES = ByteLevelPieces(load(P.path("byte_bpe_50k.json"))), WordPieces(load(P.path("word_bpe_49k.json")))
REPLAY = merge_replay.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ALPHABET = "  \n\nabcÉé1,.'s\t\x1c\x85\xa0\u3000\u4e00 ́ΣİßA\r<|endoftext|>\0\1\2aaaa"


def tiktoken_ids(text):
    global _T
    if _T is None:
        import tiktoken

        _T = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=REPLAY.replay.ranks, special_tokens={})
    return _T.encode_ordinary(text)


_T = None


def le(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(hs.one_of(hs.text(alphabet=ALPHABET, max_size=30), hs.lists(hs.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "\n", "ab", "c."]), max_size=8).map("".join)))
@example("hello <|endoftext|> world")
@example("<|startoftext|>a<|ENDOFTEXT|> b")
def test_cached_pieces_are_the_librarys(text):
    assert BYTE_PIECES.encode([text]) == [le(BYTE.encode(text, add_special_tokens=False).ids)]
    assert WORD_PIECES.encode([text]) == [le(WORD.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(hs.one_of(hs.text(alphabet=ALPHABET, max_size=30), hs.text(max_size=20), hs.text(alphabet="atheino r", max_size=40)))
def test_merge_replay_is_tiktokens(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = REPLAY.encode([text])[0]
    assert ids == le(tiktoken_ids(text))
    assert REPLAY.decode(ids) == text.encode()


def test_replay_follows_the_plain_rule_on_odd_vocabularies():
    """Merges that come up below the current rank, overlaps, and pairs that spell one token in two ways."""
    r = random.Random(3)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 25:
            ranks.setdefault(bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6))), len(ranks))
        m = merge_replay.MergeReplay(ranks)
        words = list({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 14))) for _ in range(80)})
        for w, got in zip(words, m.encode(words)):
            assert got == (le([ranks[w]]) if w in ranks else le(m.one(w))), w


def test_special_tokens_may_be_ordinary_text():
    pieces = ByteLevelPieces(load(P.path("byte_bpe_50k.json"), special_as_text=True))
    assert pieces.encode(["a <|endoftext|> b"]) == [le(tiktoken_ids("a <|endoftext|> b"))] != BYTE_PIECES.encode(["a <|endoftext|> b"])


def test_the_plain_rule_by_a_heap():
    """Against the rule as it is said, on words of few letters."""
    r = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 25:
            ranks.setdefault(bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6))), len(ranks))
        m = merge_replay.MergeReplay(ranks)
        for _ in range(40):
            word = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 25)))
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 1 and (best := min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))[0] < 1 << 40:
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert m.one(word) == [ranks[x] for x in parts]
    assert len(merge_replay.MergeReplay(ranks).one(b"ab" * 200_000)) > 1  # not quadratic


def test_groups_of_the_second_pass_stay_small(spark):
    """No two pieces fit a bin, so every bin is left over: groups are as small as in the first pass."""
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "2500L AS length", "0L AS ids_crc32", "id AS serial")
    got = packing.pack(c.staged(pieces, "p"), 4096, group_pieces=100)
    assert got.count() == got.select("sequence_id").distinct().count() == 3000
    assert got.where("sequence_id >> 62 = 1").selectExpr("sequence_id >> 34 AS g").groupBy("g").count().agg({"count": "max"}).first()[0] < 200


def test_cache_is_bounded_and_right():
    small = ByteLevelPieces(BYTE, limit=10)
    texts = ["alpha beta gamma delta", "epsilon zeta eta theta iota kappa lambda", "alpha beta"]
    assert small.encode(texts) == [le(BYTE.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("layout", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(layout, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert (tp.from_planes(tp.to_planes(ids, layout), n, layout) == ids).all()


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_shard_file(tmp_path, layout):
    fs, path = c.filesystem(f"file://{tmp_path}")
    w = tp.ShardWriter(fs, path, "a.planes", layout, block=16)
    docs = [(k, le(np.arange(n) + k)) for k, n in enumerate((0, 1, 40, 0, 16, 100))]
    for k, ids in docs:
        w.add(k, ids)
    assert w.close()["n_ids"] == 157
    r = tp.ShardReader(fs, f"{path}/a.planes")
    assert list(r.documents()) == docs
    everything = np.concatenate([np.frombuffer(x, "<u4") for _, x in docs])
    for a, b in ((0, 157), (15, 17), (16, 32), (100, 101), (5, 5)):
        assert (r.ids(a, b) == everything[a:b]).all()
    assert [p.name for p in tmp_path.iterdir()] == ["a.planes"]


def test_shard_damage_is_seen(tmp_path):
    fs, path = c.filesystem(f"file://{tmp_path}")
    w = tp.ShardWriter(fs, path, "a", block=64)
    w.add(1, le(range(64)))
    w.close()
    data = bytearray((tmp_path / "a").read_bytes())
    data[len(tp.MAGIC) + 12] ^= 255
    (tmp_path / "a").write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017 - a bad frame or a wrong sum
        tp.ShardReader(fs, f"{path}/a").chunk(0)


@pytest.mark.parametrize("shard_ids", [1 << 30, 500])
def test_token_planes(spark, docs, pairs, shard_ids):
    folder = c.fresh_dir(spark, "t")
    got = tp.read_token_shards(tp.write_token_shards(docs, folder, P.path("byte_bpe_50k.json"), shard_ids=shard_ids), folder).collect()
    want, at = Counter(), 0
    rows = [(k is not None, k or 0, le([*BYTE.encode(t or "", add_special_tokens=False).ids, 0]), k) for k, t in pairs]
    for _, _, ids, k in sorted(rows, key=lambda x: x[:2]):
        want[(k, at, len(ids) // 4, zlib.crc32(ids))] += 1
        at += len(ids) // 4
    assert Counter(map(tuple, got)) == want


def test_merge_replay(docs, pairs):
    got = Counter(map(tuple, merge_replay.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, block_chars=2000).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == Counter((k, len(i := tiktoken_ids(t or "")), sha(le(i)), sha((t or "").encode())) for k, t in pairs)


def test_merge_replay_keeps_ids_and_text(docs):
    for r in merge_replay.encode_decode(docs.where("doc_id < 9"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=True).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "") and r.ids == tiktoken_ids(r.text or "")


def test_best_two_fit_uses_every_piece_once():
    r = np.random.default_rng(1)
    for lengths in (r.integers(1, 4096, 3000), r.integers(1400, 4000, 500), np.full(100, 1500), np.array([4095]), np.array([], int), r.choice([1, 2, 1300, 1500, 2600], 700)):
        bins = packing.best_two_fit(lengths, 4096)
        assert sorted(sum(bins, [])) == sorted(lengths.tolist()) and all(0 < sum(b) <= 4096 for b in bins)


def test_two_replace_one_where_that_is_tighter():
    # Greedy takes 60 and 35, which leaves 5; 20 and 20 instead of 35 fill the bin.
    assert sorted(packing.best_two_fit(np.array([60, 35, 20, 20]), 100)[0]) == [20, 20, 60]


def test_two_is_the_best_pair():
    r = random.Random(2)
    for _ in range(200):
        lengths = [r.randrange(1, 30) for _ in range(r.randrange(2, 12))]
        gap, over = r.randrange(2, 50), r.randrange(0, 20)
        a, b = packing._Lengths(np.array(lengths)).two(gap, over)
        best = max((x + y for i, x in enumerate(lengths) for y in lengths[:i] if over < x + y <= gap), default=0)
        assert a + b == best


def test_packing(docs, pairs):
    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"), size=512).collect()
    want = Counter()
    for k, t in pairs:
        ids = [*WORD.encode(t or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), 512)):
            want[(k, i, at, len(ids[at : at + 512]), zlib.crc32(le(ids[at : at + 512])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 512) + 2


def test_packing_groups_are_merged(spark):
    """Many small groups must not leave many partly filled bins."""
    r = random.Random(1)
    pieces = spark.createDataFrame([(i, 0, 0, r.randrange(1, 300), 0, i) for i in range(4000)], packing.PIECES)
    got = packing.pack(c.staged(pieces, "p"), 512, group_pieces=50).collect()
    assert len(got) == 4000
    assert len({x.sequence_id for x in got}) <= sum(x.length for x in got) / 512 * 1.02 + 2


def test_sequences(docs):
    pieces = c.staged(packing.cut(docs, P.path("word_bpe_49k.json"), 512, 1, with_ids=True), "p")
    packed = c.staged(packing.pack(pieces.drop("ids"), 512), "q")
    for s in packing.sequences(pieces, packed).collect():
        assert 0 < len(s.ids) <= 512 and s.ids.count(1) >= 0
    assert sum(len(s.ids) for s in packing.sequences(pieces, packed).collect()) == sum(r.length for r in packed.collect())


def test_empty_tables(spark, empty):
    folder = c.fresh_dir(spark, "e")
    assert tp.read_token_shards(tp.write_token_shards(empty, folder, P.path("byte_bpe_50k.json")), folder).count() == 0
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0
    assert merge_replay.encode_decode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
