r"""Byte-level BPE by replaying merges over a body of words, and decoding.

Words are gathered from many documents at once. An inverted index maps each merge rank to the positions
whose neighbouring pair makes that token. Ranks are taken in ascending order; a merge is applied to all its
positions in one go, and only the touched neighbours get new pairs and index entries. The index covers the
words a task has not met before: each word's ids depend on that word alone, so tasks need no exchange, and no
vocabulary that grows with the corpus is collected or broadcast.

Ids are those of the tiktoken library for the same ranks and pattern. A null text counts as empty and has no
id; a text of any length is encoded whole; equal rows give equal results. Only key and text columns are
read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c
from .piece_encoder import ByteLevelPieces

NONE = np.int32((1 << 31) - 1)
RESULT = T.StructType().add("doc_id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
#: White space of the pattern, spelled out so that no regular-expression library's own notion matters.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")).findall


class MergeReplay:
    """Encodes lists of distinct byte strings; ``ranks`` maps token bytes to ids, which are merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.values[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """The plain rule for one word: merge the leftmost pair of lowest rank, again and again; by a heap of the pairs."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # of the part that begins here, 0 where none begins
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or not end[end[i]] or end[end[i]] != stop:
                continue  # a merge took one of the two
            end[end[i]], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if end[i]]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        out: list[bytes | None] = [None] * len(words)
        open_, texts = [], []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif w:
                open_.append(i)
                texts.append(w)
            else:
                out[i] = b""
        if not texts:
            return out
        symbols, alive, odd = self._replay(texts)
        ends = np.cumsum([len(w) for w in texts])
        upto = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))].tolist()
        ids = symbols[alive].astype("<u4").tobytes()
        for k, i in enumerate(open_):
            out[i] = ids[4 * upto[k] : 4 * upto[k + 1]]
        for k in odd:
            out[open_[k]] = np.array(self.one(texts[k]), "<u4").tobytes()
        return out

    def _replay(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        symbol = self.single[np.frombuffer(b"".join(texts), np.uint8)]
        n = len(symbol)
        ends = np.cumsum([len(w) for w in texts])
        first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        last[ends - 1] = True
        first[ends] = True
        first[0] = True
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive, flag = np.ones(n, bool), np.zeros(n + 1, bool)
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(~last[: n - 1])
        rank[inner] = self.rank_of(symbol[inner], symbol[inner + 1])
        # The inverted index: a sorted part made at once, and lists for what merges add later.
        order = np.argsort(rank, kind="stable")
        order = order[: np.searchsorted(rank[order], NONE)]
        present, starts = np.unique(rank[order], return_index=True)
        stops = np.append(starts[1:], len(order))
        made = dict(zip(present.tolist(), zip(starts.tolist(), stops.tolist())))
        added: dict[int, list[int]] = {}
        heap = present.tolist()
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            while heap and heap[0] == r:
                heapq.heappop(heap)
            a, b = made.pop(r, (0, 0))
            new = added.pop(r, None)
            at = order[a:b]
            if new:
                at = np.concatenate((at, np.array(new))) if b > a else np.array(new)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if new:
                at = np.unique(at)
            flag[at] = True
            if flag[after[at]].any():  # overlapping occurrences: the leftmost comes first
                keep, taken = [], -1
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(after[p])
                flag[at] = False
                at = np.array(keep)
            else:
                flag[at] = False
            gone = after[at]
            # Where occurrences touch, the rule looks at the first one's product before the second is merged.
            flag[at] = True
            touch = after[gone]
            touch = touch[flag[touch]]
            flag[at] = False
            if len(touch):
                early = self.rank_of(np.full(len(touch), r, np.int32), symbol[touch])
                odd.update(np.searchsorted(ends, touch[early < r], side="right").tolist())
            symbol[at] = r
            alive[gone] = False
            rank[gone] = NONE
            last[at] = last[gone]
            beyond = after[gone]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            right = at[~last[at]]
            left = before[at[~first[at]]]
            rank[at[last[at]]] = NONE
            touched = np.concatenate((right, left))
            fresh = self.rank_of(symbol[touched], symbol[after[touched]])
            rank[touched] = fresh
            some = fresh != NONE
            for p, k in zip(touched[some].tolist(), fresh[some].tolist()):
                if k < r:  # a lower rank came up late: the word is done by the plain rule
                    odd.add(int(np.searchsorted(ends, p, side="right")))
                got = added.get(k)
                if got is None:
                    added[k] = [p]
                    heapq.heappush(heap, k)
                else:
                    got.append(p)
        return symbol, alive, odd


class Encoder:
    """Whole texts to id bytes: cut into pieces, new pieces split by the pattern, new words replayed."""

    #: A longer piece is hardly met again.
    LONGEST = 64

    def __init__(self, ranks_path: str, pattern: str, limit: int = 200 << 20):
        """``limit``: bytes, about, of the pieces kept."""
        ranks = load_ranks(ranks_path)
        self.replay, self.split, self.limit, self.held = MergeReplay(ranks), splitter(pattern), limit, 0
        self.known: dict[str, bytes] = {}
        self.tokens = dict(zip(ranks.values(), ranks.keys()))

    def cut(self, text: str) -> list[str]:
        pieces = ByteLevelPieces.cut(text)
        return ["\2" + w for w in self.split(text)] if pieces is None else pieces

    def words(self, piece: str) -> list[str]:
        """The pattern's matches in a piece, as they are inside its text."""
        if piece[:1] == "\2":
            return [piece[1:]]
        if piece[:1] == "\n":  # before another character the run gives its last newline away
            return [piece[1:], "\n"] if len(piece) > 1 else ["\n"]
        if piece[:1] == "\1":
            return [piece[1:]]
        if piece[:1] == "\0":
            return self.split(piece[1:])
        return self.split(" " + piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        new: set[str] = set()
        for t in texts:
            new.update([p for p in self.cut(t) if p not in known])
        cost = sum(250 + 8 * len(p) for p in new if len(p) <= self.LONGEST)
        if self.held + cost > self.limit:
            known.clear()
            self.held, new = 0, {p for t in texts for p in self.cut(t)}
        self.held += cost
        pieces = list(new)
        split = [self.words(p) for p in pieces]
        index: dict[str, int] = {}
        for ws in split:
            for w in ws:
                index.setdefault(w, len(index))
        ids = self.replay.encode([w.encode() for w in index])
        for p, ws in zip(pieces, split):
            known[p] = b"".join([ids[index[w]] for w in ws])
        out = [b"".join(map(known.__getitem__, self.cut(t))) for t in texts]
        for p in pieces:
            if len(p) > self.LONGEST:
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODER: tuple | None = None


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", block_chars: int = 12 << 20, keep: bool = False) -> DataFrame:
    """Ids of every text and what they decode to, as counts and digests; with ``keep`` the ids (array of
    int) and the decoded text too. One pass over the input without any exchange."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    result = RESULT
    if keep:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
        result = T.StructType([*RESULT.fields, T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())])
    schema = pa.schema(fields)

    def run(batches):
        global _ENCODER
        if _ENCODER is None or _ENCODER[0] != (ranks_path, pattern):
            _ENCODER = ((ranks_path, pattern), Encoder(ranks_path, pattern))
        encoder = _ENCODER[1]
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def done(keys, texts):
            out = []
            for k, ids in zip(keys, encoder.encode(texts)):
                decoded = encoder.decode(ids)
                out.append((k, len(ids) // 4, sha(ids), sha(decoded), *([np.frombuffer(ids, "<u4").tolist(), decoded.decode()] if keep else [])))
            return pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(zip(*out), fields)], schema=schema)

        keys, texts, size = [], [], 0
        for batch in c.slices(batches):
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size >= block_chars:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield done(keys, texts)

    return c.spread(rows).mapInArrow(run, result)


def op10_merge_replay(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by merge replay and decoded again."""
    import public_tokenizers as p

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
