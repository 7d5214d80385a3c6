"""Cached encoding by the tokenizers library over context-free pieces of a text.

Pre-tokenization never joins characters across certain spaces, so a text can be cut there, each
distinct piece encoded once by the library, and the id bytes concatenated. Texts holding white space
for which the cut is not proven go to the library whole. Either way the ids are the library's.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: White space and controls (others than plain spaces and newlines) that send a text to the library whole.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_ODD_WORDS = re.compile("[\x00-\x08\x0e-\x1f\x7f\x85\xa0\u0300-\u036f\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_NEWLINES = re.compile("\n+")
#: Pieces longer than this are not remembered.
_LONGEST = 64


#: One such character at the end of a piece is a token run of its own.
_STOPS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for the UTF-8 bytes of characters below U+0250."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {k: "".join(letter[b] for b in chr(k).encode()) for k in range(128, 0x250)}


def load(path: str, special_as_text: bool = False):
    """The library's tokenizer; strings of special tokens inside a text are those tokens, as it has them, or ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


class _Pieces:
    """Keeps pieces with the little-endian unsigned 32-bit bytes of their ids, about ``limit`` bytes in all."""

    def __init__(self, tokenizer, limit: int = 300 << 20):
        self.tokenizer, self.limit, self.held = tokenizer, limit, 0
        self.known: dict[str, bytes] = {}
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        #: A text with an added token goes to the library whole. What they all begin with is looked for first.
        self.begin = re.match(r"[^A-Za-z]*", os.path.commonprefix(added) if added else "\0")[0]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.letters, self.model = _byte_letters(), tokenizer.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out, known = [], self.known
        for text in texts:
            pieces = None if self.begin in text and self.added.search(text) else self.cut(text)
            if pieces is None:
                out.append(self.whole(text))
                continue
            new = [p for p in pieces if p not in known]
            if new:
                new = list(dict.fromkeys(new))
                cost = sum([300 if len(p) < 9 else 300 + 8 * len(p) for p in new if len(p) <= _LONGEST])
                if self.held + cost > self.limit:
                    known.clear()
                    self.held, new = 0, list(dict.fromkeys(pieces))
                self.held += cost
                self.learn(new)
            out.append(b"".join(map(known.__getitem__, pieces)))
            for p in new:  # a long piece is hardly met again
                if len(p) > _LONGEST:
                    known.pop(p, None)
        return out


    def word(self, before: str, letters: str) -> bytes:
        """Ids of a run of letters below U+0250, which the pre-tokenizer leaves whole, by the library's model."""
        if not letters.isascii():
            letters = letters.translate(self.letters)
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.model.tokenize(before + letters)])


class ByteLevelPieces(_Pieces):
    r"""For byte-level pre-tokenization by ``'s|...| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``.

    Keys: a plain string is a piece after one space; ``\0x`` is ``x`` with no space before it; newlines are
    a run inside the text; ``\1`` and newlines are the run that ends the text.
    """

    def __init__(self, tokenizer, limit: int = 300 << 20):
        super().__init__(tokenizer, limit)
        self.newline = self.whole("\n")
        self.stops = {c: self.whole(c) for c in _STOPS}

    @staticmethod
    def cut(text: str) -> list[str] | None:
        if _ODD.search(text) or "  " in text or " \n" in text or "\n " in text:
            return None
        body = text.rstrip("\n")
        tail = len(text) - len(body)
        if "\n\n" in body:
            body = _NEWLINES.sub(r" \g<0> \0", body)
        elif "\n" in body:
            body = body.replace("\n", " \n \0")
        pieces = ("\0" + body).split(" ")
        if tail:
            pieces.append("\1" + "\n" * tail)
        return pieces

    def learn(self, new: list[str]) -> None:
        plain, known = [], self.known
        for p in new:
            if p[:1] == "\n":
                known[p] = (self.whole(p[1:]) if len(p) > 1 else b"") + self.newline
            elif p[:1] == "\1":
                known[p] = self.whole(p[1:])
            elif p == "\0":
                known[p] = b""
            elif not p:
                known[p] = self.whole(" ")
            else:
                core, before = (p[1:], "") if p[0] == "\0" else (p, "\u0120")
                base, stop = (core[:-1], self.stops[core[-1]]) if core[-1] in _STOPS else (core, b"")
                ids = None
                if base.isalpha() and max(base) < "\u0250":
                    ids = known.get(p[:-1]) if stop else None
                    ids = self.word(before, base) if ids is None else ids
                if ids is None:
                    plain.append(p)
                else:
                    known[p] = ids + stop
        mark = int.from_bytes(self.newline, "little")
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            joined = "\n".join([p[1:] if p[0] == "\0" else " " + p for p in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == mark).tolist()
            if len(ends) != len(some) - 1:
                for p in some:
                    known[p] = self.whole(p[1:] if p[0] == "\0" else " " + p)
                continue
            buf, prev = ids.tobytes(), 0
            for p, end in zip(some, [*ends, len(ids)]):
                known[p] = buf[4 * prev : 4 * end]
                prev = end + 1


class WordPieces(_Pieces):
    """For tokenizers that drop white space and mark word ends: every white space is a cut."""

    #: A separator whose first byte occurs in no piece that is learnt in bulk.
    MARK = "\u4e00"

    def __init__(self, tokenizer, limit: int = 300 << 20):
        super().__init__(tokenizer, limit)
        self.stops = {c: self.whole(c) for c in _STOPS}
        self.mark = tokenizer.encode(self.MARK, add_special_tokens=False).ids

    @staticmethod
    def cut(text: str) -> list[str] | None:
        return None if _ODD_WORDS.search(text) else text.split()

    def learn(self, new: list[str]) -> None:
        known, width = self.known, len(self.mark)
        plain = []
        for p in new:
            base, stop = (p[:-1], self.stops[p[-1]]) if p[-1] in _STOPS else (p, b"")
            lower = base.lower()
            if lower.isalpha() and max(lower) < "\u0250":
                ids = known.get(base) if stop else None
                ids = self.word("", lower) if ids is None else ids
                if ids is not None:
                    known[p] = ids + stop
                    continue
            if p and max(p) < "\u0250":
                plain.append(p)
            else:
                known[p] = self.whole(p)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            joined = f" {self.MARK} ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(ends) != len(some) - 1:
                for p in some:
                    known[p] = self.whole(p)
                continue
            buf, prev = ids.tobytes(), 0
            for p, end in zip(some, [*ends, len(ids)]):
                known[p] = buf[4 * prev : 4 * end]
                prev = end + width
