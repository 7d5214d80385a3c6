r"""Format-preserving pseudonyms for personal data.

Values are found by patterns and validated (Luhn and mod-97 sums, octets, number plans, the calendar). A valid value
is an element of a finite set, its format: the digits of a card with a right check digit, a number of the plan, a day
of the calendar, the letters and digits of an address. A keyed Feistel network permutes that set, so the pseudonym is
valid too, and equal values become equal pseudonyms in every document, however they are punctuated. No table of
values exists, so nothing is exchanged, and ``restore`` undoes it for whoever holds the key.

A number written as a phone number of North America is one even where the plan has no such area or exchange: those
numbers are a set of their own (``wide``), which is permuted apart and looked for after all valid values.

Defined results: a null text stays null, an empty one empty; texts of any length are treated whole; where two
patterns overlap, the one that starts first wins, then the longer; equal rows give equal results; an
empty table gives none. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import logging
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _common as c

KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")
ROUNDS = 8
_ANY = re.compile("[0-9@]")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
_PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    # In one run, or in the groups that cards have.
    "card": re.compile(r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]?\d{3})?|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+[1-9](?:[ .()-]{0,2}\d){7,14}(?!\d)"),
    "ip": re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    "date": re.compile(r"(?<![\d./-])(?:(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})|(?P<d2>\d{2})(?P<s2>[/.])(?P<m2>\d{2})(?P=s2)(?P<y2>\d{4}))(?![\d/-]|\.\d)"),
}
#: The same at every place, so that a match that is not valid hides no other.
_STARTS = {kind: re.compile(f"(?=({p.pattern.replace('(?P<', '(?P<_')}))".replace("(?P=s)", "(?P=_s)").replace("(?P=s2)", "(?P=_s2)")) for kind, p in _PATTERNS.items()}


#: Of the countries in the ISO 13616 register; others may have any length.
IBAN_LENGTHS = dict(x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split())
IBAN_LENGTHS = {k: int(v) for k, v in IBAN_LENGTHS.items()}


class Permutation:
    """A keyed permutation of range(n) for any n, by a balanced Feistel network and cycle walking."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.sha256(key).digest()

    def _f(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = bits // 8 + 1
        out = b""
        block = 0
        while len(out) < size:
            out += hashlib.blake2b(half.to_bytes(size, "big"), key=self.key, salt=bytes([i, block % 256]), person=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _pass(self, x: int, bits: int, tweak: bytes, order) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        for i in order:
            left, right = right, left ^ self._f(tweak, i, right, bits)
        return right << bits | left

    def forth(self, x: int, n: int, tweak: bytes) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._pass(x, bits, tweak, range(ROUNDS))
            if x < n:
                return x

    def back(self, x: int, n: int, tweak: bytes) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._pass(x, bits, tweak, range(ROUNDS - 1, -1, -1))
            if x < n:
                return x


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its digits replaced by ``chars`` in turn."""
    it = iter(chars)
    return "".join(next(it) if ch.isdigit() else ch for ch in shape)


def _mixed(value: str) -> tuple[int, int, list[int]]:
    """A string's letters and digits as one number: number, size of the set, sizes by place."""
    x, n, sizes = 0, 1, []
    for ch in value:
        size, at = (10, ord(ch) - 48) if "0" <= ch <= "9" else (26, ord(ch) - 97) if "a" <= ch <= "z" else (1, 0)
        x, n = x * size + at, n * size
        sizes.append(size)
    return x, n, sizes


def _unmixed(x: int, shape: str, sizes: list[int]) -> str:
    out = []
    for ch, size in zip(reversed(shape), reversed(sizes)):
        x, at = divmod(x, size)
        out.append(ch if size == 1 else chr(48 + at) if size == 10 else chr(97 + at))
    return "".join(reversed(out))


def pseudonym(kind: str, value: str, permute) -> str | None:
    """The pseudonym of a valid value, None if it is not valid. ``permute(x, n, tweak)`` is one way or the other."""
    digits = "".join(ch for ch in value if "0" <= ch <= "9")
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or len(set(digits)) == 1:
            return None
        # The first digit tells the network and stays; the last one is made anew.
        n = 10 ** (len(digits) - 2)
        body = digits[0] + str(permute(int(digits[1:-1]), n, b"card%d" % len(digits) + digits[:1].encode())).zfill(len(digits) - 2)
        return _refill(value, body + str(-luhn_sum(body + "0") % 10))
    if kind == "iban":
        bare = value.replace(" ", "")
        number = lambda s: int("".join(str(int(ch, 36)) for ch in s))
        if len(bare) != IBAN_LENGTHS.get(bare[:2], len(bare)) or not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
            return None
        low = bare[4:].lower()
        x, n, sizes = _mixed(low)
        body = _unmixed(permute(x, n, b"iban" + bare[:2].encode() + bytes(sizes)), low, sizes).upper()
        check = 98 - number(body + bare[:2] + "00") % 97
        it = iter(f"{bare[:2]}{check:02d}{body}")
        return "".join(ch if ch == " " else next(it) for ch in value)
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)
        x = permute((areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        if len(national) == 10 and (not value.startswith("+") or digits[0] == "1"):
            if national[0] < "2" or national[3] < "2":
                return None
            x = ((int(national[:3]) - 200) * 800 + int(national[3:6]) - 200) * 10000 + int(national[6:])
            x, line = divmod(permute(x, 800 * 800 * 10000, b"nanp"), 10000)
            area, exchange = divmod(x, 800)
            return _refill(value, digits[: len(digits) - 10] + f"{area + 200}{exchange + 200}{line:04d}")
        if not value.startswith("+") or not 8 <= len(digits) <= 15:
            return None
        rest = len(digits) - 2
        return _refill(value, digits[:2] + str(permute(int(digits[2:]), 10**rest, b"phone" + digits[:2].encode() + bytes([rest]))).zfill(rest))
    if kind == "wide":
        rest = digits[1:] if value.startswith("+") or len(digits) == 11 else digits
        marks = {ch for ch in value if not ch.isdigit()}
        if value.startswith("+") and digits[0] != "1" or not (marks & set("+(") or len(marks) == 1 and " " not in marks):
            return None  # groups of digits parted by spaces may be any numbers
        planned = lambda s: len(s) == 10 and s[0] > "1" and s[3] > "1"
        if len(rest) not in (9, 10) or planned(rest):
            return None
        while True:
            rest = str(permute(int(rest), 10 ** len(rest), b"wide%d" % len(rest))).zfill(len(rest))
            if not planned(rest):
                return _refill(value, digits[: len(digits) - len(rest)] + rest)
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip")
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        m = _PATTERNS["date"].fullmatch(value)
        year, sep, month, day = (m["y"], m["s"], m["m"], m["d"]) if m["y"] else (m["y2"], m["s2"], m["m2"], m["d2"])
        month, day = int(month), int(day)
        flipped = not m["y"] and month > 12  # month first
        if flipped:
            month, day = day, month
        try:
            x = datetime.date(int(year), month, day).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        while True:
            x = permute(x, _DAYS, b"date%d" % flipped)
            new = datetime.date.fromordinal(x + _FIRST_DAY)
            if not flipped or new.day > 12:  # month first shows only in days above 12, so it stays among those
                break
        if m["y"]:
            return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
        a, b = (new.month, new.day) if flipped else (new.day, new.month)
        return f"{a:02d}{sep}{b:02d}{sep}{new.year:04d}"
    if kind == "email":
        stem, dot, top = value.rpartition(".")
        low = stem.lower()
        x, n, sizes = _mixed(low)
        changed = _unmixed(permute(x, n, b"email" + low.translate(_SHAPE).encode()), low, sizes)
        return "".join(b.upper() if a.isupper() else b for a, b in zip(stem, changed)) + dot + top
    raise ValueError(kind)


_SHAPE = {**{i: "0" for i in range(48, 58)}, **{i: "a" for i in range(97, 123)}}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every pattern that may hold, without overlaps left to choose."""
    if not _ANY.search(text):
        return []
    kinds = KINDS if "@" in text else KINDS[1:]
    spans = []
    for i, kind in enumerate(kinds):
        for m in _STARTS[kind].finditer(text):
            a, b = m.span(1)
            spans.append((a, -b, i, kind))
            if kind == "iban":  # words after it may look like more of it
                spans += [(a, -(a + len(x)), i, kind) for x in _shorter(m[1])]
            elif kind == "card" and (more := _FOUR_FOURS.match(m[1])):  # three digits after it may be none of it
                spans.append((a, -(a + more.end()), i, kind))
    return [(a, -b, kind) for a, b, _, kind in sorted(spans)]


_FOUR_FOURS = re.compile(r"(?:\d{4}[ -]){3}\d{4}(?=[ -]\d{3}$)")


def _shorter(value: str):
    """``value`` without its last groups, as long as it can be one."""
    while " " in value and len((value := value.rpartition(" ")[0]).replace(" ", "")) >= 15:
        yield value


def treat(text: str, permute) -> tuple[str, list[str]]:
    """The text with valid values replaced, and the kinds replaced."""
    found, done, unplanned = [], 0, []
    for start, end, kind in find(text):
        if start < done:
            continue
        if new := pseudonym(kind, text[start:end], permute):
            found.append((start, end, kind, new))
            done = end
        elif kind == "phone":
            unplanned.append((start, end))
    if unplanned:
        found = sorted(found + _wide(text, unplanned, found, permute))
    if not found:
        return text, []
    out, done = [], 0
    for start, end, _, new in found:
        out += [text[done:start], new]
        done = end
    return "".join(out) + text[done:], [kind for _, _, kind, _ in found]


def _wide(text: str, unplanned: list[tuple[int, int]], found: list[tuple[int, int, str, str]], permute) -> list[tuple[int, int, str, str]]:
    """Phone numbers outside the plan among the spans that no valid value touches."""
    out, done, at = [], 0, 0
    for start, end in unplanned:
        while at < len(found) and found[at][1] <= start:
            at += 1
        if start < done or at < len(found) and found[at][0] < end:
            continue
        if new := pseudonym("wide", text[start:end], permute):
            out.append((start, end, "phone", new))
            done = end
    return out


def _unused(df: DataFrame, name: str) -> str:
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name = "_" + name
    return name


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", restore: bool = False, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``counts`` also a map of replaced values by kind in ``n_pii``.

    One pass without an exchange. ``restore`` puts the values back.
    """
    at = docs.columns.index(text)
    extra = _unused(docs, "n_pii")
    fields = docs.schema.fields
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(extra, T.ArrayType(T.LongType()))])
    ordered = docs.select(*[docs[f"`{f.name}`"].cast("string").alias(f.name) if i == at else docs[f"`{f.name}`"] for i, f in enumerate(fields)])
    schema.fields[at].dataType = T.StringType()

    def run(batches):
        p = Permutation(key)
        permute = p.back if restore else p.forth
        for batch in c.slices(batches, 1024):
            texts, found = [], []
            for t in batch.column(at).to_pylist():
                new, kinds = (t, []) if t is None else treat(t, permute)
                texts.append(new)
                found.append([kinds.count(k) for k in KINDS])
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], [*[f.name for f in fields], extra])

    done = c.spread(ordered).mapInArrow(run, schema)
    return done if counts else done.drop(extra)


KEY_SETTING = "spark.docweave.pii.key"


def key_of(spark) -> bytes:
    """The session's key. Where none is set a random one is drawn and kept in the session's setting, so that nobody
    else can undo the pseudonyms; whoever wants to link corpora, or restore values later, sets one."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
        logging.getLogger(__name__).warning("%s is not set: pseudonyms are made with a random key of this session", KEY_SETTING)
    return key.encode()


def op5_feistel_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and how many values of each kind were replaced."""
    done = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark), counts=True)
    return done.select("doc_id", "text", *[F.get("n_pii", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)])
