"""Text kernel as Column functions: everything here runs inside whole-stage code generation.

Python's regular expressions become Java's with two flags: ``(?U)`` so that ``\\w`` and ``\\s`` are Unicode's, and
``(?d)`` so that only ``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def page_markers(text: Column) -> Column:
    """Form feeds become visible page breaks."""
    return F.replace(text, F.lit("\f"), F.lit(PAGE_BREAK))


def clean_lines(text: Column) -> Column:
    """Trimmed lines without blank and rule-only ones; five or more of a sign squeezed to two."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?U)^[\s\-_=*+.]*$"))
    squeezed = F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)([^\w\s])\1{4,}", "$1$1"))
    return strip(F.array_join(F.filter(squeezed, lambda x: x.isNotNull()), "\n"))


def clean_ocr(text: Column) -> Column:
    """One space for any white space; doubled bars and long underscores go; four dots or more become three."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    for pattern, new in ((r"\|{2,}", ""), (r"_{3,}", ""), (r"\.{4,}", "...")):
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def _share(text: Column, signs: str) -> Column:
    """Share of characters in runs of ``signs``; null for an empty text. Whole runs go at once: a match per character is slow."""
    n = F.length(text)
    return (n - F.length(F.regexp_replace(text, signs, ""))) / F.nullif(n, F.lit(0))


def alnum_ratio(text: Column) -> Column:
    return _share(text, r"[\p{L}\p{N}]+")


def control_ratio(text: Column) -> Column:
    return _share(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]+")


def few_letters(text: Column) -> Column:
    """Hardly a letter or digit in it; an empty text has no share of them."""
    return (F.length(text) > 0) & (alnum_ratio(text) < 0.15)


def many_controls(text: Column) -> Column:
    """More than a tenth control characters."""
    return (F.length(text) > 0) & (control_ratio(text) > 0.1)


def _may_repeat(times: int, longest: int) -> str:
    """A pattern for whatever has a unit of up to ``longest`` characters ``times`` times in a row, and for little else.

    It looks for half as many units at every few places only: a run is so long that such a place lies in its first half.
    """
    half = (times - 1) // 2
    walks: dict[int, list[str]] = {}
    for k in range(1, longest + 1):
        step = max(1, half << (k.bit_length() - 1))  # at most half * k
        walks.setdefault(step, []).append(rf"(?<u{k}>[^\n]{{{k}}})\k<u{k}>{{{times - 1 - half}}}")
    return r"(?s)\A(?:" + "|".join(rf"(?:.{{{step}}})*?(?={'|'.join(units)})" for step, units in walks.items()) + ")"


def has_long_run(text: Column, times: int = 21) -> Column:
    """One character at least ``times`` times in a row."""
    return text.rlike(_may_repeat(times, 1)) & text.rlike(rf"(?d)(.)\1{{{times - 1},}}")


def has_repeated_unit(text: Column, times: int = 11, longest: int = 10) -> Column:
    """A unit of up to ``longest`` characters at least ``times`` times in a row."""
    return text.rlike(_may_repeat(times, longest)) & text.rlike(rf"(?d)(.{{1,{longest}}})\1{{{times - 1},}}")


def text_is_garbage(text: Column, least: int = 100, long_run: Column | None = None) -> Column:
    """Too short, one character over and over, or hardly a letter in it. ``long_run``: the flag, where it is known."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) < least) | (F.length(t) == 0) | (has_long_run(t) if long_run is None else long_run) | few_letters(t)


def content_is_garbage(text: Column, repeated_unit: Column | None = None) -> Column:
    """Too short once trimmed, a repeated unit, or more than a tenth control characters. ``repeated_unit``: the flag, where it is known."""
    t = F.coalesce(text, F.lit(""))
    return ~t.rlike(r"(?Us)\S.{48,}?\S") | (has_repeated_unit(t) if repeated_unit is None else repeated_unit) | many_controls(t)


#: Families of wrongly decoded UTF-8, counted each by itself (some overlap on purpose).
_LEAD, _LOW = "Ã", "Â"
_MOJIBAKE = [
    *["Ã‚Â" + x for x in "§©®"],
    _LOW + "[\u0080-¿]",
    _LEAD + "[¡-¿]",
    "Ã¢â‚¬\u009d",
    "Ã¢â‚¬Å\"",
    "Ã¢â‚¬â„¢",
    "â€[™œ\"]",
    "Ã¢â‚¬Â",
    "Ã¯Â»Â¿",
    "Ã¢â‚¬",
    "Ã¢â€",
    "â€\"",
    "ÃƒÂ",
    "Ã‚Â",
    "â€¦",
    "â€¹",
    "â€º",
]


def mojibake_count(text: Column) -> Column:
    total = F.lit(0)
    for pattern in _MOJIBAKE:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def is_mojibake(text: Column, threshold: float = 0.15) -> Column:
    """Ten characters or more, and many broken sequences for its length."""
    n = F.length(text)
    count = mojibake_count(text)
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / n
    return F.coalesce((n >= 10) & ((count / n > threshold) | ((foreign > 0.3) & (count > 5))), F.lit(False))


#: Chinese characters by their true ranges; ``legacy`` adds the punctuation blocks that a 4-digit reading covers.
HANZI = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
HANZI_LEGACY = r"[\x{2001}-\x{2A6D}\x{2A71}-\x{2B73}\x{2B75}-\x{2B81}\x{2B83}-\x{2CEA}\x{2F81}-\x{2FA1}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def contains_hanzi(text: Column, legacy: bool = False) -> Column:
    return F.coalesce(text.rlike(HANZI_LEGACY if legacy else HANZI), F.lit(False))


def language_fits(text: Column, lang: str | None, legacy: bool = False) -> Column:
    """zh needs a Chinese character, en none; an empty text or another language always fits."""
    if lang not in ("zh", "en"):
        return F.lit(True)
    found = contains_hanzi(text, legacy)
    return F.coalesce(F.length(text) == 0, F.lit(True)) | (found if lang == "zh" else ~found)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^\p{ASCII}*$")


#: Ordered repairs of text with mixed encodings; earlier pairs win.
_CURLY = {"\u0099": "'", "\u0098": "'", "\u009c": '"', "\u009d": '"', "\u0094": "—", "\u0093": "–", "¦": "…", "\u009a": "š", "\u009b": "›"}
_REPAIRS = [("â\u0080" + k, v) for k, v in _CURLY.items()]
_REPAIRS += [("â€" + k, v) for k, v in (("™", "'"), ("˜", "'"), ("œ", '"'), ('"', "—"))]
_REPAIRS += [(ch.encode("utf-8").decode("latin-1"), ch) for ch in "âéèôçñüöä"]
_REPAIRS += [("Â" + x, x) for x in " ´°"]
_REPAIRS += list(zip("\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0085", "''\"\"•–—…"))


def fix_mixed_encoding(text: Column) -> Column:
    """Byte-order mark off, then the ordered repairs."""
    out = F.regexp_replace(text, "^(﻿|ï»¿)", "")
    for bad, good in _REPAIRS:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def fix_mixed_encoding_py(text: str) -> str:
    """The same repairs for use inside vectorised Python functions."""
    text = text[1:] if text.startswith("﻿") else text[3:] if text.startswith("ï»¿") else text
    for bad, good in _REPAIRS:
        text = text.replace(bad, good)
    return text


# Names, paths and bibliographic text.


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def file_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def year_of(text: Column) -> Column:
    """First run of four digits as a number."""
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")


def authors_of(creators: Column) -> Column:
    """``First Last`` of author creators, else the last name, else the single name; joined by semicolons."""
    of = lambda x, n: F.coalesce(x[n], F.lit(""))
    name = lambda x: F.when((of(x, "firstName") != "") & (of(x, "lastName") != ""), F.concat_ws(" ", x["firstName"], x["lastName"])).when(of(x, "lastName") != "", x["lastName"]).otherwise(of(x, "name"))
    names = F.transform(F.filter(creators, lambda x: x["creatorType"] == "author"), name)
    return F.array_join(F.filter(names, lambda x: x != ""), "; ")


def bibtex_key(entry: Column) -> Column:
    return F.regexp_extract(entry, r"@\w+\s*\{\s*([^,\s]+)\s*,", 1)


def bibtex_field(entry: Column, name: str) -> Column:
    """A braced or quoted field; null when absent."""
    found = F.regexp_extract(entry, rf"(?is)\b{name}\s*=\s*[{{\"](.*?)[}}\"]\s*(?:,|\}}|$)", 1)
    return F.when(found != "", strip(found))


def bibtex_journal(entry: Column) -> Column:
    return F.coalesce(bibtex_field(entry, "journal"), bibtex_field(entry, "booktitle"))


def abstract_of(metadata: Column, text: Column) -> Column:
    """The metadata's abstract, else what follows such a heading up to a blank line, if that has 50 to 2000 characters."""
    given = metadata["abstract"]
    after = lambda heading, end: strip(F.regexp_extract(text, rf"(?is)\b{heading}\b[^\S\n]*[:.]*\s*(.*?)(?:\n\s*\n|{end}$)", 1))
    sized = lambda x: F.when(F.length(x).between(50, 2000), x)
    found, other = after("abstract", r"\n\s*(?:keywords|introduction)\b|"), after("summary", "")
    return F.coalesce(F.when(F.length(F.coalesce(given, F.lit(""))) > 0, given), sized(found), sized(other))


def metadata_key(key: Column) -> Column:
    """Lower case, with underscores for hyphens and spaces."""
    return F.translate(F.lower(strip(key)), "- ", "__")


def normalise_metadata(metadata: Column) -> Column:
    """Blank values dropped, keys normalised, values trimmed; of keys that become one, the last stays."""
    kept = F.map_filter(metadata, lambda _, v: v.isNotNull() & (strip(v) != ""))
    return F.map_from_entries(F.transform(F.map_entries(kept), lambda e: F.struct(metadata_key(e["key"]), strip(e["value"]))))


# Chinese place names.

_PLACES = (
    "Anhui 安徽|Beijing 北京|Chongqing 重庆|Fujian 福建|Gansu 甘肃|Guangdong 广东|Guangxi 广西|Guizhou 贵州|Hainan 海南|Hebei 河北|Heilongjiang 黑龙江|"
    "Henan 河南|Hong Kong 香港|Hubei 湖北|Hunan 湖南|Inner Mongolia 内蒙古|Jiangsu 江苏|Jiangxi 江西|Jilin 吉林|Liaoning 辽宁|Macau 澳门|Ningxia 宁夏|"
    "Qinghai 青海|Shaanxi 陕西|Shandong 山东|Shanghai 上海|Shanxi 山西|Sichuan 四川|Taiwan 台湾|Tianjin 天津|Tibet 西藏|Xinjiang 新疆|Yunnan 云南|Zhejiang 浙江"
)
PLACES = {zh: en for en, zh in (x.rsplit(" ", 1) for x in _PLACES.split("|"))}
#: Longest first, so that a short ending never hides a long one.
ENDINGS = {"特别行政区": "Special Administrative Region", "自治区": "Autonomous Region", "省": "Province", "村": "Village", "乡": "Township", "镇": "Town", "县": "County", "区": "District", "市": "City"}


def place_name(text: Column) -> Column:
    """English for known Chinese places, with their administrative ending; anything else is left as it is."""
    table = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    bare = strip(text)
    out = F.try_element_at(table, bare)
    for zh, en in ENDINGS.items():
        base = F.try_element_at(table, F.regexp_replace(bare, zh + "$", ""))
        out = F.coalesce(out, F.when(bare.endswith(zh), F.concat(base, F.lit(" " + en))))
    return F.when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), F.coalesce(out, text)).otherwise(text)
