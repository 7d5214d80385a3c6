"""Strict re-decoding of broken text, where the JVM has no built-in: vectorised Python functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import _MOJIBAKE

_PATTERNS = [re.compile(p) for p in _MOJIBAKE]


def looks_broken(text: str, threshold: float = 0.15) -> bool:
    n = len(text)
    if n < 10:
        return False
    count = sum(len(p.findall(text)) for p in _PATTERNS)
    return count / n > threshold or sum(ch > "\x7f" for ch in text) / n > 0.3 and count > 5


def repair(text: str | None) -> str | None:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again; kept only if that heals the text."""
    if not text or not looks_broken(text):
        return text
    for codec in ("latin-1", "cp1252"):
        try:
            fixed = text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        return text if looks_broken(fixed) else fixed
    return text


def fix_mojibake(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(repair)

    return run(text)


def decode_bytes(data: bytes | None) -> str:
    """UTF-8 if it is valid, UTF-16 by its mark, else Windows-1252 with undefined bytes dropped."""
    data = data or b""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "ignore")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "ignore")


def decoded(content: Column) -> Column:
    """Text of a binary column: the JVM's decoder where it is valid UTF-8, Python's for the rest."""

    @F.pandas_udf("string")
    def other(values: pd.Series) -> pd.Series:
        return values.map(decode_bytes)

    text = F.try_validate_utf8(content.cast("string"))
    return F.when(text.isNotNull(), text).otherwise(other(content))
