"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting one
decides. They are a fixed, small configuration, compiled into column expressions, so no join is needed.
Where no rule fits, the vocabulary decides: one automaton finds every term of all URLs of a batch, a hit
counts only between boundaries (no letter or digit on either side), one strict term or several distinct
soft ones reject.

Defined results: a null URL, or one without ``://``, has an empty host and path and is allowed; a URL of any
length is searched whole; a null key stays null; repeated rows get equal results; an empty table gives none. Only the key and URL
columns are read, so others cannot clash.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # block or allow
    host: str
    path: str  # starts with /

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "com", "/en/"), UrlRule("allow", "example.com", "/en/7"), UrlRule("allow", "net", "/de/"), UrlRule("block", "example.net", "/de/8"), UrlRule("block", "org", "/es/"))

TERMS = os.path.join(os.path.dirname(__file__), "url_terms.tsv")
#: Distinct soft terms and their sum of weights from which a URL is rejected: a strong term needs any other, weak ones each other in number.
SOFT_DISTINCT, SOFT_WEIGHT = 2, 4


def load_terms(path: str = TERMS) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms, and soft ones with weights, of a file of lines ``term <tab> strict or weight``; A-Z are lower-cased."""
    strict, soft = [], {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                term, _, weight = line.rstrip("\n").partition("\t")
                term = term.translate(_TABLE)
                if weight == "strict":
                    strict.append(term)
                else:
                    soft[term] = int(weight)
    return tuple(strict), soft


_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TABLE = str.maketrans(*_LOWER)
STRICT, SOFT = load_terms()
HITS = T.StructType().add("n_strict", "integer").add("n_soft", "integer").add("soft_weight", "integer").add("terms", "string")


def host_of(url: Column) -> Column:
    """From after the first ``://`` to the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; ties go to the one named first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last one wraps the others, so the longest is tried first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict, soft.get(term, 0)))
    found.make_automaton()
    return found


def hits_of(url: str, found) -> tuple[set[str], dict[str, int]]:
    """Distinct strict terms, and soft ones with weights, that stand between boundaries."""
    low = url.lower() if url.isascii() else url.translate(_TABLE)
    strict, soft, n = set(), {}, len(low)
    for end, (term, is_strict, weight) in found.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == n or not low[end + 1].isalnum()):
            if is_strict:
                strict.add(term)
            if weight:
                soft[term] = weight
    return strict, soft


_FOUND = None


def search(url: Column, strict=STRICT, soft=SOFT) -> Column:
    """Struct of hit counts for each URL, by a vectorised function with one automaton per process."""

    @F.pandas_udf(HITS)
    def run(urls: pd.Series) -> pd.DataFrame:
        global _FOUND
        key = (tuple(strict), tuple(sorted(soft.items())))
        if _FOUND is None or _FOUND[0] != key:
            _FOUND = (key, automaton(strict, soft))
        rows = []
        for u in urls:
            s, w = hits_of(u, _FOUND[1]) if u else ((), {})
            rows.append((len(s), len(w), sum(w.values()), ",".join(sorted({*s, *w}))))
        return pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight", "terms"])

    return run(url)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """key, host, path, rule, verdict and the vocabulary's hits for every row."""
    rows = pages.select(F.col(key), F.col(url).cast("string").alias("_url"))
    rows = rows.select(F.col(key), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), search(F.when(F.col("_url").contains("://"), F.col("_url")), strict, soft).alias("_hits"))
    text, verdict = fitting(rules, F.col("host"), F.col("path"))
    rejected = (F.col("_hits.n_strict") >= 1) | ((F.col("_hits.n_soft") >= SOFT_DISTINCT) & (F.col("_hits.soft_weight") >= SOFT_WEIGHT))
    return rows.select(F.col(key), "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"), F.col("_hits.n_strict").alias("n_strict"), F.col("_hits.n_soft").alias("n_soft"), F.col("_hits.terms").alias("terms"))


def op6_url_vocabulary(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
