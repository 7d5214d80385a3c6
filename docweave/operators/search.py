"""Full text: a postings table, boolean search and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame, key: str, columns: list[str], terms: list[str] | None = None) -> DataFrame:
    """(key, term, tf, dl): frequencies per document; with ``terms`` of these alone, counted within the row without any exchange."""
    all_ = F.concat(*[tokens(F.col(c)) for c in columns])
    rows = docs.select(F.col(key), all_.alias("t"))
    if terms is not None:
        wanted = F.array(*[F.lit(t) for t in dict.fromkeys(x.lower() for x in terms)])
        few = rows.select(key, F.size("t").alias("dl"), F.filter("t", lambda x: F.array_contains(wanted, x)).alias("t"), F.explode(wanted).alias("term"))
        return few.select(key, "term", F.size(F.filter("t", lambda x: x == F.col("term"))).cast("long").alias("tf"), "dl").where("tf > 0")
    rows = rows.select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def search_all(docs: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Rows that hold every term as a word; no index needed."""
    words = F.concat(*[tokens(F.col(c)) for c in columns])
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(x.lower() for x in terms)])
    return docs.where(F.size(F.array_except(wanted, words)) == 0) if terms else docs


def bm25(index: DataFrame, key: str, terms: list[str], n_docs: int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of the documents that hold any of the terms."""
    hits = index.where(F.col("term").isin([t.lower() for t in terms]))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean_length))
    return hits.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(score).alias("score"))  # df has at most a row per query term
