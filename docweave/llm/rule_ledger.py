r"""Quality rules as a ledger: every rule is evaluated once, and its outcome kept as a bit with its measurement.

``measure`` scans the texts once and gives, per document, the measurements and a bitmask in which bit *i*
is set when rule *i* of ``RULES`` fails. Policies are versioned sets of rules: applying one, comparing two
or asking what a rule alone rejects needs only bitwise operations on the ledger, never the text.

Words are runs of characters other than ``[\x20\x09-\x0D]``; lines are parted by ``\n``. A null or empty
text has no word, so it fails the rule for short texts; texts of any length are measured whole; equal rows
get equal results; a null key stays null. Only the key and text columns are read, so other columns cannot clash. An empty table
gives an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _common as c

SYMBOLS = "#*$%&|<>"
_BLANKS = str.maketrans(dict.fromkeys("\t\x0b\x0c\r", " "))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_echo_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements."""

    name: str
    fails: str


#: The place in this list is the bit. Never reorder it; append only, so that stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("too_many_words", "n_words > 1000000"),
    Rule("symbol_ratio", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("mean_word_too_short", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("mean_word_too_long", "n_words > 0 AND word_chars > 15 * n_words"),
    Rule("few_alphabetic_words", "10 * n_alpha_words < 6 * n_words"),
    Rule("echoed_words", "10 * n_echo_words > 3 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": mask_of("too_few_words", "repeated_windows"),
    "strict-1": mask_of(*BIT),
    # Without the cap on size, which says nothing about a text's quality.
    "strict-2": mask_of(*BIT) & ~BIT["too_many_words"],
}
LEDGER = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(m, T.LongType()) for m in MEASURES]])


class _Measurer:
    """Measures texts; words get numbers that live as long as the task's process, in a table of about ``limit`` bytes."""

    def __init__(self, limit: int = 160 << 20):
        self.number: dict[str, int] = {}
        self.limit, self.size = limit, 0

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number)
                self.size += 150 + 2 * len(w)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    @staticmethod
    def repeated(ids: np.ndarray, width: int = 8) -> int:
        """Words inside windows of ``width`` words that occur at least twice; exact, by doubling ids."""
        n = len(ids) - width + 1
        if n < 2:
            return 0
        if len(np.unique(ids)) == len(ids):
            return 0
        span = 1
        while span < width:
            ids = np.unique(ids[:-span] << 32 | ids[span:], return_inverse=True)[1]
            span *= 2
            # As soon as no window of this span comes twice, no longer one can.
            if ids.max(initial=-1) + 1 == len(ids):
                return 0
        often = np.bincount(ids)[ids] > 1
        mark = np.zeros(n + width, np.int64)
        mark[:n] += often
        mark[width : width + n] -= often
        return int((np.cumsum(mark) > 0).sum())

    def __call__(self, text: str) -> tuple[int, ...]:
        words = (text.translate(_BLANKS) if any(x in text for x in "\t\x0b\x0c\r") else text).replace("\n", " ").split(" ")
        words = [w for w in words if w] if "" in words else words
        if self.size > self.limit:
            self.number.clear()
            self.size = 0
        ids = self.numbers(words)
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        n_symbols = sum(map(text.count, SYMBOLS))
        n_alpha = sum(map(str.isalpha, [w.strip(".,;:!?\"'()[]") for w in words]))
        return len(words), sum(map(len, words)), n_symbols, len(kept) - len(set(kept)), self.repeated(ids), len(kept), n_alpha, int(np.count_nonzero(ids[1:] == ids[:-1]))


_MEASURE: _Measurer | None = None


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements of every text, in one pass without an exchange."""
    schema = pa.schema([(f.name, pa.int64()) for f in LEDGER.fields])

    def run(batches):
        global _MEASURE
        _MEASURE = _MEASURE or _Measurer()
        for batch in c.slices(batches, 1024):
            rows = [_MEASURE(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) or [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in columns]], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return c.spread(rows).mapInArrow(run, LEDGER)


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``failed_bits``: bit *i* is set when rule *i* fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total)


def passes(policy: str | int, bits: str = "failed_bits") -> Column:
    """Whether a ledger row has no failure that the policy counts."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def ablation(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that any other rule rejects.

    One aggregation over the bits with partial sums; a row per rule, whatever the number of documents.
    """
    mask = POLICIES[policy]
    names = [(i, r.name) for i, r in enumerate(rules) if mask >> i & 1]
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    aggs = [F.count(F.lit(1)).alias("n_docs")]
    for i, _ in names:
        aggs += [F.count_if(hit.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"f{i}"), F.count_if(hit == F.lit(1 << i).cast("long")).alias(f"a{i}"), F.count_if(hit.bitwiseAND(F.lit(mask & ~(1 << i)).cast("long")) != 0).alias(f"o{i}")]
    one = book.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(i).alias("bit"), F.col(f"f{i}").alias("n_failed"), F.col(f"a{i}").alias("n_failed_alone"), F.col(f"o{i}").alias("n_rejected_without")) for i, n in names])
    return one.select("n_docs", F.inline(rows)).withColumn("policy", F.lit(policy))


def apply_rules(docs: DataFrame, policy: str = "strict-1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A ledger row per document with the verdict of ``policy``."""
    return ledger(measure(docs, key, text)).withColumn("base_failed", ~passes("base-1")).withColumn("kept", passes("base-1") & passes(policy))


def keep_good(docs: DataFrame, policy: str = "strict-1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with all their columns, in one pass without an exchange."""
    taken, prefix = {x.lower() for x in docs.columns}, "_m_"
    while any(prefix + m in taken for m in MEASURES):
        prefix = "_" + prefix
    names = [prefix + m for m in MEASURES]
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        global _MEASURE
        _MEASURE = _MEASURE or _Measurer()
        for batch in c.slices(batches, 1024):
            rows = [_MEASURE(t or "") for t in batch.column(at).to_pylist()]
            columns = list(zip(*rows)) or [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in columns]], [*batch.schema.names, *names])

    measured = c.spread(docs).mapInArrow(run, schema)
    fails = [f"({re.sub(r'\b(' + '|'.join(MEASURES) + r')\b', lambda m: '`' + prefix + m[0] + '`', r.fails)})" for r in RULES if (POLICIES[policy] | POLICIES["base-1"]) & BIT[r.name]]
    return measured.where("NOT (" + " OR ".join(fails) + ")").drop(*names)


def op4_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the strict policy."""
    book = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
