"""Quality rules with a bitmask ledger.

Every rule is evaluated once: a scan takes the measurements of each text, and each rule that fails
sets its bit. The ledger (id, measurements, ``failed``) is all that policies read: a policy is a
versioned set of masks over those bits, so another policy, or a policy less one rule, needs no
second look at the texts. Ablations count distinct bitmasks first and work on those few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain_words", "n_loud_words")

#: Rules by name, in the order of their bits: SQL over the measurements that is true for a failure.
#: New rules are added at the end, so that older ledgers keep their meaning.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "letterless": "100 * n_plain_words < 70 * n_words",
    "loud": "100 * n_loud_words > 40 * n_words",
    "many_words": "n_words > 100000",
}


@dataclass(frozen=True)
class Policy:
    """A document is rejected by one failed rule of ``reject``, or by ``limit`` failed rules of ``doubt``."""

    version: str
    reject: tuple[str, ...]
    doubt: tuple[str, ...] = ()
    limit: int = 2

    def __post_init__(self) -> None:
        unknown = set(self.reject + self.doubt) - set(RULES)
        if unknown:
            raise ValueError(f"unknown rules in policy {self.version}: {sorted(unknown)}")


BASE = Policy("base", ("few_words", "repeated_words"))
PLAIN = Policy("plain", (*BASE.reject, "symbols", "repeated_lines"))
FULL = Policy("full", (*PLAIN.reject, "letterless", "loud"), ("short_words", "long_words", "many_words"), 1)


def mask(names: tuple[str, ...]) -> int:
    """The bits of the rules called ``names``."""
    order = list(RULES)
    return sum(1 << order.index(n) for n in set(names))


def repeat_words(rank: np.ndarray, n: int, window: int = WINDOW) -> int:
    """Number of words that lie in a window of ``window`` (a power of two) words found twice or more.

    ``rank`` holds the number of each word, below ``n``. Windows are told apart exactly: equal pairs
    get equal numbers, then pairs of pairs, and so on.
    """
    size, width = len(rank), 1
    if size <= window:
        return 0
    while width < window:
        if n == len(rank):
            return 0
        values, rank = np.unique(rank[:-width] * n + rank[width:], return_inverse=True)
        width, n = 2 * width, len(values)
    twice = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    edges = np.bincount(twice, minlength=size + 1) - np.bincount(twice + window, minlength=size + 1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of a text; null is the empty text.

    ``bytes.split`` parts words at ASCII white space only. A plain word holds a letter; a loud one
    has two characters or more, capitals and no small letters.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    times = np.bincount(rank, minlength=len(numbers))
    distinct = [w.decode() for w in numbers]
    plain = np.fromiter((s.isalpha() or any(map(str.isalpha, s)) for s in distinct), bool, len(distinct))
    loud = np.fromiter((len(s) > 1 and s.isupper() for s in distinct), bool, len(distinct))
    chars = len(text) - len(raw) + sum(map(len, words))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(rank, len(numbers)), len(lines), int(times[plain].sum()), int(times[loud].sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch["text"].to_pylist()]
        found = {m: pa.array(column, pa.int64()) for m, column in zip(MEASURES, zip(*rows, strict=True) if rows else [[]] * len(MEASURES), strict=True)}
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | found)


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements, and ``failed``, a bit for each failed rule.

    Null texts count as empty; null ids stay null; repeated rows and ids each give their row; an
    empty table gives none. Other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    measured = rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), 1 << i).otherwise(0).cast("long") for i, rule in enumerate(RULES.values())]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def verdict(policy: Policy, failed: str | Column = "failed") -> Column:
    """Whether a document with these bits is kept under ``policy``; null bits give null."""
    bits = F.col(failed) if isinstance(failed, str) else failed
    clean = bits.bitwiseAND(F.lit(mask(policy.reject)).cast("long")) == 0
    if not policy.doubt:
        return clean
    return clean & (F.bit_count(bits.bitwiseAND(F.lit(mask(policy.doubt)).cast("long"))) < policy.limit)


def apply_policies(ledger: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with a column ``kept_<version>`` for each policy."""
    return ledger.select("*", *[verdict(p).alias(f"kept_{p.version}") for p in policies])


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of ``policy`` does: version, rule, n_failed, n_alone, n_kept, n_kept_without.

    ``n_failed`` documents fail the rule, ``n_alone`` fail no other rule of the policy, ``n_kept``
    are kept by the whole policy and ``n_kept_without`` by the policy without the rule. Documents
    are counted by bitmask first, so the rest works on at most two to the number of rules rows. An
    empty ledger gives a row of zeros for each rule.
    """
    counts = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    names = tuple(dict.fromkeys(policy.reject + policy.doubt))
    mine = F.col("failed").bitwiseAND(F.lit(mask(names)).cast("long"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    def less(name: str) -> Policy:
        return Policy(policy.version, tuple(n for n in policy.reject if n != name), tuple(n for n in policy.doubt if n != name), policy.limit)

    totals = [
        F.struct(F.lit(name).alias("rule"), total(F.col("failed").bitwiseAND(F.lit(mask((name,))).cast("long")) != 0).alias("n_failed"), total(mine == mask((name,))).alias("n_alone"), total(verdict(policy)).alias("n_kept"), total(verdict(less(name))).alias("n_kept_without"))
        for name in names
    ]
    return counts.agg(F.array(*totals).alias("rules")).select(F.lit(policy.version).alias("version"), F.explode("rules").alias("r")).select("version", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rule_ledger(table(spark, sf_dir, "documents"))
    return ledger.select("doc_id", *MEASURES[:5], (~verdict(BASE)).alias("base_failed"), verdict(FULL).alias("kept"), *MEASURES[5:], "failed")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT rid, i, list_slice(words, i, i + 7) AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM windows),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) AS s(k) WHERE times > 1 GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_plain_words,
             len(list_filter(words, lambda x: length(x) > 1 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS n_loud_words
      FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
             + 16 * (2 * word_chars < 5 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT + 64 * (100 * n_plain_words < 70 * n_words)::INT
             + 128 * (100 * n_loud_words > 40 * n_words)::INT + 256 * (n_words > 100000)::INT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, n_plain_words, n_loud_words, failed::BIGINT AS failed
FROM f
"""
