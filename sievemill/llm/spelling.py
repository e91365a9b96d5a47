"""Grouping of spelling variants by pivotal bigrams.

Two words at one edit share a bigram that the edit leaves alone. With the bigrams of a word in one
order, rarest first, its *prefix* is its first three (and all further ones equal to the third), its
*pivots* are the two disjoint bigrams of the prefix that dynamic programming finds rarest. An edit
destroys at most one of two disjoint bigrams, so of two near words the one whose prefix ends first
has a pivot in the prefix of the other. Pivots are therefore matched with prefixes only, and only at
positions at most one apart.

What is left and right of a matched pivot holds the one edit, so one side is equal on both words,
and so is one half of the other side. The keys of the index say all that (pivot with its equal
side, equal half, length), which keeps the lists of a key short; candidates are verified by their
edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table

#: A word of six code points has five bigrams, so three in its prefix of which two are disjoint.
SHORTEST = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = 5, slip: int | None = 199) -> DataFrame:
    """word, n: the runs of Latin letters of all texts, lower-cased in A-Z, with at least ``least`` occurrences.

    Every run for which ``slip`` divides the checksum of ``<doc_id>:<run>`` loses the code point at
    the place that the checksum names (none with ``slip`` None). Only words of ``shortest`` code
    points or more count. Null texts have no words, a null id counts as an empty string there, repeated
    rows count as often as they stand, an empty table has no words.
    """
    text = F.translate(F.col(f"`{text_col}`").cast("string"), _UPPER, _LOWER)
    # A slip only shortens, so no shorter run can become a word.
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if slip is not None:
        h = F.crc32(F.concat("doc", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.length("word") >= shortest) & (F.col("n") >= least))


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """Number of places each bigram has in the distinct words.

    Words are made of 90 letters (a-z and U+00C0 to U+00FF), so there are at most 8,100 bigrams; of
    words with further letters the number is checked.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("over a million distinct bigrams; words are expected in an alphabetic script")
    return {r["gram"]: r["count"] for r in rows}


def pivotal(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the two pivots and of the prefix of ``word``.

    The pivots are the cheapest two disjoint bigrams of the prefix by a dynamic programme from left
    to right: the cheapest bigram that ends before a place, and the cheapest pair up to it.
    """
    grams = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    end = grams[2][:2]
    prefix = sorted((i, cost) for cost, gram, i in grams if (cost, gram) <= end)
    one: list[tuple[int, int]] = []  # cheapest (cost, place) among the first bigrams of the prefix
    pair: tuple[int, int, int] | None = None
    for i, cost in prefix:
        before = [best for best, (p, _) in zip(one, prefix, strict=False) if p <= i - 2]
        if before and (pair is None or before[-1][0] + cost < pair[0]):
            pair = (before[-1][0] + cost, before[-1][1], i)
        one.append(min(one[-1], (cost, i)) if one else (cost, i))
    return [pair[1], pair[2]], [i for i, _ in prefix]


def _features(frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pivotal(w, frequency.value) for w in batch["word"].to_pylist()]
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"word": batch["word"], "pivots": pa.array([f[0] for f in found], places), "prefix": pa.array([f[1] for f in found], places)})

    return run


def _keys(at: Column, shift: Column) -> Column:
    """The keys of a bigram at ``at``, said by the lengths of the word of the prefix side.

    ``shift`` is how much longer the word of the prefix side is. On the left side an equal bigram
    stands at the same place; on the right side it has moved by ``shift``. The half of the side
    with the edit is measured on the word of the prefix side as well.
    """
    word, size = F.col("word"), F.length("word")
    other = size + shift
    # Left side and bigram equal, the edit is to the right of them: one half of the rest is equal.
    rest = other - at - 2
    half = (rest / 2).cast("int")
    left = F.substring(word, F.lit(1), at + 2)
    key_a = F.xxhash64(F.lit("a"), other, at, F.substring(word, F.lit(1), at + 2 + half))
    key_b = F.xxhash64(F.lit("b"), other, at, left, F.substring(word, size - (rest - half) + 1, rest - half))
    # Bigram and right side equal, the edit is to the left of them.
    moved = at + shift
    start = (moved / 2).cast("int")
    right = F.substring(word, at + 1, size)
    key_c = F.xxhash64(F.lit("c"), other, moved, right, F.substring(word, F.lit(1), start))
    key_d = F.xxhash64(F.lit("d"), other, moved, F.substring(word, at - (moved - start) + 1, size))
    fits = [(rest >= 0) & (half <= size - at - 2), (rest >= 0) & (rest - half <= size - at - 2), (moved >= 0) & (start <= at), (moved >= 0) & (moved - start <= at)]
    return F.array_compact(F.array(*[F.when(fit, key) for fit, key in zip(fits, (key_a, key_b, key_c, key_d), strict=True)]))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct words at exactly one inserted, deleted or replaced code point, both ways round.

    ``words`` has a column ``word``, without nulls or repeats and with six code points or more each.
    """
    spark = words.sparkSession
    frequency = spark.sparkContext.broadcast(gram_frequencies(words))
    marked = settle(words.select("word").mapInArrow(_features(frequency), "word string, pivots array<int>, prefix array<int>"), "spelling-marked")
    shifts = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    asked = marked.select("word", F.explode("pivots").alias("at")).select("word", "at", shifts.alias("shift"))
    asked = asked.select(F.col("word").alias("a"), F.explode(_keys(F.col("at"), F.col("shift"))).alias("key"))
    listed = marked.select("word", F.explode("prefix").alias("at"))
    listed = listed.select(F.col("word").alias("b"), F.explode(_keys(F.col("at"), F.lit(0))).alias("key"))
    found = asked.join(listed, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    found = settle(found, "spelling-found")
    return settle(found.union(found.select("b", "a")).distinct(), "spelling-near")


def follow(forms: DataFrame) -> DataFrame:
    """word, root: the last form reached from each word of ``forms`` (word, form).

    A form occurs more often than its word, so there are no circles. Words jump to the form of
    their form, so the rounds are the logarithm of the longest way.
    """
    ways = settle(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if ways.join(onward, "root", "left_semi").isEmpty():
            return ways
        ways = settle(ways.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-ways")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, ratio: int = 5, slip: int | None = None) -> DataFrame:
    """The words of all texts with the form each is a variant of: word, form, root, n, n_near, form_n.

    Words have six letters or more and ``least`` occurrences or more. The form is the near word with
    most occurrences (of equals the smallest), if it has ``ratio`` (over 1) times as many or more as
    the word; ``root`` follows the forms to the last, and is the word itself where there is none.
    Nulls, repeated rows and empty tables count as in ``word_counts``; other columns, whatever their
    names, are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms could go in circles")
    words = settle(word_counts(docs, id_col, text_col, least=least, slip=slip), "spelling-words")
    near = near_words(words)
    known = words.select(F.col("word").alias("b"), "n")
    best = near.join(known, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    judged = settle(words.join(best, "word", "left").withColumn("found", -F.col("best.less") >= ratio * F.col("n")), "spelling-judged")
    rows = judged.select("word", F.when(F.col("found"), F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("found"), -F.col("best.less")).alias("form_n"))
    roots = follow(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slip=199)


ORACLE = r"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, list_transform(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                 lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)), lambda b: b::BIGINT) AS bs FROM counted),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, tbl),
slipped AS (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
holes AS (SELECT DISTINCT word, left(word, i) || '*' || substr(word, i + 2) AS hole FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
gaps AS (SELECT DISTINCT word, left(word, i) || substr(word, i + 2) AS gap FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT x.word AS a, y.word AS b FROM holes x JOIN holes y USING (hole) WHERE x.word <> y.word
         UNION SELECT word, gap FROM gaps WHERE gap IN (SELECT word FROM words) UNION SELECT gap, word FROM gaps WHERE gap IN (SELECT word FROM words)),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS best_n FROM near JOIN words ON words.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN b END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.at WHERE forms.form IS NOT NULL),
roots AS (SELECT ways.word, ways.at AS root FROM ways JOIN forms ON forms.word = ways.at WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""
