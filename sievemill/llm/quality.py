"""Quality classification by co-training a text view and a metadata view.

Each view has its own logistic classifier. Over rounds each labels pool documents for the other one
to train on: those it is surest of after calibration on held-out labels, of both classes in the
proportion of the labels, so a view that can tell only one class hands over none. The views are then
calibrated again and their log-odds are added, as for views that are independent given the label, to
score all documents. Labelled rows are bounded; the pool is a share of all documents without a ceiling.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table

SHAPES, WORD_SLOTS, META_SLOTS = 1 << 10, 1 << 12, 1 << 10
#: A fit has a task for so many rows, and this number of tasks at least.
FIT_ROWS, FIT_TASKS = 20_000, 6
#: What ``score`` adds.
ADDED = ("text_score", "meta_score", "score", "keep")


def text_view(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``__tv``: rates of words and of word shapes, and the text's size, word length and variety.

    Words are hashed in lower case. A word's shape keeps its marks and turns runs of capitals,
    small letters and digits into one sign each.
    """
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("__text"), r"\p{Lu}+", "A"), r"[\p{Ll}\p{Lo}]+", "a"), r"\p{N}+", "0")
    words, n = F.col("__words"), F.greatest(F.size("__words"), F.lit(1))
    style = [F.log1p(n.cast("double")), F.length("__text") / n, F.size(F.array_distinct(words)) / n, F.size(F.array_distinct("__shapes")) / n]
    out = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    out = out.withColumn("__words", F.split("__text", r"\s+")).withColumn("__shapes", F.split(shape, r"\s+"))
    out = out.withColumns({f"__style_{i}": c for i, c in enumerate(style)})
    out = HashingTF(numFeatures=SHAPES, inputCol="__shapes", outputCol="__count").transform(out)
    out = Normalizer(p=1.0, inputCol="__count", outputCol="__rate").transform(out)
    out = out.withColumn("__lower", F.split(F.lower("__text"), r"\s+"))
    out = HashingTF(numFeatures=WORD_SLOTS, inputCol="__lower", outputCol="__said").transform(out)
    out = Normalizer(p=1.0, inputCol="__said", outputCol="__word_rate").transform(out)
    return VectorAssembler(inputCols=[*(f"__style_{i}" for i in range(len(style))), "__rate", "__word_rate"], outputCol="__tv").transform(out)


def meta_view(docs: DataFrame, meta_cols: list[str], size_col: str | None) -> DataFrame:
    """Add ``__mv``: the hashed values of up to two metadata columns, the size's magnitude, and that within the first column."""
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in meta_cols] + [F.lit(""), F.lit("")]
    size = F.coalesce(F.floor(2 * F.log1p(F.greatest(F.col(f"`{size_col}`").cast("double"), F.lit(0.0)))).cast("string"), F.lit("")) if size_col else F.lit("")
    out = docs.withColumn("__meta_a", names[0]).withColumn("__meta_b", names[1]).withColumn("__meta_c", size).withColumn("__meta_d", F.concat_ws("|", "__meta_a", "__meta_c"))
    return FeatureHasher(numFeatures=META_SLOTS, inputCols=["__meta_a", "__meta_b", "__meta_c", "__meta_d"], outputCol="__mv").transform(out)


def _fit(rows: DataFrame, features: str, tasks: int = FIT_TASKS) -> LogisticRegressionModel:
    # Few tasks carry the many short jobs of a fit.
    return LogisticRegression(featuresCol=features, labelCol="label", maxIter=20, regParam=0.001).fit(rows.coalesce(tasks))


def _margin(df: DataFrame, model: LogisticRegressionModel, features: str, out: str) -> DataFrame:
    """Add the log-odds that ``model`` gives, as a number."""
    raw, used = "__raw", "__probability"
    scored = model.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(used).setPredictionCol("__prediction").transform(df)
    return scored.withColumn(out, vector_to_array(raw)[1]).drop(raw, used, "__prediction")


def _platt(margin: np.ndarray, label: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) that turn margins into log-odds of the labels, by Newton's method.

    The held-out labels are at most a fifth of the bounded sample, so they fit on the driver.
    """
    scale = max(1e-9, float(np.std(margin)))
    x, w = np.stack([margin / scale, np.ones(len(margin))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) / len(label) + penalty * np.array([w[0], 0])
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(label) + np.diag([penalty, 1e-9]), gradient)
        w -= step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _handed_over(pool: DataFrame, margin: str, taken: str, good: float, sure: float) -> Column:
    """The label that a view gives to the rest of the pool for the other one, where it is surest.

    ``margin`` are calibrated log-odds. Of the rows the view is ``sure`` about, as many of either class
    are taken as the proportion of the labels (``good`` of them good) allows, from the surest on.
    """
    limit = math.log(sure / (1 - sure))
    open_ = pool.where(F.col(taken).isNull())
    yes, no = open_.agg(F.count_if(F.col(margin) >= limit), F.count_if(F.col(margin) <= -limit)).first()
    both = min(yes / good, no / (1 - good))
    if both <= 0:
        return F.lit(None).cast("double")
    high = open_.where(F.col(margin) >= limit).approxQuantile(margin, [max(0.0, 1 - both * good / yes)], 0.001)[0]
    low = open_.where(F.col(margin) <= -limit).approxQuantile(margin, [min(1.0, both * (1 - good) / no)], 0.001)[0]
    return F.when(F.col(margin) >= high, 1.0).when(F.col(margin) <= low, 0.0)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str], size_col: str | None, label_col: str, rounds: int, sure: float, sample_labels: int, pool_share: float, threshold: float) -> DataFrame:
    """``docs``, whose columns have names of their own, with ``ADDED`` behind two underscores."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__label_of")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    n_labels = told.count()
    drawn = lambda c, share: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < F.lit(round(min(1.0, share) * 1_000_000))
    views = lambda df: meta_view(text_view(df, text_col), list(meta_cols)[:2], size_col)
    few = told.where(drawn("__label_of", sample_labels / max(1, n_labels)))
    key = F.col(f"`{id_col}`").cast("long")
    base = docs.select(key.alias("__id"), *[F.col(f"`{c}`") for c in dict.fromkeys([text_col, *meta_cols, *([size_col] if size_col else [])])])
    # ``few`` is bounded by ``sample_labels`` rows of 16 bytes.
    labelled = settle(views(base.join(F.broadcast(few), F.col("__id") == F.col("__label_of"))).select("__id", "__tv", "__mv", "label"), "quality-labelled")
    train, held = labelled.where("pmod(xxhash64(__id, 1), 5) > 0"), labelled.where("pmod(xxhash64(__id, 1), 5) = 0")
    if min(train.select("label").distinct().count(), held.select("label").distinct().count()) < 2:
        return docs.select("*", *[F.lit(1.0).alias(f"__{c}") for c in ADDED[:3]], F.lit(True).alias("__keep"))
    # A share of all documents, whatever their number.
    pool = base.where(drawn("__id", pool_share)).join(told, F.col("__id") == F.col("__label_of"), "left_anti")
    pool = settle(views(pool).select("__tv", "__mv", F.lit(None).cast("double").alias("for_text"), F.lit(None).cast("double").alias("for_meta")), "quality-pool")
    tasks = max(FIT_TASKS, -(-(pool.count() + sample_labels) // FIT_ROWS))
    good = train.agg(F.avg("label")).first()[0]
    prior = math.log(good / (1 - good))
    for turn in range(rounds + 1):
        by_text = _fit(train.select("__tv", "label").unionByName(pool.where("for_text IS NOT NULL").select("__tv", F.col("for_text").alias("label"))), "__tv", tasks)
        by_meta = _fit(train.select("__mv", "label").unionByName(pool.where("for_meta IS NOT NULL").select("__mv", F.col("for_meta").alias("label"))), "__mv", tasks)
        seen = _margin(_margin(held, by_text, "__tv", "t"), by_meta, "__mv", "m").select("t", "m", "label").toPandas()
        calibrated = {}
        for view in ("t", "m"):
            slope, intercept = _platt(seen[view].to_numpy(), seen["label"].to_numpy())
            calibrated[view] = F.col(view) * F.lit(slope) + F.lit(intercept)
        if turn < rounds:
            asked = settle(_margin(_margin(pool, by_text, "__tv", "t"), by_meta, "__mv", "m").withColumns(calibrated), "quality-asked")
            for_text, for_meta = _handed_over(asked, "m", "for_text", good, sure), _handed_over(asked, "t", "for_meta", good, sure)
            pool = settle(asked.select("__tv", "__mv", F.coalesce("for_text", for_text).alias("for_text"), F.coalesce("for_meta", for_meta).alias("for_meta")), "quality-pool")
    t, m = calibrated["t"], calibrated["m"]
    chance = lambda c: 1 / (1 + F.exp(-c))
    out = _margin(_margin(views(docs), by_text, "__tv", "t"), by_meta, "__mv", "m")
    out = out.withColumn("__text_score", chance(t)).withColumn("__meta_score", chance(m)).withColumn("__score", chance(t + m - prior))
    return out.select(*docs.columns, *[f"__{c}" for c in ADDED[:3]], (F.col("__score") >= threshold).alias("__keep"))


def _renamed(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...], size_col: str | None, *rest) -> DataFrame:
    """``_scored`` with the columns of ``docs`` as __0, __1 and so on, so that no name can clash."""
    at = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return _scored(docs.toDF(*at.values()), labels.withColumnRenamed(id_col, at[id_col]), at[id_col], at[text_col], [at[c] for c in meta_cols], size_col and at[size_col], *rest)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str | None = "n_chars", label_col: str = "quality", rounds: int = 2, sure: float = 0.95, sample_labels: int = 20_000, pool_share: float = 0.25, threshold: float = 0.5) -> DataFrame:
    """``docs`` with text_score, meta_score, score (chance of good quality) and keep.

    ``labels`` has ``id_col`` and a 0/1 ``label_col``; at most about ``sample_labels`` of them
    train (a fifth of these calibrate), and ``pool_share`` of all documents, less the labelled, are
    the pool that ``rounds`` of exchange draw from, where a view is at least ``sure``. Every
    document is scored over its whole text. Null texts are empty, null metadata is a value of
    its own; null, repeated and contradictory labels are dropped, used once and averaged (half
    or more is good). Without labels of both kinds nothing can be told: every score is 1.0 and
    all are kept. Repeated rows and empty tables need no care; other columns are passed on,
    but for those named like the four that are added, which these replace.
    """
    found = _renamed(docs, labels, id_col, text_col, meta_cols, size_col, label_col, rounds, sure, sample_labels, pool_share, threshold)
    given = [F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED]
    return found.select(*given, *[F.col(f"__{c}").alias(c) for c in ADDED])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str | None = "n_chars", label_col: str = "quality", rounds: int = 2, sure: float = 0.95, sample_labels: int = 20_000, pool_share: float = 0.25, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with their own columns only."""
    found = _renamed(docs, labels, id_col, text_col, meta_cols, size_col, label_col, rounds, sure, sample_labels, pool_share, threshold).where("__keep")
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("text_score", "meta_score", "score")], "keep")
