"""What a listing as a whole comes to: its features, whether it can be taken up, its score with tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import modality as modes
from sievemill.functions.catalogs import CATALOGS, TOOLS, labels, tech_stack
from sievemill.functions.experience import experience_details
from sievemill.functions.features import company_type, freshness, salary_range
from sievemill.functions.gates import remote_scope
from sievemill.functions.signals import estimate_salary
from sievemill.operators.relevance import RulePack, classify_relevance, filter_reason

# Phrases by which a text tells that a consultancy wrote it, and the tag of a doubtful listing.
CONSULTANCY_PHRASES = ["para importante cliente", "nuestro cliente", "empresa cliente", "consultora líder", "consultora lider", "selección de personal", "headhunting", "servicios de selección", "empresa nos confía"]
DOUBTFUL = "A revisar"


def _content(*names: str) -> Column:
    """The texts that aren't empty, with a blank between."""
    return F.array_join(F.filter(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]), lambda t: t != ""), " ")


def record_features(df: DataFrame, places: modes.Places, tools: dict[str, list[str]] = TOOLS) -> DataFrame:
    """Add ``features``: experience in full, stack, the catalogs' labels, pay and work mode.

    Reads title, description and location together; nulls are empty. A ``features`` column that was
    there is replaced.
    """
    rows = df.withColumn("__text", _content("title", "description", "location")).withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")
    told = {"experience": experience_details(text, tools), "stack": tech_stack(text, tools, low)} | {name: labels(text, c, low) for name, c in CATALOGS.items()}
    told |= {"salary": salary_range(text), "modality": modes.modality(text, F.col("location"), places)}
    return rows.withColumn("features", F.struct(*[c.alias(name) for name, c in told.items()])).drop("__text", "__low")


def can_take_up(df: DataFrame, places: modes.Places, candidate: str = "linkedin", host: str = "linkedin.com", urls: str | None = None) -> DataFrame:
    """Add ``mode`` and ``viable``: the work mode, and whether the listing can be taken up from the home places.

    Anything at a home place, elsewhere remote work only. Where ``urls`` (an array) names the searches that
    found a listing of the candidate source, a search limited to remote work stands against a place
    that is only a country, unless text or place speak for another city, on-site or hybrid work. A
    mode in ``features``, where that column is there, goes before the text's own. Nulls are empty.
    """
    mode = modes.modality(_content("title", "description", "location"), F.col("location"), places)
    rows = df.withColumn("mode", mode)
    can = modes.viable(F.col("title"), F.col("description"), F.col("location"), F.col("mode"), places)
    if urls is not None:
        told = F.col("features.modality") if "features" in df.columns and "modality" in df.schema["features"].dataType.fieldNames() else None
        scope = F.coalesce(remote_scope(F.col("source"), F.col(urls), candidate, host), F.lit(False))
        can = modes.viable_in_scope(can, scope, F.col("description"), F.col("location"), F.col("mode"), told, places)
    return rows.withColumn("viable", can)


def drop_reason(df: DataFrame, places: modes.Places, include: list[str], exclude: list[str], candidate: str = "linkedin", host: str = "linkedin.com", urls: str | None = None) -> DataFrame:
    """Add ``reason``: exclude, location, include or null, with the place judged by ``can_take_up``.

    Level and least years come from ``features.experience`` where that is there.
    """
    rows = can_take_up(df, places, candidate, host, urls)
    fields = df.schema["features"].dataType.fieldNames() if "features" in df.columns else []
    if "experience" in fields:
        rows = rows.withColumn("level", F.col("features.experience.level")).withColumn("minimum_years", F.col("features.experience.minimum_years"))
    reason = filter_reason(rows, F.col("viable"), include, exclude, candidate)
    return rows.withColumn("reason", reason).select(*df.columns, "mode", "viable", "reason")


def match_record(df: DataFrame, places: modes.Places, consultancies: list[str], rules: RulePack | None = None, tools: dict[str, list[str]] = TOOLS) -> DataFrame:
    """Add ``match``: score, tags, stack, pay, experience, mode, kind of company, freshness.

    The score and up to four tags are those of the relevance decision: the terms it found, in capitals,
    behind a mark for a doubtful listing. The rest only helps to choose and never changes the score. ``pay``
    is what the text tells, else the market's estimate in thousands (``told`` says which). Reads title,
    company, location, description, source and ``is_fresh``; nulls are empty.
    """
    rows = classify_relevance(df.drop("decision"), rules).withColumn("__text", _content("title", "description"))
    text, decision = F.col("__text"), F.col("decision")
    tags = F.transform(decision["positive_evidence"], lambda e: F.upper(F.regexp_replace(e, "^[^:]*:", "")))
    tags = F.slice(F.concat(F.when(decision["status"] == "warning", F.array(F.lit(DOUBTFUL))).otherwise(F.array().cast("array<string>")), tags), 1, 4)
    rows = rows.withColumn("__stack", tech_stack(text, tools)).withColumn("__experience", experience_details(text, tools)["display"])
    kind = company_type(F.col("company"), F.coalesce("description", F.lit("")), consultancies, CONSULTANCY_PHRASES)
    own = salary_range(text)
    market = estimate_salary(text, F.col("__experience"), F.col("location"), kind == "product", F.size("__stack"))
    pay = F.when(own.isNotNull(), F.struct(own["min"].cast("long").alias("min"), own["max"].cast("long").alias("max"), F.lit(True).alias("told")))
    pay = pay.otherwise(F.struct((market["min"] * 1000).cast("long").alias("min"), (market["max"] * 1000).cast("long").alias("max"), F.lit(False).alias("told")))
    fresh = freshness(F.coalesce("is_fresh", F.lit(False)), F.coalesce("description", F.lit("")))
    match = F.struct(decision["score"].alias("score"), tags.alias("tags"), F.col("__stack").alias("stack"), pay.alias("pay"), F.col("__experience").alias("experience"), modes.modality(text, F.col("location"), places).alias("mode"), kind.alias("kind"), fresh.alias("freshness"))
    return rows.withColumn("match", match).select(*df.columns, "match")
