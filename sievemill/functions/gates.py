"""Gates that a listing passes on its way: scope, titles, places, ages, descriptions, views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.keys import canonical_url, posting_id, url_id, url_param
from sievemill.functions.text import norm_text, strip

# Placeholders of a place, in normal form, and the length of a whole description.
MISSING_PLACES = ("", "ubicacion no indicada", "location not specified")
WHOLE_TEXT = 600


def _any(words: list[str]) -> str:
    return "|".join(re.sub(r"([^\w ])", r"\\\1", w) for w in words) or r"(?!)"


def is_missing_location(location: Column) -> Column:
    """Whether a place is empty or a placeholder."""
    return norm_text(location).isin(*MISSING_PLACES)


# What stands for a missing title, company and place.
NO_TITLE, NO_COMPANY, NO_PLACE = "Oferta", "Empresa no indicada", "Ubicación no indicada"


def normalise_listing(df: DataFrame) -> DataFrame:
    """Listings with their canonical URL and id, filled placeholders, and the ids they had before as aliases.

    The id is the posting's number where id or URL tell one, else a digest of the canonical URL, else
    what it was. ``aliases`` are distinct, in order: those given, the id given, the digest; never the
    own id, never empty. Blank titles, companies and places get their placeholder; nulls are blank.
    Columns other than title, company, location, url, job_id and aliases stay as they are.
    """
    fill = lambda c, other: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit(other))
    filled = {c: fill(c, other) for c, other in (("title", NO_TITLE), ("company", NO_COMPANY), ("location", NO_PLACE)) if c in df.columns}
    rows = df.withColumns(filled).withColumn("url", canonical_url(F.col("url"), "view")).withColumn("__raw", F.col("job_id")).withColumn("__old", url_id(F.col("url")))
    rows = rows.withColumn("job_id", F.coalesce(posting_id(F.col("__raw"), F.col("url")), "__old", "__raw"))
    given = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in df.columns else F.array().cast("array<string>")
    every = F.array_compact(F.concat(given, F.array("__raw", "__old")))
    rows = rows.withColumn("aliases", F.array_distinct(F.filter(every, lambda a: (a != "") & (F.col("job_id").isNull() | (a != F.col("job_id"))))))
    return rows.select(*df.columns, *([] if "aliases" in df.columns else ["aliases"]))


def guard_card(df: DataFrame, longest: int = 25) -> DataFrame:
    """Cards whose company or place repeats the title get the placeholder instead.

    A field that equals or holds the title, whatever their case, is taken for a misread one if it
    has over ``longest`` characters. Null fields get the placeholder, null titles are empty.
    """
    title = F.lower(strip(F.col("title")))

    def kept(c: str, other: str) -> Column:
        said = strip(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)))
        return F.when(F.contains(F.lower(said), title) & (F.length(said) > longest), other).otherwise(said)

    return df.withColumns({"company": kept("company", NO_COMPANY), "location": kept("location", NO_PLACE)})


def remote_scope(source: Column, urls: Column, candidate: str, host: str, param: str = "f_WT", value: str = "2") -> Column:
    """Whether a search of ``host`` that found the listing was limited to remote work."""
    name = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    asked = lambda u: F.array_contains(F.transform(F.split(F.regexp_replace(F.coalesce(url_param(u, param), F.lit("")), "(?i)%2C", ","), ","), lambda x: F.trim(x)), value)
    hit = F.exists(F.coalesce(urls, F.array().cast("array<string>")), lambda u: name(u).endswith(host) & asked(u))
    return (norm_text(source) == candidate) & hit


def title_gate(title: Column, core: list[str], exclude: list[str], whole_words: tuple[str, ...] = ("ai", "ia")) -> Column:
    """A title with a core stem and none of the excluded ones; short stems count as whole words only."""
    low = F.lower(F.coalesce(title, F.lit("")))
    words, stems = [c for c in core if c in whole_words], [c for c in core if c not in whole_words]
    return ~low.rlike(_any(exclude)) & (low.rlike(_any(stems)) | low.rlike(rf"(?U)\b(?:{_any(words)})\b"))


def location_gate(location: Column, allowed: list[str], disallowed: list[str]) -> Column:
    """An empty place, or one with an allowed word and no disallowed one."""
    low = F.lower(F.trim(F.coalesce(location, F.lit(""))))
    return (low == "") | (~low.rlike(_any(disallowed)) & low.rlike(_any(allowed)))


def card_age_gate(card: Column) -> Column:
    """False for a card that says it is two days or a week old or more; other cards pass."""
    low = F.lower(F.coalesce(card, F.lit("")))
    return ~low.rlike(r"(?U)\b(?:[2-9]|\d{2,})\s*(?:d[ií]as?|days?)\b|\b\d+\s*(?:semanas?|weeks?|mes(?:es)?|months?)\b|\b(?:una|one)\s+(?:semana|week|mes|month)\b")


def needs_enrichment(description: Column, cached: Column, family: Column, negative: list[str], whole: int = WHOLE_TEXT) -> Column:
    """A short description without a stored decision, unless the family is firmly negative."""
    return (F.length(F.coalesce(description, F.lit(""))) < whole) & ~F.coalesce(cached, F.lit(False)) & ~F.coalesce(family.isin(*negative), F.lit(False))


def eligible(recency_state: Column, decision: Column, reason: Column) -> Column:
    """Recent or not bound to a window, not rejected, and without a reason to drop it."""
    return recency_state.isin("accepted", "not_applicable") & (decision["status"] != "rejected") & reason.isNull()


def is_remote(location: Column, modality: Column) -> Column:
    """Whether place or work mode says remote."""
    return F.coalesce(location, F.lit("")).rlike(r"(?iu)\b(?:remoto|remote|teletrabajo)\b") | F.coalesce(F.lower(modality).isin("remote", "100% remoto"), F.lit(False))


def listing_view(df: DataFrame, kind: str, n: int = 10, order: str = "seq") -> DataFrame:
    """A saved view: local, remote, paid (an explicit salary), faulty (no title, url or company) or latest.

    Reads is_local, is_remote, salary, title, url and company. ``latest`` is a top list of ``n``.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    if kind == "latest":
        return df.orderBy(F.desc(order)).limit(n)
    views = {"local": F.col("is_local"), "remote": F.col("is_remote"), "paid": F.col("salary").isNotNull(), "faulty": blank("title") | blank("url") | blank("company")}
    return df.where(views[kind])
