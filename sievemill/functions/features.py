"""Facts told by a listing's text, as Columns. Word lists are parameters with small defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default patterns of work modes, in the order in which they are tried.
MODES = [
    ("on-site", r"\b(no remoto|no remote|sin teletrabajo|not remote)\b"),
    ("hybrid", r"\b\d\s*(d[ií]as?|days?)\s+(de\s+|of\s+)?(teletrabajo|remoto|remote|en casa|oficina|office)|\b(h[ií]brid[oa]|hybrid)\b"),
    ("remote", r"100\s*%\s*(remoto|remote|teletrabajo)|\b(fully remote|full remote)\b"),
    ("on-site", r"\b(100\s*%\s*presencial|presencial|on-?site)\b"),
]
_YEARS = r"(?:años|anos|years)"
_CLAIM = r"(?<!(?:empresa|compañía|company)[^.]{0,120})"
_AMOUNT = r"(\d{1,3}(?:\.\d{3})+|\d{4,6})\s*(?:€|eur)"


def modality(text: Column, location: Column, cities: list[str]) -> Column:
    """on-site, hybrid, remote or unspecified: firm phrases first, then a loose word, then the city."""
    remote, known = r"(?iu)\b(remoto|remote|teletrabajo)\b", location.isin(*cities)
    out = F.when(text.rlike("(?iu)" + MODES[0][1]), MODES[0][0])
    for mode, pattern in MODES[1:]:
        out = out.when(text.rlike("(?iu)" + pattern), mode)
    out = out.when(text.rlike(remote), F.when(~location.rlike(remote) & known, "hybrid").otherwise("remote"))
    return out.when(location.rlike(remote), "remote").when(known, "on-site").otherwise("unspecified")


def experience_level(low: Column, high: Column) -> Column:
    """Level by the upper bound of years, else the lower one."""
    years = F.coalesce(high, low)
    return F.when(years.isNull(), "unspecified").when(years <= 2, "Junior").when(years <= 4, "Mid").when(years <= 7, "Senior").otherwise("Lead / Principal")


def experience(text: Column) -> Column:
    """Struct of min, max and level of the years asked for; what a company says of itself is no demand."""
    flags = "(?iu)"
    both = rf"{flags}{_CLAIM}\b(\d{{1,2}})\s*(?:-|a|y|to)\s*(\d{{1,2}})\s*{_YEARS}"
    one = rf"{flags}{_CLAIM}\b(\d{{1,2}})\s*\+?\s*{_YEARS}"
    number = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("int")
    low, high = F.coalesce(number(both, 1), number(one, 1)), number(both, 2)
    return F.struct(low.alias("min"), high.alias("max"), experience_level(low, high).alias("level"))


def salary_range(text: Column) -> Column:
    """Struct of the smallest and largest euro amount a year, null without one; monthly amounts count twelvefold."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_AMOUNT), F.lit(1)), lambda a: F.regexp_replace(a, r"\.", "").cast("int"))
    times = F.when(text.rlike(r"(?iu)(€|eur)[^.]{0,20}\b(mes|mensual|month)"), 12).otherwise(1)
    return F.when(F.size(found) > 0, F.struct((F.array_min(found) * times).alias("min"), (F.array_max(found) * times).alias("max")))


def company_type(company: Column, text: Column, consultancies: list[str], phrases: list[str]) -> Column:
    """consultancy if the name or the text says so, else product."""
    # One pattern per list; an empty list matches nothing.
    said = lambda c, words: c.rlike("(?iu)" + "|".join(re.sub(r"([^\w ])", r"\\\1", w) for w in words)) if words else F.lit(False)
    return F.when(said(company, consultancies) | said(text, phrases), "consultancy").otherwise("product")


def freshness(is_fresh: Column, text: Column) -> Column:
    """repost, new or recent."""
    return F.when(text.rlike(r"(?iu)\b(reposted|republicad[oa]|publicado de nuevo)\b"), "repost").when(is_fresh, "new").otherwise("recent")


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "top").when(score >= 80, "high").otherwise("normal")
