"""Signals of responses and listings as Columns: fetch states, language, places, pay by market."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of pages that ask whether a visitor is a person, for lists and for searches.
CHALLENGES = ["captcha", "cf-chl-", "cloudflare", "access denied", "just a moment", "unusual traffic", "robot check"]
SEARCH_CHALLENGES = ["captcha", "security check", "unusual activity"]
# Words that tell English and Spanish listings apart.
ENGLISH = ["we are looking", "requirements", "responsibilities", "skills", "experience with", "role", "bachelor", "master", "team"]
SPANISH = ["requisitos", "experiencia", "buscamos", "funciones", "ofrecemos", "grado", "ingeniero", "jornada"]
# Default words and yearly pay in thousands of euros, in the order in which they are tried.
PAY = [
    (["llm", "rag", "generativ", "agent", "gpt", "langchain", "mlops", "ia generativa"], 30, 36),
    (["computer vision", "vision artificial", "opencv", "yolo", "deep learning", "cnn", "reinforcement learning"], 29, 35),
    (["data engineer", "ingeniero de datos", "spark", "snowflake", "databricks", "kafka"], 28, 35),
    (["plc", "scada", "automatizacion", "automatización", "robotica", "robótica", "industrial", "mantenimiento predictivo", "predictivo", "tia portal"], 28, 34),
    (["python", "fastapi", "django", "flask", "backend"], 28, 34),
    (["bi", "business intelligence", "power bi", "powerbi", "tableau", "data analyst"], 25, 30),
]
FALLBACK, INTERN = (27, 33), (12, 18)
INTERN_WORDS = ["práctica", "practica", "beca", "intern"]


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def challenge_flag(body: Column, status: Column, words: list[str] = CHALLENGES, reach: int = 100_000) -> Column:
    """Whether a response blocks: status 403 or 429, or a challenge word in its first characters. Nulls don't."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, reach))
    return F.coalesce(status.isin(403, 429), F.lit(False)) | _any_of(head, words)


def fetch_state(status: Column, body: Column, earlier: Column, cards: Column, parsed: Column, incomplete: Column) -> Column:
    """ok, empty, partial, blocked, rate_limited or failed.

    A response that fails after ``earlier`` ones gave cards is partial. No status is a failure.
    """
    failed = F.when(status == 429, "rate_limited").when(status.isin(401, 403), "blocked").when(status.isNull() | (status != 200), "failed")
    failed = failed.when(_any_of(F.lower(F.coalesce(body, F.lit(""))), SEARCH_CHALLENGES), "blocked")
    fine = F.when(earlier + cards == 0, "empty").when((incomplete > 0) | (parsed == 0), "partial").otherwise("ok")
    return F.when(failed.isNotNull(), F.when(earlier > 0, "partial").otherwise(failed)).otherwise(fine)


def language_cues(text: Column) -> Column:
    """en if the text has over one English cue more than Spanish ones, else es."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return F.when(count(ENGLISH) > count(SPANISH) + 1, "en").otherwise("es")


def append_hints(text: Column, mode: Column, pay: Column) -> Column:
    """The text with structured work mode and pay as lines behind it, so that text facts find them."""
    low = F.lower(mode)
    line = F.when(low.rlike("teletrabajo|remoto"), "Modalidad: 100% Remoto").when(low.rlike("híbrido|hibrido"), "Modalidad: Híbrido").when(low.contains("presencial"), "Modalidad: Presencial")
    return F.concat_ws("\n", F.coalesce(text, F.lit("")), line, F.when(pay != "", F.concat(F.lit("Salario oficial: "), pay)))


def location_from_title(title: Column, cities: list[str], default: str) -> Column:
    """Remote by the title's words, else the first of ``cities`` that it has, else ``default``."""
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.when(low.rlike(r"(?U)(?:remoto|remote)\b|\bfull\s*remote\b|\bteletrabajo\s*100\s*%"), "100% Remoto")
    for city in cities:
        out = out.when(low.contains(city.lower()), city)
    return out.otherwise(default)


def location_from_path(url: Column, default: str) -> Column:
    """The first segment of the URL's path with spaces for hyphens and capitals at words; ``default`` without one."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://[^/?#]*/+([^/?#]+)", 1)
    return F.when(part == "", default).otherwise(F.initcap(F.regexp_replace(part, "-", " ")))


def location_from_parts(default: str, *parts: Column) -> Column:
    """The parts that aren't blank, joined by commas; ``default`` if all are."""
    joined = F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.when(joined == "", default).otherwise(joined)


def estimate_salary(text: Column, level: Column, location: Column, is_product: Column, n_terms: Column) -> Column:
    """Struct of min and max thousands a year by the first matching word group.

    Internships have their own range. A product company adds 1 and 2, remote work 1 and 1, and
    four technologies or more 1 to the upper end. Nulls count as empty.
    """
    pair = lambda a, b: F.struct(F.lit(a).alias("min"), F.lit(b).alias("max"))
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    product = F.coalesce(is_product, F.lit(False)).cast("int")
    dense = F.coalesce(n_terms >= 4, F.lit(False)).cast("int")
    place = F.lower(F.coalesce(location, F.lit("")))

    def of(low: Column) -> Column:
        base = F
        for words, least, most in PAY:
            base = base.when(_any_of(low, words), pair(least, most))
        remote = (place.contains("remoto") | low.contains("100% remoto")).cast("int")
        return once(F.struct(base.otherwise(pair(*FALLBACK)).alias("base"), remote.alias("remote")), lambda x: F.struct((x["base"]["min"] + product + x["remote"]).alias("min"), (x["base"]["max"] + 2 * product + x["remote"] + dense).alias("max")))

    # The text is put into lower case once, and its word group is looked for once.
    return F.when(_any_of(F.lower(F.coalesce(level, F.lit(""))), INTERN_WORDS), pair(*INTERN)).otherwise(once(F.lower(F.coalesce(text, F.lit(""))), of))


def json_list(c: Column) -> Column:
    """A stored JSON list of strings; null, empty or broken ones are empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
