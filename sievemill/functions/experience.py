"""What a text asks for in experience, with the sentence that says so, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.catalogs import TOOLS, tech_stack
from sievemill.functions.features import experience_level
from sievemill.functions.text import any_pattern

# Phrases and year patterns, in the order in which they are tried.
NO_EXPERIENCE = r"\b(sin\s+experiencia(?:\s+previa)?|no\s+se\s+requiere\s+experiencia|no\s+es\s+necesaria\s+experiencia|no\s+requerida|primer\s+empleo|reci[ée]n\s+graduad[oa]|fresh\s+graduate|entry[- ]?level)\b"
INTERNSHIP = r"\b(pr[áa]cticas|beca|becari[oa]|intern|internship|trainee)\b"
NO_INTERNSHIP = r"(buenas|mejores|best)\s+pr[áa]cticas|beca\s+(comedor|transporte|comida)"
YEARS = [
    r"\b(1[0-5]|[0-9])\s*(?:-|–|hasta|al|a|y|to)\s*(1[0-5]|[0-9])\s*(?:a[ñn]os?|years?)\b",
    r"\b(?:entre\s+)?(1[0-5]|[0-9])\s*(?:-|–|hasta|al|a|y|to)\s*(1[0-5]|[0-9])\s*(?:a[ñn]os?|years?)\s*(?:de\s+)?(?:experiencia|experience)?",
    r"\b(?:experiencia|experience)\s*(?:m[ií]nima|required|demostrable|previa)?\s*(?:de|of)?\s*(1[0-5]|[0-9])\s*(?:\+)?\s*(?:a[ñn]os?|years?)\b",
    r"(?:al\s+menos|m[íi]nimo|min\.?|a\s+partir\s+de|m[áa]s\s+de|at\s+least|minimum|over|more\s+than|\+)\s*(1[0-5]|[0-9])\s*(?:\+)?\s*(?:a[ñn]os?|years?)\b",
    r"\b(1[0-5]|[0-9])\s*\+\s*(?:a[ñn]os?|years?)\b",
    r"\b(1[0-5]|[0-9])\s*(?:a[ñn]os?|years?)\s*(?:de\s+)?(?:experiencia|experience)\b",
]
COMPANY_CLAIM = r"\b(?:empresa|compa[ñn][ií]a|consultora|organizaci[oó]n|equipo)(?:\s+\w+){0,8}\s+(?:con|de)\s*$|\b(?:llevamos|contamos\s+con|trayectoria\s+de)\b[^.]{0,70}$"
VALUED = r"\b(se\s+valorar[aá]|deseable|preferible|plus|nice[- ]to[- ]have|would\s+be\s+a\s+plus)\b"
REQUIRED = r"\b(se\s+requiere|requisito|imprescindible|obligatori[oa]|must\s+have|required|minimum|m[ií]nimo|al\s+menos|at\s+least)\b"
SENIORITY = r"\b(lead|principal|staff|tech lead|team lead|director|head of|manager|arquitecto|architect|senior|sr\.?|experto|expert|semi[- ]?senior|mid[- ]?level|mid|ssr|intermedio|junior|jr\.?|graduate|early career)\b"
SENIORITY_LEVELS = {
    "Lead / Principal": ["lead", "principal", "staff", "tech lead", "team lead", "director", "head of", "manager", "arquitecto", "architect"],
    "Senior": ["senior", "sr.", "sr", "experto", "expert"],
    "Mid": ["semi-senior", "mid-level", "mid", "ssr", "intermedio"],
}
SENIORITY_YEARS = {"Lead / Principal": "+5-8", "Senior": "3-5+", "Mid": "2-4", "Junior": "0-2"}

_FLAGS = "(?iuU)"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _place(text: Column, pattern: str, low: bool = False, high: bool = False) -> Column:
    """The first match with the text around it, null without one."""
    p = _FLAGS + any_pattern(pattern)
    number = lambda wanted, i: F.regexp_extract(text, p, i).cast("int") if wanted else F.lit(None).cast("int")
    found = lambda parts: F.struct(parts[0].alias("before"), F.regexp_extract(text, p, 0).alias("said"), parts[1].alias("after"), number(low, 1).alias("low"), number(high, 2).alias("high"))
    return F.when(text.rlike(p), _let(F.split(text, p, 2), found))


def _years(text: Column) -> Column:
    """The first year pattern whose first match is no claim of a company about itself."""
    asked = lambda place: F.when(~F.right(place["before"], F.lit(120)).rlike(_FLAGS + COMPANY_CLAIM), place)
    return F.coalesce(*[_let(_place(text, p, True, i < 2), asked) for i, p in enumerate(YEARS)])


def _internship(text: Column) -> Column:
    """The first internship word that no good practices or meal grant stand near, folded over all of them."""
    p = _FLAGS + any_pattern(INTERNSHIP)
    words, none = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(None).cast("int")

    def step(state: Column, pair: Column) -> Column:
        start, size = state["at"] + F.length(pair["gap"]), F.length(pair["word"])
        left = F.greatest(start - 25, F.lit(0))
        real = state["start"].isNull() & ~F.substring(text, left + 1, start + size + 25 - left).rlike(_FLAGS + NO_INTERNSHIP)
        return F.struct((start + size).alias("at"), F.when(real, start).otherwise(state["start"]).alias("start"), F.when(real, size).otherwise(state["size"]).alias("size"))

    pairs = F.zip_with(words, F.split(text, p, -1), lambda word, gap: F.struct(gap.alias("gap"), F.coalesce(word, F.lit("")).alias("word")))
    # The last gap has no word behind it.
    found = F.aggregate(F.slice(pairs, 1, F.size(words)), F.struct(F.lit(0).alias("at"), none.alias("start"), none.alias("size")), step)
    cut = lambda at: F.when(at["start"].isNotNull(), F.struct(F.substring(text, F.lit(1), at["start"]).alias("before"), F.substring(text, at["start"] + 1, at["size"]).alias("said"), F.substring(text, at["start"] + at["size"] + 1, F.length(text)).alias("after"), none.alias("low"), none.alias("high")))
    return F.when(text.rlike(p), _let(found, cut))


def _sentence(place: Column) -> Column:
    end = F.when(F.contains(place["after"], F.lit(".")), F.concat(F.substring_index(place["after"], ".", 1), F.lit("."))).otherwise(place["after"])
    whole = F.concat(F.substring_index(place["before"], ".", -1), place["said"], end)
    return F.substring(F.trim(F.regexp_replace(whole, r"(?U)\s+", " ")), 1, 280)


def experience_details(text: Column, tools: dict[str, list[str]] = TOOLS) -> Column:
    """Struct of minimum_years, maximum_years, level, requirement, skills, evidence, display.

    Tried in this order: phrases that ask for none, internships, years, words of seniority. Years
    that a company tells of itself are passed over. ``requirement`` (valued, required or stated)
    and ``skills`` come from the 160 characters on both sides of the years; ``evidence`` is the
    sentence, up to 280 characters. Null and empty texts tell nothing.
    """
    text = F.coalesce(text, F.lit(""))

    def told(low: Column, high: Column, level: Column, requirement: Column, skills: Column, evidence: Column, display: Column) -> Column:
        return F.struct(low.cast("int").alias("minimum_years"), high.cast("int").alias("maximum_years"), level.alias("level"), requirement.alias("requirement"), skills.alias("skills"), evidence.alias("evidence"), display.alias("display"))

    nothing, no_skills = F.lit(None), F.array().cast("array<string>")

    def by_years(place: Column) -> Column:
        low, high, level = place["low"], place["high"], experience_level(place["low"], place["high"])
        context = F.concat(F.right(place["before"], F.lit(160)), place["said"], F.left(place["after"], F.lit(160)))
        requirement = F.when(context.rlike(_FLAGS + VALUED), "valued").when(context.rlike(_FLAGS + REQUIRED), "required").otherwise("stated")
        display = F.when(high.isNotNull(), F.format_string("%d-%d years (%s)", low, high, level)).when(low <= 1, F.format_string("At least %d year (%s)", low, level)).when(low <= 2, F.format_string("%d years (Junior / Mid)", low))
        display = display.when(low <= 4, F.format_string("%d-%d years (%s)", low, low + 2, level)).otherwise(F.format_string("+%d years (%s)", low, level))
        return F.when(place.isNotNull(), told(low, high, level, requirement, tech_stack(context, tools), _sentence(place), display))

    def by_word(place: Column) -> Column:
        word = F.lower(place["said"])
        level = F.coalesce(*[F.when(word.isin(words), name) for name, words in SENIORITY_LEVELS.items()], F.lit("Junior"))
        years = F.coalesce(*[F.when(level == name, span) for name, span in SENIORITY_YEARS.items()])
        return F.when(place.isNotNull(), told(nothing, nothing, level, F.lit("stated"), no_skills, _sentence(place), F.concat(years, F.lit(" years ("), level, F.lit(")"))))

    def none_asked(high: int, display: str) -> Callable[[Column], Column]:
        return lambda place: F.when(place.isNotNull(), told(F.lit(0), F.lit(high), F.lit("Entry"), F.lit("not required"), no_skills, _sentence(place), F.lit(display)))

    return F.coalesce(
        _let(_place(text, NO_EXPERIENCE), none_asked(1, "No experience needed (0-1 years / Entry)")),
        _let(_internship(text), none_asked(0, "Internship (0 years)")),
        _let(_years(text), by_years),
        _let(_place(text, SENIORITY), by_word),
        told(nothing, nothing, F.lit("unspecified"), F.lit("unspecified"), no_skills, F.lit(""), F.lit("?")),
    )
