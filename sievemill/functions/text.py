"""Text Columns: normal forms, whole-term matching and weighted terms. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"


def squash(c: Column) -> Column:
    """Collapse white space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def lower_squash(c: Column) -> Column:
    """``squash`` in lower case."""
    return F.lower(squash(c))


def norm_text(c: Column) -> Column:
    """Lower case without accents (Latin letters), white space collapsed; null is empty."""
    return lower_squash(F.translate(c, _ACCENTED, _PLAIN))


def _escape(term: str) -> str:
    return re.sub(r"([^\w ])", r"\\\1", term)


def has_term(text: Column, term: str) -> Column:
    """``term`` as a whole term of a text in normal form; plain search comes before the pattern."""
    t = _escape(term)
    # The literal comes first, so the bounds are looked at where it stands only.
    return text.contains(term) & text.rlike(f"{t}(?<![a-z0-9]{t})(?![a-z0-9])")


def present(values: list[Column]) -> Column:
    """The strings that aren't null or empty, as an array; unlike a filter by lambda it is compiled."""
    return F.array_remove(F.split(F.concat_ws("\x1f", *values), "\x1f"), "")


def match_terms(text: Column, terms: list[str]) -> Column:
    """The terms found in a text in normal form, in the given order."""
    return present([F.when(has_term(text, t), F.lit(t)) for t in terms]) if terms else F.array().cast("array<string>")


def term_weight(text: Column, term: str, negations: list[str], weak: list[str], reach: int = 60) -> Column:
    """The best weight over all hits of ``term``: 0 behind a negation, 1 behind a weak phrase, else 4.

    A phrase counts if it lies within the ``reach`` characters in front of the hit.
    """
    # The hit is a look-ahead in front of the phrases, so what lies behind is looked at where the term stands only.
    hit = f"(?={_escape(term)}(?![a-z0-9]))(?<![a-z0-9])"
    behind = lambda p: rf"{_escape(p)}.{{0,{max(0, reach - len(p))}}}"
    no = "".join(f"(?<!{behind(p)})" for p in negations)
    plain = hit + no + "".join(f"(?<!{behind(p)})" for p in weak)
    out = F.when(text.rlike(f"(?s){plain}"), 4)
    if weak:
        out = out.when(text.rlike(f"(?s){hit}{no}(?:{'|'.join(f'(?<={behind(p)})' for p in weak)})"), 1)
    return out.otherwise(0)


def score_terms(text: Column, terms: list[str], negations: list[str], weak: list[str], found: Column | None = None) -> Column:
    """Sum of the weights of ``terms``; only those in ``found``, where it is given, are looked for."""
    out = F.lit(0)
    for t in terms:
        weight = term_weight(text, t, negations, weak)
        out = out + (weight if found is None else F.when(F.array_contains(found, t), weight).otherwise(0))
    return out


def _alternatives(pattern: str) -> list[str]:
    """The parts between the bars outside of groups."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _starts(pattern: str) -> str:
    """What a match of ``pattern`` can begin with, as the inside of a character class."""
    p = pattern.removeprefix(r"\b")
    if p[0] == "(":
        end = next(i for i in range(len(p)) if p[: i + 1].count("(") == p[: i + 1].count(")"))
        inner, rest = p[1:end].removeprefix("?:"), p[end + 1 :]
        found = "".join(map(_starts, _alternatives(inner)))
    else:
        size = p.index("]") + 1 if p[0] == "[" else 2 if p[0] == "\\" else 1
        found, rest = p[:size].strip("[]"), p[size:]
    return found + (_starts(rest[1:]) if rest[:1] in ("?", "*") else "")


def any_pattern(*patterns: str) -> str:
    """Any of ``patterns``, behind a look at the first character that spares most places the rest.

    Groups count as if the patterns were joined by bars. A bound that all begin with is met once.
    """
    bound = r"\b" if all(p.startswith(r"\b") for p in patterns) else ""
    parts = [p.removeprefix(bound) for p in patterns]
    return rf"(?=[{''.join(dict.fromkeys(map(_starts, patterns)))}]){bound}(?:{'|'.join(parts)})"


def named_features(text: Column, catalog: dict[str, list[str]]) -> Column:
    """Labels of which any pattern is found, in the catalog's order."""
    return present([F.when(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in catalog.items()])


def phrase_match(value: Column, phrase: str) -> Column:
    """``phrase`` as whole words of ``value``; case and white space don't matter."""
    return any_phrase(value, [phrase])


def any_phrase(value: Column, phrases: list[str]) -> Column:
    """Any of ``phrases`` as whole words of ``value``, in one search of it; case and white space don't matter.

    White space is met where it stands instead of being collapsed first.
    """
    wanted = [p for p in (re.sub(r"\s+", " ", phrase).strip().lower() for phrase in phrases) if p]
    if not wanted:
        return F.lit(False)
    starts, words = "".join(re.escape(p[0]) for p in wanted), "|".join(re.escape(p).replace("\\ ", r"\s+") for p in wanted)
    return F.lower(F.coalesce(value, F.lit(""))).rlike(rf"(?U)(?=[{starts}])(?<!\w)(?:{words})(?!\w)")


def partition_terms(words: Column, broad: list[str]) -> Column:
    """User terms, cleaned and distinct in order, as a struct of active and too-broad ones."""
    clean = F.array_distinct(F.filter(F.transform(words, lower_squash), lambda w: w != ""))
    wide = F.array(*[F.lit(b) for b in broad]).cast("array<string>")
    return F.struct(F.array_except(clean, wide).alias("active"), F.array_intersect(clean, wide).alias("broad"))
