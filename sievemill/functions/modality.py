"""Work mode told by a listing, as a Column: a ladder of firm phrases, then loose words, then the place.

Every rung is one alternation over the text, so a text is searched once per rung and not once per
phrase, and a look at the first character spares most places the phrases. Nothing is split or
collected; all runs in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.text import any_pattern

# The phrases of each rung and the labels, as the results must have them.
ON_SITE, HYBRID, REMOTE, BY_PLACE, UNSAID = "Presencial", "Híbrido", "100% Remoto", "Presencial / Híbrido", "Flexible / No especificada"
NO_REMOTE = (
    r"\b(?:no|sin)\s+(?:opci[óo]n\s+a\s+|posibilidad\s+de\s+)?(?:teletrabajo|remoto|trabajo\s+en\s+remoto)\b", r"\b(?:teletrabajo|remoto)\s+(?:no\s+disponible|no\s+posible|no\s+admitido)\b",
    r"\bno\s+se\s+admite\s+(?:teletrabajo|remoto|trabajo\s+en\s+remoto)\b", r"\bno\s+remoto\b", r"\bno\s+teletrabajo\b", r"\b100%\s*presencial\b", r"\bcompletamente\s+presencial\b", r"\btotalmente\s+presencial\b",
    r"\bmodalidad\s+100%\s*presencial\b", r"\b(?:no|not)\s+(?:remote|telecommute|wfh)\b", r"\b100%\s*(?:on-site|onsite|in-office)\b", r"\bon-site\s+only\b", r"\bfully\s+(?:on-site|onsite|in-office)\b",
)
_DAY_AND_PLACE = r"\b[1-4]\s*(?:d[íi]as?|days?)\s*(?:de\s*|en\s*|in\s*|to\s*)?(?:oficina|presencial(?:idad)?|sede|planta|casa|teletrabajo|remoto|office|wfh|onsite)"
SPLIT = rf"(?:{_DAY_AND_PLACE})\s*(?:y|,|\/|\+|and)\s*(?:{_DAY_AND_PLACE})"
DAYS = r"\b(?:hasta\s+|m[áa]ximo\s+|m[íi]nimo\s+)?[1-4]\s*(?:d[íi]as?|days?)\s*(?:de\s*|en\s*|a\s*la\s*semana\s*(?:de\s*)?)?(?:oficina|presencial(?:idad)?|presenciales|sede|planta|teletrabajo|remoto|casa|wfh|onsite|office)"
HOLIDAYS = r"\bd[íi]as?\s+(?:de\s+)?vacaciones\b"
SHARES = (r"\b(?:modelo|formato|esquema)?\s*[1-4]\s*[\/]\s*[1-4]\b", r"\b[1-4]\s*d[íi]as?\s*(?:\/|por|a\s*la)\s*semana\b")
HYBRIDS = (
    r"\bh[íi]brid[oas]{1,2}\b", r"\bhybrid\b", r"\btrabajo\s+h[íi]brido\b", r"\bdays?\s+in\s+office\b", r"\bdays?\s+on-site\b", r"\bdays?\s+a\s+week\s+in\b", r"\b(?:two|three|four)\s+days\b", r"\bmodalidad\s+h[íi]brida\b",
    r"\bjornada\s+h[íi]brida\b", r"\bformato\s+h[íi]brido\b", r"\bteletrabajo\s+parcial\b", r"\bteletrabajo\s+ocasional\b", r"\bremoto\s+ocasional\b", r"\bremoto\s+flexible\b", r"\bteletrabajo\s+flexible\b",
    r"\bflexibilidad\s+de\s+teletrabajo\b", r"\bopci[óo]n\s+a\s+teletrabajo\b", r"\bposibilidad\s+de\s+teletrabajo\b", r"\bd[íi]as\s+presenciales\b", r"\bd[íi]as\s+en\s+oficina\b", r"\basistencia\s+a\s+oficina\b",
    r"\basistencia\s+puntual\b", r"\breuniones\s+presenciales\b", r"\beventos\s+presenciales\b", r"\bvisitas\s+a\s+clientes\b", r"\bd[íi]as\s+de\s+teletrabajo\b", r"\bflexible\s*\/\s*h[íi]brido\b",
    r"\bteletrabajo\s*\/\s*presencial\b", r"\bremoto\s*\/\s*h[íi]brido\b", r"\bremoto\s*\/\s*presencial\b", r"\bluego\s+h[íi]brido\b", r"\btras\s+onboarding\s+h[íi]brido\b",
    r"\b(?:teletrabajo|remoto)\s*(?:al\s*)?[1-9][0-9]?%\b", r"\b[1-9][0-9]?%\s*(?:de\s*)?(?:teletrabajo|remoto)\b",
)
REMOTES = (
    r"\b100%\s*remoto\b", r"\b100%\s*remote\b", r"\bfull\s*remote\b", r"\bteletrabajo\s*100%\b", r"\b100%\s*teletrabajo\b", r"\bremoto\s*100%\b", r"\btotalmente\s+remoto\b", r"\bremote-first\b", r"\bfull-remote\b",
    r"\bremote\s+in\s+spain\b", r"\bremoto\s*\(\s*espa[ñn]a\s*\)", r"\bremoto\s+espa[ñn]a\b", r"\bsolo\s+teletrabajo\b", r"\bwork\s+from\s+anywhere\b", r"\b100%\s+a\s+distancia\b", r"\bsin\s+presencialidad\b",
)
ON_SITES = ("presencial en planta", "presencial en fábrica", "presencial en fabrica", "trabajo presencial", "modalidad presencial", "trabajo en fábrica", "trabajo en planta", "asistencia física a planta", "asistencia diaria a oficina")
REMOTE_WORDS = ("remoto", "remote", "teletrabajo", "100% remoto", "work from home")
COUNTRIES = ("españa", "spain", "remote", "remoto", "teletrabajo", "emea", "europe", "europa", "iberia")


@dataclass(frozen=True)
class Places:
    """Where one may work on site (``home``), which other cities there are, and words for remote work."""

    home: tuple[str, ...]
    others: tuple[str, ...] = ()
    remote_words: tuple[str, ...] = REMOTE_WORDS


def _literal(words: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([^\w ])", r"\\\1", w) for w in words) or r"(?!)"


def _any(*patterns: str) -> str:
    """Any of ``patterns``, for texts of ``_lower``."""
    return "(?U)" + any_pattern(*patterns)


def _lower(text: Column) -> Column:
    """In lower case, also the two letters that only match i and s when case is ignored; patterns then needn't ignore it."""
    return F.replace(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(_literal(words))


def _first_days(text: Column) -> Column:
    """Whether the first number of days at a place is one of work: no holidays within 10 characters before or 25 behind it."""
    days = any_pattern(DAYS)
    part = lambda p, i: F.regexp_extract(text, rf"(?Us)^.*?{p}", i)
    around, hit, behind = part(rf"(?:{days})(.{{0,25}})", 0), part(f"({days})", 1), part(rf"(?:{days})(.{{0,25}})", 1)
    start = F.length(around) - F.length(hit) - F.length(behind)
    window = F.substring(around, F.greatest(start - 9, F.lit(1)), F.length(around))
    return text.rlike(_any(DAYS)) & ~window.rlike(f"(?U){HOLIDAYS}")


def modality(text: Column, location: Column, places: Places) -> Column:
    """Presencial, Híbrido, 100% Remoto, Presencial / Híbrido or Flexible / No especificada; nulls are empty.

    First what rules remote work out, then divided weeks and other signs of a hybrid mode, then firm
    signs of remote and of on-site work, then a word for remote work (hybrid if the place is a city),
    then the place.
    """
    where = F.lower(F.coalesce(location, F.lit("")))
    full = _lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(location, F.lit(""))))
    word = full.rlike(rf"(?U)\b(?:{_literal(tuple(w.lower() for w in places.remote_words))})\b")
    away = where.contains("remoto") | where.contains("remote") | where.contains("teletrabajo")
    return (
        F.when(full.rlike(_any(*NO_REMOTE)), ON_SITE)
        .when(full.rlike(_any(SPLIT)), HYBRID)
        .when(_first_days(full), HYBRID)
        .when(full.rlike(_any(*SHARES, *HYBRIDS)), HYBRID)
        .when(full.rlike(_any(*REMOTES)), REMOTE)
        .when(full.rlike(_any(rf"\b(?:{_literal(ON_SITES)})\b")), ON_SITE)
        .when(word, F.when(~away & _holds(where, (*places.home, *places.others)), HYBRID).otherwise(REMOTE))
        .when(_holds(where, (*places.home, *places.others)), BY_PLACE)
        .otherwise(UNSAID)
    )


def at_home(location: Column, title: Column, places: Places) -> Column:
    """Whether place or title name one of the home places as a whole word."""
    full = F.lower(F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(title, F.lit(""))))
    return full.rlike(rf"(?U)\b(?:{_literal(places.home)})\b")


def viable(title: Column, description: Column, location: Column, mode: Column, places: Places) -> Column:
    """Whether a listing can be taken up: any mode at a home place, elsewhere remote work only.

    ``mode`` is ``modality`` of title, description and location.
    """
    return at_home(location, title, places) | (mode == REMOTE)


def viable_in_scope(can: Column, scope: Column, description: Column, location: Column, mode: Column, told_mode: Column | None, places: Places) -> Column:
    """``can``, or a listing from a search limited to remote work (``scope``) that nothing speaks against.

    Against it speak another city in the place or, as a whole word, in the description; a mode that
    says on-site or hybrid; and a place that is no country or region while the mode isn't remote.
    ``told_mode``, where not null, counts instead of ``mode``.
    """
    mode = mode if told_mode is None else F.coalesce(told_mode, mode)
    where = F.lower(F.coalesce(location, F.lit("")))
    other = _holds(where, places.others) | F.lower(F.coalesce(description, F.lit(""))).rlike(rf"(?U)\b(?:{_literal(places.others)})\b")
    generic = where.isin(*COUNTRIES) | mode.contains("Remoto")
    return can | (scope & ~other & ~mode.contains("Presencial") & ~mode.contains("Híbrido") & generic)
