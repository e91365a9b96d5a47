"""A rule file: catalogs, companies, places and words as JSON, read through Spark from wherever it lies."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

from sievemill.functions.modality import REMOTE_WORDS, Places
from sievemill.operators.relevance import RulePack


@dataclass(frozen=True)
class RuleFile:
    """What a rule file says: tools by name, known consultancies, places, and terms of the relevance rules."""

    tools: dict[str, list[str]] = field(default_factory=dict)
    consultancies: list[str] = field(default_factory=list)
    places: Places = Places(())
    relevance: RulePack = field(default_factory=RulePack)


def _words(body: dict, key: str) -> list[str]:
    found = body.get(key, [])
    if not isinstance(found, list) or not all(isinstance(w, str) and w.strip() for w in found):
        raise ValueError(f"{key} must be a list of words")
    return [w for w in found if not (w.startswith("[") and w.endswith("]"))]  # a placeholder to be filled in


def parse_rules(text: str) -> RuleFile:
    """The rules of a JSON text; broken JSON, unknown lists and wrong types are errors.

    Keys are TECH_TOOLS_CATALOG (pairs of a name and its aliases), KNOWN_CONSULTANCIES, PRIMARY_AREA,
    OTHER_CITIES, REMOTE_KEYWORDS, and RELEVANCE, an object of term lists that replace those of the same
    name. What is missing keeps its default; keys that begin with two underscores are comments; words in
    square brackets are placeholders and left out.
    """
    try:
        body = json.loads(text)
    except json.JSONDecodeError as exc:
        raise ValueError(f"the rule file is no JSON: {exc}") from exc
    if not isinstance(body, dict):
        raise ValueError("the rule file must hold an object")
    known = {"TECH_TOOLS_CATALOG", "KNOWN_CONSULTANCIES", "PRIMARY_AREA", "OTHER_CITIES", "REMOTE_KEYWORDS", "RELEVANCE"}
    unknown = {k for k in body if not k.startswith("__")} - known
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    tools: dict[str, list[str]] = {}
    for entry in body.get("TECH_TOOLS_CATALOG", []):
        if not (isinstance(entry, list) and len(entry) == 2 and isinstance(entry[0], str) and isinstance(entry[1], list) and all(isinstance(a, str) and a for a in entry[1])):
            raise ValueError(f"a tool must be a name and a list of aliases: {entry!r}")
        tools.setdefault(entry[0], []).extend(entry[1])
    terms = body.get("RELEVANCE", {})
    lists = {f.name for f in fields(RulePack)} - {"candidate_source"}
    if not isinstance(terms, dict) or set(terms) - lists:
        raise ValueError(f"RELEVANCE may hold {sorted(lists)}")
    places = Places(tuple(w.lower() for w in _words(body, "PRIMARY_AREA")), tuple(w.lower() for w in _words(body, "OTHER_CITIES")), tuple(_words(body, "REMOTE_KEYWORDS")) or REMOTE_WORDS)
    return RuleFile(tools, _words(body, "KNOWN_CONSULTANCIES"), places, replace(RulePack(), **{k: _words(terms, k) for k in terms}))


def read_rules(spark: SparkSession, path: str) -> RuleFile:
    """``parse_rules`` of one file; it is read by Spark, so it may lie in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must be one rule file")
    return parse_rules(rows[0].value)


def split_tools(tools: dict[str, list[str]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(names, patterns) of a catalog for ``alias_rows``: an alias with a backslash, or one that begins with ``(?``, is a pattern."""
    is_pattern = lambda a: "\\" in a or a.startswith("(?")
    plain = {n: [a for a in aliases if not is_pattern(a)] for n, aliases in tools.items()}
    return plain, {n: ps for n, aliases in tools.items() if (ps := [a for a in aliases if is_pattern(a)])}
