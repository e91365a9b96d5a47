"""Names of a large catalog told by texts, through an index of words instead of one pattern per name and text.

A name that is one plain word is told by the words of a text alone: they meet the catalog, a broadcast of a
checked size, and no pattern is tried. Other aliases are looked for by their longest word. The words of
a text that some such alias has are found by one hash intersection within the row, and only their
aliases' patterns are tried on the text. The work follows the hits, not the catalog; no text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions.catalogs import alias_pattern

# The letters named first are those found fastest; the class is that of \w.
_WORD = r"(?U)[a-z0-9_\w]+"


def alias_rows(df_or_spark, catalog: dict[str, list[str]], patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """A catalog as a table (place, name, alias, pattern); ``patterns`` are regular expressions of further names or of the same ones.

    Names keep the order of ``catalog``, then of ``patterns``.
    """
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    names = list(dict.fromkeys([*catalog, *(patterns or {})]))
    rows = [(names.index(n), n, a, alias_pattern(a)) for n, aliases in catalog.items() for a in aliases]
    rows += [(names.index(n), n, None, p) for n, ps in (patterns or {}).items() for p in ps]
    for _, name, _, pattern in rows:
        try:
            re.compile(pattern)
        except re.error as exc:
            raise ValueError(f"bad pattern of {name!r}: {pattern!r}: {exc}") from exc
    return spark.createDataFrame(rows, "place int, name string, alias string, pattern string")


def names_told(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 100_000) -> DataFrame:
    """(id, names): the catalog's names that each text tells, in the catalog's order; none is an empty list.

    ``aliases`` (place, name, alias, pattern) as from ``alias_rows``; a null pattern is made of the alias as
    whole words. An alias without any word, and every row without an alias, is tried on all texts, so
    keep those few: at most 1,000. Over ``most`` rows are an error, as the table is broadcast. Rows of
    the same id are one document, told by any of them; null texts tell nothing; a null id is an id
    like others; an empty table gives none.
    """
    known = aliases.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"a catalog of at most {most} aliases can be broadcast")
    plain, indexed, free = [], [], []
    for row in known:
        if row.pattern is None and row.alias and all(c.isalpha() or c.isdecimal() or c == "_" for c in row.alias):
            plain.append((row.alias.lower(), row.place, row.name))
            continue
        words = re.findall(r"\w+", (row.alias or "").lower())
        pattern = row.pattern if row.pattern is not None else alias_pattern(row.alias)
        (indexed if words else free).append((max(words, key=len, default=None), row.place, row.name, f"(?iuU){pattern}"))
    if len(free) > 1000:
        raise ValueError("at most 1,000 patterns without a word to look for")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("__text"), F.lit(_WORD), F.lit(0)))
    found = rows.select("__id", F.lit(None).cast("struct<place: int, name: string>").alias("told"))
    if plain:
        names_of = spark.createDataFrame(plain, "word string, place int, name string")
        found = found.unionByName(rows.select("__id", F.explode(words).alias("word")).join(F.broadcast(names_of), "word").select("__id", F.struct("place", "name").alias("told")))
    if indexed:
        index = spark.createDataFrame(indexed, "word string, place int, name string, pattern string")
        hits = F.array_intersect(words, F.lit(sorted({word for word, *_ in indexed})))
        met = rows.select("__id", "__text", F.explode(hits).alias("word")).join(F.broadcast(index), "word")
        found = found.unionByName(met.where(F.regexp_like("__text", F.col("pattern"))).select("__id", F.struct("place", "name").alias("told")))
    if free:
        tries = F.array(*[F.when(F.col("__text").rlike(p), F.struct(F.lit(place).alias("place"), F.lit(name).alias("name"))) for _, place, name, p in free])
        found = found.unionByName(rows.select("__id", F.explode_outer(F.array_compact(tries)).alias("told")))
    names = F.transform(F.array_sort(F.collect_set("told")), lambda t: t["name"])
    return found.groupBy("__id").agg(names.alias("names")).withColumnRenamed("__id", id_col)
