"""Features, drops and scores of listings as a whole; names of a catalog against one pattern per name and text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievemill.functions.catalogs import TOOLS, alias_pattern
from sievemill.functions.modality import Places
from sievemill.operators import names, records

PLACES = Places(("valencia",), ("madrid",))
SCHEMA = "title string, company string, location string, description string, source string, url string, is_fresh boolean, seq int"


def listing(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def test_features_read_title_description_and_place(spark):
    df = listing(spark, [("Dev", "x", "Remoto", "Se requieren 3 años de experiencia en Python. 2 días de teletrabajo. 30.000 € - 40.000 €", "s", "u", None), ("Prácticas", "x", "Valencia", None, "s", "u", None), (None, None, None, None, None, None, None)])
    got = [r.features for r in records.record_features(df, PLACES).orderBy("seq").collect()]
    assert [g.modality for g in got] == ["Híbrido", "Presencial / Híbrido", "Flexible / No especificada"]
    assert got[0].experience.minimum_years == 3 and "Python" in got[0].experience.skills and (got[0].salary.min, got[0].salary.max) == (30000, 40000)
    assert got[1].contract_types == ["Practicas / Beca"] and got[2].experience.level == "unspecified" and got[2].stack == []
    assert records.record_features(df.withColumn("features", F.lit(1)), PLACES).columns == [*df.columns, "features"]


def test_reasons_use_place_mode_and_features(spark):
    df = listing(spark, [("Dev data", "x", "Madrid", "presencial", "b", "u", None), ("Dev data", "x", "Valencia", "6 años de experiencia en data", "b", "u", None), ("Dev", "x", "Valencia", "", "b", "u", None), ("Dev data", "x", "Madrid", "full remote", "b", "u", None), ("Senior", "x", "Lugo", "", "b", "u", None), ("Dev data", "bad co", "Valencia", "", "b", "u", None)])
    got = [r.reason for r in records.drop_reason(records.record_features(df, PLACES), PLACES, ["data"], ["bad co"]).orderBy("seq").collect()]
    assert got == ["location", "exclude", "include", None, "exclude", "exclude"]


def test_match_keeps_the_decision_and_adds_facts(spark):
    df = listing(spark, [
        ("Machine Learning Engineer", "Consultora A", "Valencia", "Python and Docker with pytorch. Al menos 3 años de experiencia en Python. " + "y" * 60, "s", "u", True),
        ("Data Analyst", "Acme", "Lugo", "Para importante cliente. Republicada. SQL y Power BI, 20.000 € - 30.000 €", "s", "u", False), ("Camarero", None, None, None, None, None, None),
    ])
    rows = records.match_record(df, PLACES, ["consultora a"]).orderBy("seq").collect()
    first, second, third = (r.match for r in rows)
    assert first.score > 80 and first.kind == "consultancy" and not first.pay.told and first.freshness == "new" and 1 <= len(first.tags) <= 4 and all(t == t.upper() for t in first.tags)
    assert second.tags[0] == "A revisar" and second.kind == "consultancy" and second.pay.told and (second.pay.min, second.pay.max) == (20000, 30000) and second.freshness == "repost"
    assert third.score == 0 and third.tags == [] and third.kind == "product" and rows[0].asDict().keys() == {*df.columns, "match"}


def test_names_equal_one_pattern_per_text(spark):
    rng = random.Random(9)
    catalog = TOOLS | {"two words": ["machine learning", "ML"], "marks": ["c++", "c#", ".net", "node.js", "ci/cd"], "accents": ["diseño ágil"], "upper": ["PyTorch"]}
    patterns = {"years": [r"\d+\s+años"], "marks": [r"\bobjective-c\b"]}
    words = [a for aliases in catalog.values() for a in aliases] + ["3 años", "objective-c", "@python", "python.com", "xpython", "c++x", "mail@node.js", "Node.JS!", "DISEÑO  ágil", "Diseño Ágil", "µ", "\n", ",", "c", "net"]
    texts = [rng.choice([" ", ",", "/", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", "python" * 20_000, "x " * 100_000 + "python"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, "machine learning", "n"), (None, "python", "n")], "doc_id long, text string, names string")
    aliases = names.alias_rows(spark, catalog, patterns)
    got = {r.doc_id: r.names for r in names.names_told(df, aliases).collect()}
    order = list(dict.fromkeys([*catalog, *patterns]))

    def told(text):
        ps = {n: [alias_pattern(a) for a in catalog.get(n, [])] + patterns.get(n, []) for n in order}
        return {n for n in order if any(re.search(p, text or "", re.I) for p in ps[n])}

    want = {i: told(t) for i, t in enumerate(texts)} | {None: told("python")}
    want[0] |= told("machine learning")
    assert got == {i: [n for n in order if n in w] for i, w in want.items()}
    assert names.names_told(df.limit(0), aliases).count() == 0 and {tuple(r.names) for r in names.names_told(df, aliases.limit(0)).collect()} == {()}
    with pytest.raises(ValueError, match="broadcast"):
        names.names_told(df, aliases, most=3)
    with pytest.raises(ValueError, match="bad pattern"):
        names.alias_rows(spark, {}, {"x": ["("]})
