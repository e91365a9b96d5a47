"""The ladder of work modes against a plain reading of it, over all documents and planted sentences."""

import re

import pytest
from pyspark.sql import functions as F

from sievemill.functions import modality as m

PLACES = m.Places(("valencia", "sagunto"), ("madrid", "vigo"))
SAID = [
    ("no se admite teletrabajo", "", m.ON_SITE), ("Teletrabajo no disponible", "Madrid", m.ON_SITE), ("teletrabajo parcial", "", m.HYBRID), ("sin posibilidad de remoto", "Remoto", m.ON_SITE), ("modelo 3/2", "", m.HYBRID), ("100% remoto", "Madrid", m.REMOTE),
    ("3 días oficina y 2 días casa", "", m.HYBRID), ("hasta 2 días de teletrabajo", "", m.HYBRID), ("2 días de casa, 23 días de vacaciones", "", m.UNSAID), ("22 días de vacaciones y luego nada de nada aquí 3 días en oficina", "", m.HYBRID),
    ("2 días a la semana", "", m.HYBRID), ("teletrabajo al 40%x", "", m.HYBRID), ("HÍBRIDO", "", m.HYBRID), ("híbridamente", "", m.UNSAID), ("trabajo presencial", "Vigo", m.ON_SITE), ("remoto", "Valencia", m.HYBRID), ("remoto", "Lugo", m.REMOTE),
    ("remoto", "Remoto, Valencia", m.REMOTE), ("nada", "Sagunto", m.BY_PLACE), ("nada", "Lugo", m.UNSAID), ("work from home", "", m.REMOTE), (None, None, m.UNSAID), ("", "Madrid", m.BY_PLACE), ("remotos", "", m.UNSAID), ("not remote", "Remote", m.ON_SITE), ("fully onsite", "", m.ON_SITE),
    ("1/4", "", m.HYBRID), ("2024/2025", "", m.UNSAID), ("x" * 100_000 + " 2 days wfh", "", m.HYBRID), ("😀😀 2 días casa y vacaciones", "", m.HYBRID),
]


def by_hand(text, location):
    text, location = text or "", location or ""
    full, where = f"{text} {location}".lower(), location.lower()
    has = lambda *ps: any(re.search(p, full, re.I) for p in ps)
    whole = lambda words: has(*(rf"\b{re.escape(w)}\b" for w in words))
    days = re.search(m.DAYS, full, re.I)
    if has(*m.NO_REMOTE):
        return m.ON_SITE
    if has(m.SPLIT) or (days and not re.search(m.HOLIDAYS, full[max(0, days.start() - 10) : days.end() + 25])) or has(*m.SHARES, *m.HYBRIDS):
        return m.HYBRID
    city = any(c in where for c in (*PLACES.home, *PLACES.others))
    if has(*m.REMOTES):
        return m.REMOTE
    if whole(m.ON_SITES):
        return m.ON_SITE
    if whole(PLACES.remote_words):
        return m.HYBRID if city and not any(w in where for w in ("remoto", "remote", "teletrabajo")) else m.REMOTE
    return m.BY_PLACE if city else m.UNSAID


def test_planted_sentences_and_all_documents(spark):
    docs = [(r.text, loc) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()) for loc in [["Valencia", "Lugo", None, "Remoto"][i % 4]]]
    said = [(t, loc) for t, loc, _ in SAID]
    mixed = [(f"{d[:2000]} {t} {d[2000:]}", loc) for (d, _), (t, loc) in zip(docs * 2, said * 3, strict=False) if d and t]
    rows = [(i, t, loc) for i, (t, loc) in enumerate(said + docs + mixed)]
    df = spark.createDataFrame(rows, "n int, text string, location string").repartition(8)
    got = {r.n: r.mode for r in df.select("n", m.modality(F.col("text"), F.col("location"), PLACES).alias("mode")).collect()}
    assert [got[i] for i in range(len(SAID))] == [want for _, _, want in SAID]
    assert got == {i: by_hand(t, loc) for i, t, loc in rows}


@pytest.mark.parametrize(
    ("title", "description", "location", "scope", "told", "want"),
    [
        ("Dev", "trabajo presencial", "Valencia", False, None, True), ("Dev Valencia", "", "Lugo", False, None, True), ("Dev", "valenciano", "Lugo", False, None, False), ("Dev", "full remote", "Madrid", False, None, True),
        ("Dev", "", "Lugo", True, None, False), ("Dev", "", "España", True, None, True), ("Dev", "", "España", False, None, False), ("Dev", "oficina en Madrid", "España", True, None, False), ("Dev", "", "Madrid", True, None, False),
        ("Dev", "híbrido", "España", True, None, False), ("Dev", "híbrido", "España", True, "100% Remoto", True), ("Dev", "", "Lugo", True, "100% Remoto", True), ("Dev", "", None, True, None, False), (None, None, "EMEA", True, None, True),
    ],
)
def test_viable(spark, title, description, location, scope, told, want):
    df = spark.createDataFrame([(title, description, location, scope, told)], "title string, description string, location string, scope boolean, told string")
    c = F.col
    mode = m.modality(F.concat_ws(" ", "title", "description", "location"), c("location"), PLACES)
    can = m.viable(c("title"), c("description"), c("location"), mode, PLACES)
    assert df.select(m.viable_in_scope(can, c("scope"), c("description"), c("location"), mode, c("told"), PLACES).alias("v")).first().v is want
