"""Demands of experience: the order of the rules, claims of companies, contexts and evidence."""

import re

from pyspark.sql import functions as F

from sievemill.functions import experience
from sievemill.functions.experience import experience_details
from sievemill.plans import facts

CASES = {
    "Puesto nuevo. Sin experiencia previa, formamos. Fin.": (0, 1, "Entry", "not required", "Sin experiencia previa, formamos."),
    "Buscamos a quien siga buenas prácticas. Con 3 años de experiencia en Python": (3, None, "Mid", "stated", "Con 3 años de experiencia en Python"),
    "Con beca comedor incluida en la oficina central. Además hay una  beca\nde estudios.": (0, 0, "Entry", "not required", "Además hay una beca de estudios."),
    "Somos una empresa de software con 12 años de experiencia. Lead Developer": (None, None, "Lead / Principal", "stated", "Lead Developer"),
    "Imprescindible de 2 a 5 años. Gracias": (2, 5, "Senior", "required", "Imprescindible de 2 a 5 años."),
    "Se valorará: más de 8 years": (8, None, "Lead / Principal", "valued", "Se valorará: más de 8 years"),
    "Jr. wanted": (None, None, "Junior", "stated", "Jr."),
    "Sr developer": (None, None, "Senior", "stated", "Sr developer"),
    "nothing here": (None, None, "unspecified", "unspecified", ""),
    "": (None, None, "unspecified", "unspecified", ""),
    None: (None, None, "unspecified", "unspecified", ""),
}


def test_rules_in_order(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", experience_details(F.col("t")).alias("e")).collect()
    assert {r.t: (r.e.minimum_years, r.e.maximum_years, r.e.level, r.e.requirement, r.e.evidence) for r in rows} == CASES
    said = {r.t: (r.e.skills, r.e.display) for r in rows}
    assert said["Buscamos a quien siga buenas prácticas. Con 3 años de experiencia en Python"] == (["Python"], "3-5 years (Mid)")
    assert said["Imprescindible de 2 a 5 años. Gracias"] == ([], "2-5 years (Senior)")


def test_long_texts(spark):
    text = "word and more, " * 20_000
    e = spark.range(1).select(experience_details(F.concat(F.lit(text), F.lit("at least 4 years of it"))).alias("e")).first().e
    assert (e.minimum_years, e.requirement, len(e.evidence)) == (4, "required", 280)


def told_by(text):
    """Brute force of the years: (minimum, maximum) of the first rule that holds, or None for words and nothing."""
    low = text.lower()
    if re.search(experience.NO_EXPERIENCE, low):
        return 0, 1
    for m in re.finditer(experience.INTERNSHIP, low):
        if not re.search(experience.NO_INTERNSHIP, low[max(0, m.start() - 25) : m.end() + 25]):
            return 0, 0
    for pattern in experience.YEARS:
        m = re.search(pattern, low)
        if m and not re.search(experience.COMPANY_CLAIM, low[max(0, m.start() - 120) : m.start()]):
            return int(m.group(1)), int(m.group(2)) if m.re.groups > 1 else None
    return None, None


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in facts.asking(spark, sf).collect()}
    got = facts.q_experience(spark, sf).collect()
    assert {r.doc_id: (r.minimum_years, r.maximum_years) for r in got} == {i: told_by(t) for i, t in texts.items()}
    assert len({r.level for r in got}) >= 5 and len({r.requirement for r in got}) >= 4
