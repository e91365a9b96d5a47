"""Registered queries of response states, places and pay by market, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import signals
from sievemill.plans.queries import VIEW, listings, table


def _sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def q_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, html = F.col("page_id"), F.col("html")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 200, 200, 429, 403, 500, 200)]), (p % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id", signals.challenge_flag(html, status).alias("challenge"), signals.fetch_state(status, html, p % 2, p % 3, p % 3, F.when(p % 5 == 0, 1).otherwise(0)).alias("state"),
        signals.language_cues(html).alias("language"), signals.location_from_path(F.col("url"), "nowhere").alias("place"),
    )


def _count(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words)


O_STATES = f"""WITH p AS (SELECT page_id, url, lower(coalesce(html, '')) low, [200, 200, 200, 429, 403, 500, 200][page_id % 7 + 1] s, nullif(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*/+([^/?#]+)', 1), '') part FROM pages),
 f AS (SELECT *, CASE WHEN s = 429 THEN 'rate_limited' WHEN s = 403 THEN 'blocked' WHEN s <> 200 THEN 'failed' WHEN {_sql_any("low", signals.SEARCH_CHALLENGES)} THEN 'blocked' END failed FROM p)
 SELECT page_id, s IN (403, 429) OR {_sql_any("substr(low, 1, 100000)", signals.CHALLENGES)} challenge,
 CASE WHEN failed IS NOT NULL THEN CASE WHEN page_id % 2 > 0 THEN 'partial' ELSE failed END WHEN page_id % 2 + page_id % 3 = 0 THEN 'empty' WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 'partial' ELSE 'ok' END state,
 CASE WHEN {_count(signals.ENGLISH)} > {_count(signals.SPANISH)} + 1 THEN 'en' ELSE 'es' END AS language,
 coalesce(array_to_string(list_transform(string_split(replace(part, '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' '), 'nowhere') place FROM f"""


def q_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    level = F.when(n % 11 == 0, "Beca / Internship").otherwise("Mid")
    pay = signals.estimate_salary(F.concat_ws(" ", "title", "description"), level, F.col("location"), n % 2 == 0, n % 6)
    hints = signals.append_hints(F.col("title"), F.element_at(F.array(F.lit("Solo teletrabajo"), F.lit("Híbrido"), F.lit("Presencial"), F.lit("otro")), (n % 4 + 1).cast("int")), F.when(n % 3 == 0, "30.000 €"))
    return listings(spark, sf_dir).select(
        "job_id", pay["min"].alias("low"), pay["max"].alias("high"), hints.alias("hints"), signals.location_from_title(F.concat_ws(" ", "title", "location"), ["Madrid", "Valencia"], "España").alias("titled"),
        signals.location_from_parts("España", F.col("location"), F.when(n % 2 == 0, " "), F.col("source")).alias("parts"),
    )


_BASE = lambda i: "CASE " + " ".join(f"WHEN {_sql_any('low', words)} THEN {(a, b)[i]}" for words, a, b in signals.PAY) + f" ELSE {signals.FALLBACK[i]} END"
O_PAY = (
    VIEW
    + f""", t AS (SELECT *, lower(concat_ws(' ', title, description)) low, lower(title || ' ' || location) tl FROM v),
 b AS (SELECT *, {_BASE(0)} b0, {_BASE(1)} b1, CAST(seq % 2 = 0 AS INTEGER) pr, CAST(contains(lower(location), 'remoto') OR contains(low, '100% remoto') AS INTEGER) re, CAST(seq % 6 >= 4 AS INTEGER) de FROM t)
 SELECT job_id, CASE WHEN seq % 11 = 0 THEN 12 ELSE b0 + pr + re END low, CASE WHEN seq % 11 = 0 THEN 18 ELSE b1 + 2 * pr + re + de END high,
 title || CASE seq % 4 WHEN 0 THEN chr(10) || 'Modalidad: 100% Remoto' WHEN 1 THEN chr(10) || 'Modalidad: Híbrido' WHEN 2 THEN chr(10) || 'Modalidad: Presencial' ELSE '' END || CASE WHEN seq % 3 = 0 THEN chr(10) || 'Salario oficial: 30.000 €' ELSE '' END hints,
 CASE WHEN contains(tl, 'remoto') THEN '100% Remoto' WHEN contains(tl, 'madrid') THEN 'Madrid' WHEN contains(tl, 'valencia') THEN 'Valencia' ELSE 'España' END titled,
 concat_ws(', ', nullif(trim(location), ''), nullif(trim(source), '')) parts FROM b"""
)

QUERIES = {"page_states": (q_states, O_STATES), "market_pay": (q_pay, O_PAY)}
