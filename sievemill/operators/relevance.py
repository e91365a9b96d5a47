"""The relevance waterfall: status, score, family and evidence of a listing, as Columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.text import any_phrase, has_term, lower_squash, match_terms, norm_text, score_terms


@dataclass(frozen=True)
class RulePack:
    """Term lists of the waterfall. The defaults are fixed values that results must agree on."""

    # Evidence terms and unwanted roles in normal form.
    unwanted: list[str] = field(default_factory=lambda: [
        "ventas", "sales", "comercial", "soporte tecnico", "helpdesk", "help desk", "atencion al cliente", "customer support", "scrum master", "agile coach", "marketing", "seo", "sem", "community manager", "account manager", "business development", "sdr",
        "consultor sap", "sap fico", "sap sd", "sap mm", "profesor", "docente", "formador", "tutor", "ciberseguridad", "cybersecurity", "administrador de sistemas", "sysadmin", "legal", "abogado", "senior", "sr", "lead", "principal", "director", "jefe", "responsable", "head of", "manager",
    ])
    hr: list[str] = field(default_factory=lambda: ["nomina", "nominas", "payroll", "recursos humanos", "rrhh", "talent acquisition", "seleccion de personal", "recruiter", "tecnico laboral"])
    cad: list[str] = field(default_factory=lambda: ["autocad", "bim", "revit", "delineante", "delineacion", "modelador bim"])
    graphic: list[str] = field(default_factory=lambda: ["disenador grafico", "diseno grafico", "grafista", "arte final", "illustrator", "photoshop"])
    mechanical: list[str] = field(default_factory=lambda: ["soldador", "tornero", "fresador", "mecanizado", "operario de produccion", "operario de fabricacion", "montador mecanico", "mantenimiento mecanico", "fabricacion mecanica"])
    plc: list[str] = field(default_factory=lambda: ["plc", "scada", "tia portal", "programador plc", "automatista industrial"])
    ai: list[str] = field(default_factory=lambda: ["inteligencia artificial", "artificial intelligence", "ai", "machine learning", "deep learning", "nlp", "llm", "generative ai", "ia generativa", "computer vision", "vision artificial", "openai", "pytorch", "tensorflow", "scikit-learn"])
    data: list[str] = field(default_factory=lambda: ["data engineer", "ingeniero de datos", "data scientist", "cientifico de datos", "etl", "data pipeline", "big data", "spark", "hadoop", "databricks", "snowflake"])
    software: list[str] = field(default_factory=lambda: ["python", "fastapi", "django", "flask", "api rest", "microservicios", "backend", "desarrollo backend"])
    generic: list[str] = field(default_factory=lambda: ["backend", "software engineer", "desarrollador", "developer", "programador", "programmer"])
    industrial: list[str] = field(default_factory=lambda: ["mantenimiento predictivo", "predictive maintenance", "industria 4.0", "industry 4.0", "digital twin", "gemelo digital", "iot", "iiot", "edge computing", "condition monitoring", "machine vision", "vision artificial", "robotica", "robotics"])
    analytics: list[str] = field(default_factory=lambda: ["data analyst", "analista de datos", "power bi", "tableau", "business intelligence", "sql"])
    automation: list[str] = field(default_factory=lambda: ["automatizacion", "automation", "rpa", "power automate", "ui path", "uipath"])
    context: list[str] = field(default_factory=lambda: ["predictivo", "iot", "digital", "vision", "datos", "data"])
    plausible: list[str] = field(default_factory=lambda: ["ingenier", "engineer", "datos", "data", "digital", "automatiz", "software", "tecnolog"])
    # Phrases in front of a term that void or weaken it.
    negations: list[str] = field(default_factory=lambda: ["no requerimos", "no necesitamos", "no buscamos", "no es necesario", "no requerido", "no excluyente"])
    weak: list[str] = field(default_factory=lambda: ["valorable", "deseable", "plus", "bonus", "ventaja", "no excluyente", "nice to have"])
    candidate_source: str = "linkedin"


def classify_relevance(df: DataFrame, rules: RulePack | None = None) -> DataFrame:
    """Add ``decision``: status, score, family, positive and negative evidence, needs_description.

    Reads title, company, source and description; null is empty. Term arrays are columns of
    their own, so each list is matched once and the waterfall only looks at sizes.
    """
    r = rules or RulePack()
    named = F.trim(F.concat_ws(" ", norm_text(F.col("title")), norm_text(F.col("company"))))
    rows = df.withColumn("__named", named).withColumn("__detail", norm_text(F.col("description")))
    rows = rows.withColumn("__text", F.trim(F.concat_ws(" ", "__named", "__detail")))
    text, head = F.col("__text"), F.col("__named")
    lists = {n: getattr(r, n) for n in ("ai", "data", "software", "generic", "industrial", "analytics", "automation")}
    for name, terms in lists.items():
        rows = rows.withColumn(f"__{name}", match_terms(text, terms))
    heads = {n: getattr(r, n) for n in ("unwanted", "hr", "cad", "graphic", "mechanical", "plc")}
    for name, terms in heads.items():
        rows = rows.withColumn(f"__{name}", match_terms(head, terms))
    none = F.array().cast("array<string>")
    found = lambda n: F.size(f"__{n}") > 0
    # The evidence of the software family also lists its generic terms.
    soft = F.concat("__software", F.array_except("__generic", F.array(*[F.lit(t) for t in r.software if t in r.generic]).cast("array<string>"))) if r.software else F.col("__generic")
    labelled = [("ai_ml", F.col("__ai")), ("data", F.col("__data")), ("python_api", soft), ("industrial_digital", F.col("__industrial")), ("analytics", F.col("__analytics")), ("automation", F.col("__automation"))]
    evidence = F.concat(*[F.transform(F.slice(c, 1, 3), lambda t, f=f: F.concat(F.lit(f"{f}:"), t)) for f, c in labelled])
    rows = rows.withColumn("__evidence", F.slice(evidence, 1, 6))
    score = lambda n: score_terms(text, lists[n], r.negations, r.weak, F.col(f"__{n}"))
    digital = found("ai") | found("data") | found("software") | found("industrial")

    def told(status: str, points: Column, family: str, positive: Column, negative: Column = none, needs: Column | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), points.cast("int").alias("score"), F.lit(family).alias("family"), positive.alias("positive_evidence"), negative.alias("negative_evidence"), (F.lit(False) if needs is None else needs).alias("needs_description"))

    any_in = lambda c, terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))
    positive, plausible = F.col("__evidence"), any_in(head, r.plausible)
    decision = None
    for name, family in (("unwanted", "rol_no_tecnico_o_gestion"), ("hr", "rrhh_nominas"), ("cad", "cad_bim"), ("graphic", "diseno_grafico")):
        value = told("rejected", F.lit(0), family, F.slice(positive, 1, 5), F.col(f"__{name}"))
        decision = F.when(found(name), value) if decision is None else decision.when(found(name), value)
    detail = F.length(F.trim(F.coalesce("description", F.lit("")))) > 50
    decision = (
        decision.when(found("mechanical") & ~digital, told("rejected", F.lit(0), "mecanica_fabricacion", none, F.col("__mechanical")))
        .when(found("plc") & ~digital, told("rejected", F.lit(20), "plc_scada_puro", none, F.col("__plc")))
        .when(found("ai"), told("accepted", F.least(F.lit(100), 80 + F.least(F.lit(18), score("ai"))), "ai_ml", positive))
        .when(found("data"), told("accepted", F.least(F.lit(95), 74 + F.least(F.lit(20), score("data"))), "data", positive))
        .when(found("industrial") & (found("software") | any_in(text, r.context)), told("accepted", F.least(F.lit(88), 72 + score("industrial") + F.least(F.lit(6), score("software"))), "industrial_digital", positive))
        .when(found("software"), told("accepted", F.least(F.lit(85), 70 + F.least(F.lit(15), score("software"))), "python_api", positive))
        .when(found("generic") & detail, told("accepted", F.lit(75), "software_generico", positive))
        .when(found("generic") & (norm_text(F.col("source")) == r.candidate_source), told("warning", F.lit(65), "linkedin_search_candidate", positive, needs=F.lit(True)))
        .when(found("generic"), told("rejected", F.lit(20), "software_sin_stack_objetivo", none))
        .when(found("analytics"), told("warning", F.least(F.lit(69), 56 + score("analytics")), "analytics", positive))
        .when(found("automation"), told("warning", F.least(F.lit(69), 56 + score("automation")), "automation", positive))
        .otherwise(told("rejected", F.when(plausible, 35).otherwise(0), "sin_evidencia_digital", none, needs=plausible & (F.col("__detail") == "")))
    )
    return rows.withColumn("decision", decision).select(*df.columns, "decision")


def is_local(location: Column, title: Column, areas: list[str]) -> Column:
    """An area term as a whole word of location and title."""
    where = norm_text(F.concat_ws(" ", location, title))
    out = F.lit(False)
    for a in areas:
        out = out | has_term(where, a)
    return out


def filter_reason(df: DataFrame, viable: Column, include: list[str], exclude: list[str], candidate_source: str = "linkedin") -> Column:
    """The first reason to drop a listing (exclude, location, include), or null.

    Reads title, company, location, description, source and, where there are, level and
    minimum_years. Candidate sources skip the include list; excludes look at title and company.
    """
    title = F.coalesce("title", F.lit(""))
    out = F.when(title.rlike(r"(?i)\b(?:senior|sr\.?|lead)\b"), "exclude")
    if "level" in df.columns:
        out = out.when(F.col("level").isin("Senior", "Lead / Principal"), "exclude")
    if "minimum_years" in df.columns:
        out = out.when(F.col("minimum_years") >= 4, "exclude")
    out = out.when(~viable, "location")
    if include:
        haystack = F.concat_ws(" ", "title", "company", "location", "description")
        out = out.when((lower_squash(F.col("source")) != candidate_source) & ~any_phrase(haystack, include), "include")
    return out.when(any_phrase(F.concat_ws(" ", "title", "company"), exclude), "exclude")


def recency_decision(urls: Column, texts: Column, now: Column, applies: Column, published: Column | None = None) -> Column:
    """State of a listing against the narrowest window of its searches and its oldest evidence.

    Evidence are relative times in ``texts`` and clock times in ``published``, both arrays.
    """
    from sievemill.functions.keys import window_seconds
    from sievemill.functions.times import published_age_seconds, relative_age_seconds

    allowed = F.array_min(F.transform(urls, lambda u: window_seconds(u, "f_TPR")))
    ages = F.transform(texts, relative_age_seconds)
    if published is not None:
        ages = F.concat(F.coalesce(ages, F.array().cast("array<bigint>")), F.coalesce(F.transform(published, lambda p: published_age_seconds(p, F.to_timestamp(now))), F.array().cast("array<bigint>")))
    age = F.array_max(ages)
    state = F.when(~applies, "not_applicable").when(allowed.isNull() | age.isNull(), "unverified").when(age > allowed, "outside").otherwise("accepted")
    return F.struct(state.alias("state"), age.alias("age_seconds"), allowed.alias("allowed_seconds"))


def outcome(recency: Column, seen: Column, decision: Column, reason: Column, limited: Column, delivered: Column) -> Column:
    """Exactly one outcome per listing, the first that applies."""
    return (
        F.when(recency == "outside", "discarded_time_window")
        .when(recency == "unverified", "unverified_time_window")
        .when(seen, "seen")
        .when(decision["status"] == "rejected", F.concat(F.lit("discarded_relevance:"), decision["family"]))
        .when(reason.isNotNull(), F.concat(F.lit("discarded_"), reason))
        .when(limited, "notification_limit")
        .when(delivered, "sent")
        .otherwise("delivery_failed")
    )
