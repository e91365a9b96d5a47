"""Catalogs of labels told by a text, and the record of all facts that a listing tells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.features import experience, modality, salary_range
from sievemill.functions.text import present

# Labels and the patterns that tell them, in order; results must agree on them.
CONTRACTS = {
    "Indefinido": [r"\bcontrato\s+indefinido\b", r"\bindefinid[oa]\b", r"\bpermanent\s+contract\b"],
    "Temporal": [r"\bcontrato\s+temporal\b", r"\btemporal\b", r"\bfixed[- ]term\b"],
    "Fijo discontinuo": [r"\bfij[oa]\s+discontinu[oa]\b"],
    "Practicas / Beca": [r"(?<!buenas\s)(?<!mejores\s)(?<!best\s)\bpr[áa]cticas\b", r"\bbeca\b(?!\scomedor)(?!\scomida)", r"\binternship\b", r"\btrainee\b"],
    "Freelance / Autonomo": [r"\baut[oó]nom[oa]\b", r"\bfreelance\b", r"\bcontractor\b"],
    "Obra y servicio": [r"\bobra\s+y\s+servicio\b", r"\bproject[- ]based\s+contract\b"],
}
SCHEDULES = {
    "Jornada completa": [r"\bjornada\s+completa\b", r"\bfull[- ]time\b"],
    "Jornada parcial": [r"\bjornada\s+parcial\b", r"\bpart[- ]time\b"],
    "Jornada intensiva": [r"\bjornada\s+intensiva\b", r"\bcompressed\s+workweek\b"],
    "Horario flexible": [r"\bhorario\s+flexible\b", r"\bflexible\s+hours?\b", r"\bflexibilidad\s+horaria\b"],
    "Turnos": [r"\bturnos?\b", r"\bshift\s+work\b", r"\brotativ[oa]s?\b"],
    "Guardias": [r"\bguardias?\b", r"\bon[- ]call\b"],
    "Semana de 4 dias": [r"\bsemana\s+de\s+4\s+d[ií]as\b", r"\bfour[- ]day\s+week\b"],
}
EDUCATION = {
    "Doctorado": [r"\bdoctorad[oa]\b", r"\bph\.?d\b"],
    "Master": [r"\bm[aá]ster\b", r"\bmaster'?s\s+degree\b"],
    "Grado universitario": [r"\bgrado\s+(?:en|universitario)\b", r"\bdegree\s+in\b", r"\bbachelor'?s\s+degree\b"],
    "Ingenieria": [r"\bingenier[ií]a\s+(?:en|industrial|inform[aá]tica|telecomunicaciones)\b", r"\bengineering\s+degree\b"],
    "FP / Ciclo formativo": [r"\bformaci[oó]n\s+profesional\b", r"\bfp\b", r"\bciclo\s+formativo\b", r"\bvocational\s+training\b"],
}
LANGUAGES = {
    "Ingles": [r"\bingl[eé]s\b", r"\benglish\b"],
    "Valenciano": [r"\bvalencian[oa]\b", r"\bvalenci[aà]\b", r"\bcatal[aà]n\b"],
    "Frances": [r"\bfranc[eé]s\b", r"\bfrench\b"],
    "Aleman": [r"\balem[aá]n\b", r"\bgerman\b"],
    "Italiano": [r"\bitalian[oa]\b", r"\bitalian\b"],
    "Portugues": [r"\bportugu[eé]s\b", r"\bportuguese\b"],
}
CERTIFICATIONS = {
    "AWS Certification": [r"\baws\s+(?:certified|certification)\b"],
    "Azure Certification": [r"\bazure\s+(?:certified|certification)\b"],
    "Google Cloud Certification": [r"\bgoogle\s+cloud\s+(?:certified|certification)\b"],
    "ITIL": [r"\bitil\b"],
    "Scrum": [r"\bscrum\s+(?:master|certified|certification)\b"],
    "PMP": [r"\bpmp\b", r"\bproject management professional\b"],
    "PRINCE2": [r"\bprince2\b"],
    "ISO 27001": [r"\biso\s*27001\b"],
    "CISSP": [r"\bcissp\b"],
    "CEH": [r"\bceh\b"],
    "CCNA": [r"\bccna\b"],
}
BENEFITS = {
    "Seguro medico": [r"\bseguro\s+m[eé]dico\b", r"\bhealth\s+insurance\b"],
    "Ticket restaurante": [r"\bticket\s+restaurant\b", r"\bcheque\s+comida\b", r"\bmeal\s+voucher\b"],
    "Retribucion flexible": [r"\bretribuci[oó]n\s+flexible\b", r"\bflexible\s+compensation\b"],
    "Formacion": [r"\bpresupuesto\s+de\s+formaci[oó]n\b", r"\btraining\s+budget\b", r"\bformaci[oó]n\s+continua\b"],
    "Vacaciones adicionales": [r"\bd[ií]as\s+extra\s+de\s+vacaciones\b", r"\bextra\s+vacation\b"],
    "Plan de pensiones": [r"\bplan\s+de\s+pensiones\b", r"\bpension\s+plan\b"],
}
ARCHITECTURE = {
    "Microservicios": [r"\bmicroservices?\b", r"\bmicroservicios?\b"],
    "API REST": [r"\bapi(?:s)?\s+rest\b", r"\brestful\b"],
    "Event-driven": [r"\bevent[- ]driven\b", r"\barquitectura\s+orientada\s+a\s+eventos\b"],
    "Serverless": [r"\bserverless\b", r"\bfunctions?\s+as\s+a\s+service\b"],
    "Domain-driven design": [r"\bddd\b", r"\bdomain[- ]driven\s+design\b"],
    "SOA": [r"\bsoa\b", r"\bservice[- ]oriented\b"],
}
CATALOGS = {"contract_types": CONTRACTS, "work_schedules": SCHEDULES, "education": EDUCATION, "languages": LANGUAGES, "certifications": CERTIFICATIONS, "benefits": BENEFITS, "architecture": ARCHITECTURE}

#: A small default of tools and their names; the catalog is a parameter.
TOOLS = {"Python": ["python"], "SQL": ["sql"], "C++": ["c++"], "Node.js": ["node.js", "nodejs"], "Docker": ["docker"], "PostgreSQL": ["postgresql", "postgres"], "React": ["react"], "TypeScript": ["typescript"], "Spark": ["spark", "pyspark"]}


def stem(pattern: str) -> str:
    """The longest run of letters and digits that every match of a pattern holds, or nothing."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]\??|\\[a-zA-Z][+*?]?|\\.", " ", pattern)
    return max(re.findall(r"[a-z0-9]{2,}(?![?*])", plain) if "|" not in plain else [], key=len, default="")


def labels(text: Column, catalog: dict[str, list[str]], low: Column | None = None) -> Column:
    """The labels of ``catalog`` told by ``text``, in its order; a null text tells none.

    A pattern is only tried on texts that hold its ``stem``, which a plain search finds in ``low``,
    the text in lower case; give it as a column where several catalogs are asked.
    """
    low = F.lower(text) if low is None else low

    def told(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | (low.contains(stem(p)) & text.rlike(f"(?iu){p}"))
        return out

    return present([F.when(told(patterns), F.lit(name)) for name, patterns in catalog.items()])


def alias_pattern(alias: str) -> str:
    """The pattern of a tool's name; names with marks aren't found in addresses and host names."""
    escaped = "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in alias)
    if any(c in alias for c in "+#.-/ "):
        return rf"(?<![@/\w]){escaped}(?!\w|\.(?:com|org|net|es|io|ai|co))"
    return rf"\b{escaped}\b"


def tech_stack(text: Column, tools: dict[str, list[str]] = TOOLS, low: Column | None = None) -> Column:
    """The tools that a text names, in the catalog's order."""
    return labels(text, {name: [alias_pattern(a) for a in aliases] for name, aliases in tools.items()}, low)


def listing_features(df: DataFrame, cities: list[str], tools: dict[str, list[str]] = TOOLS) -> DataFrame:
    """Add ``features``: what title and description tell of experience, stack, labels, pay, modality.

    Reads title, description and location; nulls are empty.
    """
    rows = df.withColumn("__text", F.concat_ws("\n", "title", "description")).withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")
    told = {"experience": experience(text), "stack": tech_stack(text, tools, low)} | {name: labels(text, c, low) for name, c in CATALOGS.items()}
    told |= {"salary": salary_range(text), "modality": modality(text, F.coalesce("location", F.lit("")), cities)}
    return rows.select(*df.columns, F.struct(*[c.alias(name) for name, c in told.items()]).alias("features"))
