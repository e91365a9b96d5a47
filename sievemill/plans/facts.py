"""Registered queries of catalogs, gates, channels and audits over the given tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import catalogs, experience, gates, times
from sievemill.operators import inventory
from sievemill.plans.queries import VIEW, _sql_list, listings, table
from sievemill.sources import pages

NOW = "2024-01-31 00:00:00"
#: Sentences put behind the texts of the documents, so that every catalog is told somewhere.
SAID = [
    "Ofrecemos contrato indefinido a jornada completa, con seguro médico", "Fixed-term post, part-time, english needed", "Buenas prácticas de código y microservicios en docker", "Prácticas en verano con horario flexible y ticket restaurant", "Grado en física o FP, francés y valencià", "AWS certified, scrum master, RESTful api rest, C++ y node.js",
    "Guardias rotativas, plan de pensiones, máster", "Beca comedor para todos; PhD or engineering degree", "", "Sin más datos que estos", "event-driven and serverless with postgres, training budget", "Autónomo o freelance, semana de 4 días, retribución flexible",
]

#: Demands put behind the texts, so that every rule of experience is met.
ASKED = ["Imprescindible de 2 a 5 años en el sector", "Somos una empresa con 20 años de historia", "Se valorará un mínimo de 3 años", "At least 4 years", "Sin experiencia previa", "Prácticas en verano", "Buscamos un senior", "6+ years", "Empresa con 12 años de experiencia", "Over 8 years required", "De 1 a 2 años"]


def _at(values: list[str], i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), _at(SAID, F.col("doc_id") % len(SAID))).alias("text"))


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): whole texts with a demand behind each."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), _at(ASKED, F.col("doc_id") % len(ASKED))).alias("text"))


def q_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = asking(spark, sf_dir).select("doc_id", experience.experience_details(F.col("text")).alias("told")).select("doc_id", "told.*")
    return told.withColumn("skills", F.array_join("skills", ","))


def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, low = F.col("text"), F.col("low")
    told = {"stack": catalogs.tech_stack(text, low=low)} | {name: catalogs.labels(text, c, low) for name, c in catalogs.CATALOGS.items()}
    return _told(spark, sf_dir).withColumn("low", F.lower("text")).select("doc_id", *[F.array_join(c, ",").alias(name) for name, c in told.items()])


def _re2(pattern: str) -> str:
    """A catalog's pattern for an engine without look-around and with ASCII word bounds."""
    inner = pattern.replace(r"(?<!buenas\s)(?<!mejores\s)(?<!best\s)", "").replace(r"(?!\scomedor)(?!\scomida)", "")
    inner = inner.replace(r"(?<![@/\w])", r"(?:^|[^@/\w])").replace(r"(?!\w|\.(?:com|org|net|es|io|ai|co))", r"(?:$|[^\w.]|\.(?:$|\s))")
    first, *rest = inner.split(r"\b") if r"\b" in inner else (inner,)
    for i, part in enumerate(rest):
        first += (r"(?:^|[^\p{L}\p{N}_])" if i % 2 == 0 else r"(?:$|[^\p{L}\p{N}_])") + part
    return first


def _sql_labels(catalog: dict[str, list[str]]) -> str:
    cases = []
    for name, patterns in catalog.items():
        text = r"regexp_replace(t, '(buenas|mejores|best)\spr[áa]cticas|beca\scom(edor|ida)', '', 'gi')" if name.startswith("Practicas") else "t"
        joined = "|".join(_re2(p) for p in patterns).replace("'", "''")
        cases.append(f"CASE WHEN regexp_matches({text}, '(?i){joined}') THEN '{name}' END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',')"


_STACK = {name: [catalogs.alias_pattern(a) for a in aliases] for name, aliases in catalogs.TOOLS.items()}
O_LABELS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || {_sql_list(SAID)}[doc_id % {len(SAID)} + 1] t FROM documents)
 SELECT doc_id, {", ".join(f"{_sql_labels(c)} AS {n}" for n, c in (dict(stack=_STACK) | catalogs.CATALOGS).items())} FROM d"""

AGES = ["Hace 12 minutos", "3 h", "47 hours ago", "hace 3 días", "2 semanas", "yesterday", "2024-01-30T10:00:00Z", "2024-01-20T10:00:00", "", "soon", "hace 2 days", "5 m"]
AGE_SECONDS = [720, 10800, 169200, 259200, 1209600, None, None, None, None, None, 172800, 300]
WITHIN = [1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 1, 1]
PLACES = ["Valencia", " Ubicación no indicada ", "Worldwide", "USA only", "", "Europe / Remote", "LOCATION not specified", "Brazil"]


def q_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = listings(spark, sf_dir), F.col("seq")
    place, said = _at(PLACES, n % len(PLACES)), _at(AGES, n % len(AGES))
    url = F.concat(F.lit("https://www.example.com/jobs?f_wt="), F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("1,2"), F.lit("3%2C2"), F.lit("22")), (n % 5 + 1).cast("int")))
    return v.select(
        "job_id", gates.is_missing_location(place).alias("no_place"), gates.location_gate(place, ["worldwide", "europe", "valencia"], ["usa", "brazil"]).alias("place_fits"),
        gates.title_gate(F.col("title"), ["data", "python", "ai"], ["analyst", "manager"]).alias("title_fits"), gates.remote_scope(F.col("source"), F.array(F.lit("https://other.org/?f_WT=2"), url), "linkedin", "example.com").alias("remote_search"),
        gates.card_age_gate(said).alias("card_fresh"), times.relative_age_seconds(said).alias("age"), times.within_hours(said, n % 17 == 0, F.lit(NOW).cast("timestamp")).alias("in_48h"),
        gates.needs_enrichment(F.col("description"), n % 3 == 0, F.col("title"), ["Recruiter"]).alias("enrich"), gates.is_remote(F.col("location"), F.when(n % 7 == 0, "Remote")).alias("remote"),
    )


O_GATES = VIEW + f"""SELECT job_id, seq % 8 IN (1, 4, 6) no_place, seq % 8 IN (0, 2, 4, 5) place_fits,
 regexp_matches(lower(title), 'data|python|(^|\\W)ai(\\W|$)') AND NOT regexp_matches(lower(title), 'analyst|manager') title_fits, source = 'linkedin' AND seq % 5 IN (1, 2, 3) remote_search,
 seq % 12 NOT IN (3, 4, 10) card_fresh, {str(AGE_SECONDS).replace('None', 'NULL')}[seq % 12 + 1] age, seq % 17 = 0 OR {WITHIN}[seq % 12 + 1] = 1 in_48h,
 length(coalesce(description, '')) < 600 AND seq % 3 <> 0 AND title <> 'Recruiter' enrich, location IN ('Remoto', 'Teletrabajo') OR seq % 7 = 0 remote FROM v""".replace("\\\\W", "\\W")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = listings(spark, sf_dir), F.col("seq")
    return v.withColumns({"is_local": F.col("location").contains("Valencia"), "is_remote": F.col("location").isin("Remoto", "Teletrabajo"), "salary": F.when(n % 9 == 0, "30k"), "company": F.when(n % 13 > 0, F.col("company"))})


def q_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _views(spark, sf_dir)
    one = lambda kind: gates.listing_view(v, kind, 5).select(F.lit(kind).alias("kind"), "job_id")
    out = one("local")
    for kind in ("remote", "paid", "faulty", "latest"):
        out = out.unionByName(one(kind))
    return out


O_VIEWS = VIEW + """SELECT 'local' kind, job_id FROM v WHERE contains(location, 'Valencia') UNION ALL SELECT 'remote', job_id FROM v WHERE location IN ('Remoto', 'Teletrabajo') UNION ALL SELECT 'paid', job_id FROM v WHERE seq % 9 = 0
 UNION ALL SELECT 'faulty', job_id FROM v WHERE seq % 13 = 0 UNION ALL SELECT 'latest', job_id FROM (SELECT job_id FROM v ORDER BY seq DESC LIMIT 5)"""


def q_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    v = listings(spark, sf_dir).withColumn("aliases", F.when(n % 5 > 0, F.array(F.lit("a"), F.col("job_id"), F.lit(""), F.lit("a"), F.lit("b")))).withColumn("location", F.when(n % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "location")))
    v = v.withColumn("url", F.when(n % 3 == 0, F.concat(F.lit(" https://www.example.com/jobs/view/data-dev-"), (n + 1_000_000).cast("string"), F.lit("/?trk=x#y"))).when(n % 7 == 1, "").otherwise(F.col("url")))
    v = v.withColumn("job_id", F.when(n % 11 == 2, F.concat(F.lit("jobPosting:"), (n + 7_000_000).cast("string"))).otherwise(F.col("job_id"))).withColumn("title", F.when(n % 6 == 1, " \n").otherwise(F.col("title")))
    v = v.withColumn("company", F.when(n % 9 == 3, F.concat(F.col("title"), F.lit(" at a long name of a company"))).when(n % 9 == 4, None).otherwise(F.col("company")))
    guarded = gates.guard_card(v).select(n.alias("at"), F.col("company").alias("guarded"))
    return gates.normalise_listing(v).join(guarded, n == F.col("at")).select("seq", "title", "company", "guarded", "location", "job_id", "url", F.array_join("aliases", ",").alias("aliases"))


O_NORMALISED = VIEW + r""", w AS (SELECT seq, CASE WHEN seq % 6 = 1 THEN '' ELSE title END title, CASE WHEN seq % 6 = 1 THEN chr(32) || chr(10) ELSE title END raw_title, company, CASE WHEN seq % 4 = 0 THEN '' ELSE trim(location) END AS location, CASE WHEN seq % 11 = 2 THEN 'jobPosting:' || (seq + 7000000) ELSE job_id END raw,
 CASE WHEN seq % 3 = 0 THEN 'https://www.example.com/jobs/view/data-dev-' || (seq + 1000000) WHEN seq % 7 = 1 THEN '' ELSE 'HTTPS://Jobs.Example.com/View//' || (seq % 500 + 100000) END url FROM v),
 x AS (SELECT *, CASE WHEN seq % 9 = 3 THEN trim(raw_title || ' at a long name of a company', ' ' || chr(10)) WHEN seq % 9 = 4 THEN '' ELSE company END comp, CASE WHEN url <> '' THEN substr(sha256(url), 1, 24) END old FROM w),
 y AS (SELECT *, CASE WHEN seq % 11 = 2 THEN CAST(seq + 7000000 AS VARCHAR) WHEN seq % 3 = 0 THEN CAST(seq + 1000000 AS VARCHAR) ELSE coalesce(old, raw) END id, CASE WHEN seq % 5 > 0 THEN ['a', CAST(seq AS VARCHAR), 'b', raw, old] ELSE [raw, old] END every FROM x)
 SELECT seq, CASE WHEN title = '' THEN 'Oferta' ELSE title END title, CASE WHEN comp = '' THEN 'Empresa no indicada' ELSE comp END company, CASE WHEN comp = '' OR (contains(lower(comp), lower(title)) AND length(comp) > 25) THEN 'Empresa no indicada' ELSE comp END guarded,
 CASE WHEN location = '' THEN 'Ubicación no indicada' ELSE location END AS location, id job_id, url, array_to_string(list_filter(every, lambda e, i: e IS NOT NULL AND e <> id AND list_position(every, e) = i), ',') aliases FROM y"""


def q_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("run_id"), F.col("l_linenumber").alias("search"), F.col("l_partkey").alias("key"))
    s = li.select("run_id", "search").distinct()
    text = lambda c: c.cast("string")
    told = F.create_map(F.lit("reachedEnd"), text(F.col("run_id") % 2 == 0), F.lit("stableRounds"), text(F.col("search") + 1), F.lit("firstPageTargetReached"), text(F.col("run_id") % 3 == 0), F.lit("challengeDetected"), text(F.col("run_id") % 10 == 6))
    done = inventory.search_complete(F.when(F.col("run_id") % 7 == 1, "partial").otherwise("complete"), told)
    return inventory.channel_union(li, s.select("run_id", "search", done.alias("complete")))


O_CHANNELS = """WITH li AS (SELECT DISTINCT l_suppkey % 50 run_id, l_linenumber search, l_partkey AS key FROM lineitem), s AS (SELECT DISTINCT run_id, search FROM li),
 w AS (SELECT run_id, count(*) searches, bool_and(run_id % 7 <> 1 AND (run_id % 3 = 0 OR (run_id % 2 = 0 AND search + 1 >= 3)) AND run_id % 10 <> 6) complete FROM s GROUP BY 1)
 SELECT run_id, searches, complete, count(DISTINCT key) unique_cards, count(*) - count(DISTINCT key) channel_duplicates FROM w JOIN li USING (run_id) GROUP BY 1, 2, 3"""


def q_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 3 > 0).alias("complete"), F.when(k % 5 > 0, True).alias("target_complete"), (k % 7 == 0).alias("challenge"), at.alias("production_at"), (at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 200).cast("decimal(18,6)"))).alias("reference_at"), (k % 4).alias("production"), (k % 2).alias("reference"))
    return inventory.capture_validity(rows).select("id", F.array_join("reasons", ",").alias("reasons"), "valid")


O_CAPTURES = """WITH r AS (SELECT o_orderkey id, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'search_incomplete' END, CASE WHEN o_orderkey % 5 = 0 THEN 'target_incomplete' END, CASE WHEN o_orderkey % 200 > 120 THEN 'captures_too_far_apart' END,
 CASE WHEN o_orderkey % 7 = 0 THEN 'challenge_detected' END, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 2 = 0 THEN 'reference_missing' END) reasons FROM orders) SELECT id, reasons, reasons = '' AS valid FROM r"""


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("source"), F.col("l_partkey").alias("key"), "l_linenumber")
    n = F.col("n_nationkey")
    ref = F.when(n == 1, "http_403 at page 2").when(n == 2, "timeout").when(n == 6, "parse_error").when(n == 7, "")
    own = F.when(n.isin(1, 3), "challenge_page").when(n == 5, "parse_error").when(n == 6, "http_429").when(n == 8, "")
    failures = table(spark, sf_dir, "nation").where(n < 22).select(n.cast("long").alias("source"), ref.alias("reference_failure"), own.alias("blocked_reason"))
    return inventory.audit_source(li.where("l_linenumber <= 3 AND source <> 4"), li.where("l_linenumber >= 2"), lambda df: (df.key % 5 == 0) & (df.source % 3 > 0), failures)


O_AUDIT = """WITH li AS (SELECT l_suppkey % 20 AS source, l_partkey AS key, l_linenumber n FROM lineitem), r AS (SELECT DISTINCT source, key FROM li WHERE n <= 3 AND source <> 4), x AS (SELECT DISTINCT source, key FROM li WHERE n >= 2),
 j AS (SELECT coalesce(r.source, x.source) AS source, r.key rk, x.key xk FROM r FULL JOIN x ON r.source = x.source AND r.key = x.key),
 c AS (SELECT source, count(*) FILTER (WHERE rk IS NOT NULL AND xk IS NOT NULL) matched, count(*) FILTER (WHERE xk IS NULL) missing, count(*) FILTER (WHERE rk IS NULL) extra, count(*) FILTER (WHERE xk IS NULL AND rk % 5 = 0 AND source % 3 > 0) eligible_missing FROM j GROUP BY 1),
 a AS (SELECT n.source, coalesce(matched, 0) matched, coalesce(missing, 0) missing, coalesce(extra, 0) extra, coalesce(eligible_missing, 0) eligible_missing FROM (SELECT CAST(n_nationkey AS BIGINT) AS source FROM nation WHERE n_nationkey < 22) n LEFT JOIN c ON c.source = n.source)
 SELECT *, CASE WHEN source IN (1, 3, 6) THEN 'blocked' WHEN source IN (2, 5) THEN 'degraded' WHEN matched + missing = 0 THEN 'pending_validation' WHEN eligible_missing > 0 THEN 'degraded' ELSE 'validated' END status,
 CASE WHEN source = 1 THEN 'http_403 at page 2' WHEN source = 3 THEN 'challenge_page' WHEN source = 6 THEN 'http_429' WHEN source = 5 THEN 'parse_error' WHEN source = 2 THEN 'timeout' WHEN matched + missing = 0 THEN 'reference_empty' WHEN eligible_missing > 0 THEN 'eligible_offers_missing' ELSE 'coverage_ok' END reason FROM a"""


def q_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.when(v % 7 > 0, F.when(v % 3 == 0, "rate_limited").when(v % 3 == 1, "RATE_LIMITED").otherwise(F.col("event_type")))
    count = lambda kind: F.when(F.col("user_id") % 5 > 0, F.count_if(F.col("event_type") == kind))
    urls = F.when(F.col("user_id") % 6 > 0, F.collect_list(F.struct(F.col("event_type").alias("extension"), state.alias("api"))))
    runs = e.groupBy("user_id").agg(count("view").alias("matches"), count("click").alias("only_bot"), count("error").alias("only_reference"), count("purchase").alias("eligible_absences"), urls.alias("urls")).withColumnRenamed("user_id", "run_id")
    ages = e.select(F.col("user_id").alias("run_id"), "ts", F.when(v % 2 == 0, "extension").otherwise("api").alias("channel"), F.when(v % 5 > 0, v % 3 == 0).alias("complete"), (v % 4 == 1).alias("fallback"))
    return inventory.comparison_counts(runs).join(inventory.channel_ages(ages, "2024-02-01 00:00:00", ["run_id"]), "run_id")


O_COMPARISONS = """WITH e AS (SELECT *, CASE WHEN event_id % 7 > 0 THEN CASE event_id % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'RATE_LIMITED' ELSE event_type END END api, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) age, event_id % 2 = 0 x, coalesce(event_id % 5 > 0 AND event_id % 3 = 0, false) done FROM events)
 SELECT user_id run_id, CASE WHEN user_id % 5 > 0 THEN count(*) FILTER (WHERE event_type = 'view') ELSE 0 END matches, CASE WHEN user_id % 5 > 0 THEN count(*) FILTER (WHERE event_type = 'click') ELSE 0 END only_production, CASE WHEN user_id % 5 > 0 THEN count(*) FILTER (WHERE event_type = 'error') ELSE 0 END only_reference,
 CASE WHEN user_id % 6 > 0 THEN count(*) FILTER (WHERE api = 'rate_limited') ELSE 0 END api_rate_limited, CASE WHEN user_id % 5 > 0 THEN count(*) FILTER (WHERE event_type = 'purchase') ELSE 0 END eligible_absences,
 min(age) FILTER (WHERE x) extension_received, min(age) FILTER (WHERE x AND done) extension_complete, min(age) FILTER (WHERE NOT x) api_run, min(age) FILTER (WHERE NOT x AND event_id % 4 = 1) fallback, coalesce(arg_max(done, CASE WHEN NOT x THEN ts END), false) last_api_ok FROM e GROUP BY 1"""


def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), "ts")
    return inventory.decision_counts(e, "2024-01-20 00:00:00", 48)


O_DECISIONS = "SELECT event_type status, count(*) n FROM events WHERE ts >= TIMESTAMP '2024-01-18' GROUP BY 1"


def q_last_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("provider"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return inventory.last_n_per_group(li, 10, "provider", "seq", 10_000)


O_LAST_REJECTED = """WITH r AS (SELECT l_suppkey provider, l_orderkey * 10 + l_linenumber seq FROM lineitem WHERE l_returnflag = 'R' ORDER BY seq DESC LIMIT 10000)
 SELECT * FROM (SELECT provider, seq, CAST(row_number() OVER (PARTITION BY provider ORDER BY seq DESC) AS INTEGER) place FROM r) WHERE place <= 10"""


def q_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.concat(F.lit("t"), (F.col("doc_id") % 6).cast("string")), F.col("source")).alias("stack"))
    return inventory.term_frequency(rows, F.col("stack"), "text", "License", "doc_id")


O_TERM_FREQUENCY = """WITH d AS (SELECT unnest(['t' || doc_id % 6, source]) term, length(trim(coalesce(text, ''))) <= 50 little, contains(lower(coalesce(text, '')), 'license') leak FROM documents)
 SELECT term, count(*) listings, count(*) FILTER (WHERE little) short_texts, count(*) FILTER (WHERE leak) leaks FROM d GROUP BY 1"""


def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
    stats = e.groupBy(F.date_trunc("day", "ts").alias("cycle"), p.alias("provider")).agg(F.count("*").alias("n"))
    n = F.col("n")
    g = F.ascii(F.substring("provider", 1, 1)) + F.ascii(F.substring("provider", -1, 1))
    stats = stats.select("cycle", "provider", F.when(g % 5 > 0, g % 7 > 1).alias("validation_status"), F.when(g % 4 > 0, F.when(g % 8 == 1, 3).otherwise(0)).alias("http_429"), F.when(g % 3 == 0, "http_403").when(g % 3 == 1, "").alias("blocked_reason"), (n % 2).alias("detected"))
    others = table(spark, sf_dir, "region").select(F.concat(F.lit("absent-"), F.col("r_regionkey").cast("string")), F.when(F.col("r_regionkey") % 2 == 0, F.lower("r_name")))
    return inventory.health_board(stats, e.where("user_id % 4 < 2").select(p.alias("provider"), F.lit(None).cast("string").alias("reason")).union(others))


O_HEALTH = """WITH s AS (SELECT date_trunc('day', ts) c, event_type || '-' || user_id % 4 provider, count(*) n, ascii(event_type) + ascii(CAST(user_id % 4 AS VARCHAR)) g FROM events GROUP BY 1, 2, 4),
 now AS (SELECT provider, CASE WHEN g % 5 > 0 THEN g % 7 > 1 END ok, g % 4 > 0 AND g % 8 = 1 limited, g % 3 = 0 why, n % 2 > 0 found FROM s WHERE c = (SELECT max(c) FROM s)),
 asked AS (SELECT DISTINCT event_type || '-' || user_id % 4 provider, NULL AS told FROM events WHERE user_id % 4 < 2 UNION ALL SELECT 'absent-' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) END FROM region)
 SELECT provider, CASE WHEN ok = false THEN 'paused' WHEN limited THEN 'blocked' WHEN why THEN 'error' WHEN found THEN 'ok' ELSE 'empty' END state, CASE WHEN ok = false THEN CASE WHEN why THEN 'http_403' ELSE 'Validación pendiente' END WHEN limited THEN 'Rate Limit / Captcha' WHEN why THEN 'http_403' END reason FROM now
 UNION ALL SELECT provider, 'quarantine', coalesce(told, 'Pendiente de validación') FROM asked WHERE provider NOT IN (SELECT provider FROM now)"""


def q_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return inventory.key_sets(o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 3 = 0").select("o_custkey"), "o_custkey")


O_KEY_SETS = """SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 2 = 0) AND bool_or(o_orderkey % 3 = 0) THEN 'both' WHEN bool_or(o_orderkey % 2 = 0) THEN 'left' ELSE 'right' END side FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 GROUP BY 1"""


def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = listings(spark, sf_dir).withColumn("place", F.col("seq") + 1)
    n = F.col("n_nationkey")
    typed = F.when(n < 5, n.cast("string")).when(n < 9, F.concat(F.lit("9999"), (n % 5).cast("string"))).when(n < 13, F.concat(F.lit("00"), n.cast("string"), F.lit("7777"))).when(n < 16, F.concat(F.lit("id-"), n.cast("string"))).when(n == 16, "COMPANY 3").when(n == 17, "django").when(n == 18, "nowhere").when(n == 19, " ").when(n == 20, " ny 1 ").when(n == 21, "x1").when(n == 22, "z")
    return inventory.lookup_cascade(v.withColumn("job_id", F.concat(F.lit("ID-"), "job_id")), table(spark, sf_dir, "nation").select(typed.alias("arg")), "seq")


O_LOOKUP = VIEW + """, a AS (SELECT DISTINCT trim(coalesce(CASE WHEN k < 5 THEN CAST(k AS VARCHAR) WHEN k < 9 THEN '9999' || k % 5 WHEN k < 13 THEN '00' || k || '7777' WHEN k < 16 THEN 'id-' || k WHEN k = 16 THEN 'COMPANY 3' WHEN k = 17 THEN 'django' WHEN k = 18 THEN 'nowhere' WHEN k = 19 THEN ' ' WHEN k = 20 THEN ' ny 1 ' WHEN k = 21 THEN 'x1' WHEN k = 22 THEN 'z' END, '')) arg FROM (SELECT n_nationkey k FROM nation)),
 h AS (SELECT arg, 'ID-' || job_id job_id, seq, CASE WHEN arg = '' THEN CASE WHEN seq = 0 THEN 1 END WHEN regexp_full_match(arg, '[0-9]{1,5}') THEN CASE WHEN seq + 1 = CAST(arg AS BIGINT) THEN 1 END WHEN contains(lower('ID-' || job_id), lower(arg)) THEN 2 WHEN contains(lower(company), lower(arg)) THEN 3 WHEN contains(lower(title), lower(arg)) THEN 4 END AS rank FROM v, a)
 SELECT arg, arg_min(job_id, (rank, seq)) job_id, CAST(min(rank) AS INTEGER) AS rank FROM h WHERE rank IS NOT NULL GROUP BY 1"""


def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("complete"))
    return inventory.gap_fallback(e, 43_200, "2024-01-05 00:00:00", "user_id").select("event_id", "due")


O_GAPS = """WITH w AS (SELECT event_id, floor(epoch(ts)) sec, max(CASE WHEN event_type = 'purchase' THEN floor(epoch(ts)) END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS last FROM events)
 SELECT event_id, sec >= epoch(TIMESTAMP '2024-01-06') AND (last IS NULL OR sec - last >= 86400) due FROM w"""


def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("cycle")).agg(F.count("*").alias("n"))
    keys = inventory.count_keys(table(spark, sf_dir, "events"), "user_id")
    return inventory.cycle_history(e).join(F.broadcast(keys))  # one row


O_HISTORY = "SELECT strftime(ts, '%Y-%m-%d %H') AS cycle, count(*) n, (SELECT count(DISTINCT user_id) FROM events) AS keys FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 8"


def q_sources_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with different columns as one table, and each source's tags in order of appearance."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("tag"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"))
    united = c.unionByName(s, allowMissingColumns=True)
    tags = F.array_join(F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_set(F.struct("nation", "tag"))), lambda x: x["tag"]), lambda t: t.isNotNull())), ",")
    return united.groupBy("source").agg(F.count("*").alias("n"), tags.alias("tags"))


O_SOURCES_UNITED = """WITH u AS (SELECT 'customer' AS source, c_nationkey nation, c_mktsegment tag FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier), f AS (SELECT source, tag, min((nation, tag)) p FROM u WHERE tag IS NOT NULL GROUP BY 1, 2)
 SELECT source, count(*) n, coalesce((SELECT string_agg(tag, ',' ORDER BY p) FROM f WHERE f.source = u.source), '') tags FROM u GROUP BY source"""



def q_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    slug = F.regexp_replace(F.lower(F.concat_ws("-", "p_brand", F.when(F.col("p_partkey") % 3 == 0, "engineer").when(F.col("p_partkey") % 3 == 1, "data-analyst").otherwise("house"), "p_name")), "[^a-z0-9]+", "-")
    loc = F.concat(F.lit("<loc>https://x.example/offers/"), F.col("p_partkey").cast("string"), F.lit("/"), slug, F.when(F.col("p_partkey") % 2 == 0, "-oct23").otherwise(""), F.lit("</loc>"))
    return pages.parse_sitemap_slugs(p.groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.array_join(F.collect_list(loc), "\n").alias("body")), ["engineer", "data", "analyst"]).drop("url")


O_SITEMAP = r"""WITH p AS (SELECT p_partkey k, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') b, regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN 'engineer' WHEN 1 THEN 'data-analyst' ELSE 'house' END || '-' || p_name), '[^a-z0-9]+', '-', 'g') t FROM part),
 w AS (SELECT k, b || '-' || t slug, CASE WHEN k % 3 < 2 THEN b ELSE '' END c, CASE WHEN k % 3 < 2 THEN t ELSE b || '-' || t END t FROM p)
 SELECT CAST(k AS VARCHAR) id, slug, array_to_string(list_transform(string_split(c, '-'), lambda x: upper(x[1]) || x[2:]), ' ') company, array_to_string(list_transform(string_split(t, '-'), lambda x: upper(x[1]) || x[2:]), ' ') title FROM w"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with a record of a part as JSON-LD, as a script's string and as table rows.

    Parts meet pages by a shuffle and the record is made behind it: a made-up string counts as 20 bytes
    in estimates, so all records of a large table would else be taken for small enough to broadcast.
    """
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), "p_name", "p_brand", "p_size").hint("merge")
    p = table(spark, sf_dir, "pages").join(p, "page_id")
    posting = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("description"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.lit("Town").alias("addressLocality"), F.col("p_size").cast("string").alias("addressRegion")).alias("address")).alias("jobLocation")))
    ld = F.when(F.col("page_id") % 3 == 0, posting).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"@graph": [{"@type": "Page"}, '), posting, F.lit("]}"))).otherwise(F.concat(F.lit('[{"@type": "Other"}, '), posting, F.lit("]")))
    offers = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("size"))).alias("offers")))
    quoted = F.regexp_replace(F.regexp_replace(offers, r"\\", r"\\\\"), '"', r'\\"')
    cells = F.concat(F.lit("<table><tr><td>REF-"), F.col("page_id").cast("string"), F.lit("</td><td>"), F.col("p_brand"), F.lit("</td><td><b>"), F.col("p_size").cast("string"), F.lit("</b></td><td>a &amp; b</td></tr><tr><td>no</td></tr></table>"))
    extra = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit('</script><script>x = JSON.parse("'), quoted, F.lit('")</script><table><tr><td>REF-first</td></tr></table>'), cells)
    return p.withColumn("html", F.concat(F.coalesce("html", F.lit("")), extra)).drop("p_name", "p_brand", "p_size")


def q_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    ld = pages.extract_jsonld(p)
    offers = pages.parse_embedded_json(p, "struct<offers: array<struct<title: string, size: int>>>", "offers").select("page_id", F.col("item.title").alias("offer"), F.col("item.size").alias("size"))
    rows = pages.extract_html_table(p, 2, "REF-").select("page_id", F.array_join("values", "|").alias("cells"))
    return ld.join(offers.hint("merge"), "page_id").join(rows.hint("merge"), "page_id")


O_PAGE_RECORDS = """SELECT page_id, p_brand organisation, 'Town' locality, CAST(p_size AS VARCHAR) region, p_name description, p_name offer, CAST(p_size AS INTEGER) size, 'REF-' || page_id || '|' || p_brand || '|' || p_size || '|a & b' AS cells FROM pages JOIN part ON p_partkey = page_id"""


QUERIES = {
    "text_labels": (q_labels, O_LABELS), "listing_gates": (q_gates, O_GATES), "listing_views": (q_views, O_VIEWS), "normalised_listings": (q_normalised, O_NORMALISED), "channel_union": (q_channels, O_CHANNELS), "capture_validity": (q_captures, O_CAPTURES), "audit_sources": (q_audit, O_AUDIT), "channel_comparison": (q_comparisons, O_COMPARISONS),
    "decision_counts": (q_decisions, O_DECISIONS), "last_rejected": (q_last_rejected, O_LAST_REJECTED), "term_frequency": (q_term_frequency, O_TERM_FREQUENCY), "health_board": (q_health, O_HEALTH), "key_sets": (q_key_sets, O_KEY_SETS), "lookup_cascade": (q_lookup, O_LOOKUP), "gap_fallback": (q_gaps, O_GAPS), "cycle_history": (q_history, O_HISTORY),
    "sources_united": (q_sources_united, O_SOURCES_UNITED), "sitemap_slugs": (q_sitemap, O_SITEMAP), "page_records": (q_page_records, O_PAGE_RECORDS), "experience_details": (q_experience, None),
}
