"""Registered queries of page elements: cards by source specs, objects hidden in scripts, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.plans.feeds import _scratch
from sievemill.plans.queries import table
from sievemill.sources import blocks

MENU = blocks.SourceSpec("menu", "https://jobs.example.com/list", "Menu", (r"^/[^/?#]+",), ("nav a",))
BOARD = blocks.SourceSpec("board", "https://jobs.example.com/list", "Board", (r"/jobs/\d+",), (".card a[href*='/jobs/']",), (".place",), max_results=3)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages as lists of one board."""
    return table(spark, sf_dir, "pages").withColumn("url", F.concat(F.lit("https://jobs.example.com/list/"), F.col("page_id").cast("string")))


def q_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.listing_cards(_pages(spark, sf_dir), MENU).select("page_id", "url", "title", "location", "company")


O_MENU = r"""WITH l AS (SELECT page_id, unnest(x) a, unnest(range(len(x))) AS n FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>') x FROM pages)),
 u AS (SELECT page_id, n, 'https://jobs.example.com' || regexp_extract(a, 'href="([^"]*)"', 1) url, trim(regexp_replace(regexp_extract(a, '>([^<]*)<', 1), '\s+', ' ', 'g')) title FROM l WHERE regexp_matches(a, 'href="/[^/?#"]+'))
 SELECT page_id, url, arg_min(title, n) title, 'Ubicación no especificada' AS location, 'Menu' company FROM u GROUP BY page_id, url HAVING length(arg_min(title, n)) BETWEEN 1 AND 300"""


#: How many of a board's first cards stand on each of its pages, over the board's cap.
TOP = BOARD.max_results + 1


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with nested cards of the suppliers of their nation, and a next link.

    As on a real board, its ``TOP`` first cards stand on top of every page and the whole list is dealt
    over its pages, so all pages together grow with pages and suppliers, not with their product. Where
    page ids have gaps, what is dealt to a missing page is on none.
    """
    s = table(spark, sf_dir, "supplier").withColumn("board", F.col("s_nationkey") % 5)
    key = F.col("s_suppkey").cast("string")
    when = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit('<time datetime="2024-01-0'), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit('T08:00:00Z">x</time>'))).otherwise("")
    card = F.concat(F.lit('<li><div class="card new"><div><a href="../jobs/'), key, F.lit('?utm_medium=z">Job <i>'), key, F.lit('</i></a></div></div> <div class="card"><a href="/jobs/'), key, F.lit('#x"></a><p class="place"> Place '), (F.col("s_suppkey") % 7).cast("string"), F.lit(" </p>"), when, F.lit("</div></li>"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", card.alias("card")))), lambda x: x["card"]), "").alias("cards")
    firsts = s.withColumn("n", F.row_number().over(Window.partitionBy("board").orderBy("s_suppkey"))).where(F.col("n") <= TOP)
    tops = firsts.groupBy("board").agg(listed).withColumnRenamed("cards", "top")
    # Page ids of a board are its number and every fifth from there on.
    pages = _pages(spark, sf_dir).withColumn("board", F.col("page_id") % 5)
    rounds = F.greatest(F.floor((F.lit(pages.agg(F.max("page_id")).first()[0] or 0) - F.col("board")) / 5) + 1, F.lit(1))
    dealt = s.groupBy((F.pmod(F.xxhash64("s_suppkey"), rounds) * 5 + F.col("board")).alias("page_id")).agg(listed)
    pages = pages.join(F.broadcast(tops), "board", "left").join(dealt.hint("merge"), "page_id", "left")
    more = F.concat(F.lit("<ul>"), F.coalesce("top", F.lit("")), F.coalesce("cards", F.lit("")), F.lit('</ul><div class="pagination"><a class="next" href="?page='), (F.col("page_id") + 1).cast("string"), F.lit('">more</a></div>'))
    return pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), more))


def q_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _boards(spark, sf_dir)
    cards = blocks.newest_first(blocks.listing_cards(pages, BOARD)).select("page_id", "url", "title", "location", F.unix_timestamp("published_at").alias("published"), "place")
    return cards.join(blocks.next_pages(pages, BOARD), "page_id")


O_BOARD = """WITH s AS (SELECT page_id, s_suppkey k, row_number() OVER (PARTITION BY page_id ORDER BY s_suppkey) n FROM pages JOIN supplier ON s_nationkey % 5 = page_id % 5),
 c AS (SELECT *, CASE WHEN k % 3 > 0 THEN CAST(epoch(CAST('2024-01-0' || (k % 9 + 1) || ' 08:00:00' AS TIMESTAMP)) AS BIGINT) END published FROM s WHERE n <= 3),
 d AS (SELECT *, count(published) OVER (PARTITION BY page_id) = count(*) OVER (PARTITION BY page_id) dated FROM c)
 SELECT page_id, 'https://jobs.example.com/jobs/' || k url, 'Job ' || k title, 'Place ' || k % 7 AS location, published, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN dated THEN -published END, n) AS INTEGER) place,
 'https://jobs.example.com/list/' || page_id || '?page=' || (page_id + 1) next_url FROM d"""


def q_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings at several depths in a page's attribute, found by their keys."""
    p = table(spark, sf_dir, "part")
    job = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/jobs/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_size").alias("job_request"))
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.to_json(job)).when(k % 4 == 1, F.to_json(F.struct(F.array(F.struct(job.alias("inner"))).alias("list"), F.struct(F.col("p_name").alias("title")).alias("other"))))
    text = text.when(k % 4 == 2, F.to_json(F.array(F.array(F.array(F.array(F.struct(F.lit(1).alias("n"), F.struct(job.alias("more"), F.col("p_name").alias("title"), F.lit("u").alias("url"), F.lit(None).alias("job_request")).alias("deep")))))))).otherwise("{not json")
    more = F.concat(F.lit('<app-island opts="x" props="'), F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"></app-island>'))
    # Joined by a shuffle before the text is made, whose size estimates don't know.
    pages = table(spark, sf_dir, "pages").join(p.select("p_partkey", "p_name", "p_size").hint("merge"), F.col("page_id") == k).withColumn("html", F.concat(F.coalesce("html", F.lit("")), more))
    islands = blocks.select_blocks(pages, ["app-island[props]"]).select("page_id", F.col("attributes")["props"].alias("props"))
    found = blocks.json_objects(islands, "props", ["job_request", "title", "url"], f"{_scratch(spark)}/walk")
    get = lambda name: F.try_variant_get("found", f"$.{name}", "string")
    return found.select("page_id", get("title").alias("title"), get("url").alias("url"), get("job_request").alias("request"), F.size("at").alias("depth"))


O_OBJECTS = """WITH p AS (SELECT page_id, page_id % 4 k, p_name, p_size FROM pages JOIN part ON p_partkey = page_id)
 SELECT page_id, p_name title, '/jobs/' || page_id url, CAST(p_size AS VARCHAR) request, CAST([0, 3, 6][k + 1] AS INTEGER) AS depth FROM p WHERE k < 3"""


def q_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.page_descriptions(table(spark, sf_dir, "pages"), limit=None).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text"))


QUERIES = {"spec_menu": (q_menu, O_MENU), "spec_board": (q_board, O_BOARD), "json_objects": (q_objects, O_OBJECTS), "page_descriptions": (q_descriptions, None)}
