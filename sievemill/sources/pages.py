"""Records hidden in sitemaps, scripts, tables and JSON-LD of pages; daily files; reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.text import squash
from sievemill.sources.feeds import read_jsonl_window

_DAY = r"(\d{4}-\d{2}-\d{2})\.jsonl?$"


def read_daily_ledger(spark: SparkSession, path: str, start: str, end: str, time_field: str = "timestamp") -> DataFrame:
    """``read_jsonl_window`` over the daily files of a folder whose name lies in start..end.

    Files with other names are always read. Only names are listed to choose; a folder without
    files in the window gives no rows.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [str(f.getPath()) for f in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs) if f.isFile()]
    import re

    day = lambda f: (re.search(_DAY, f) or [None, None])[1]
    wanted = [f for f in files if day(f) is None or start[:10] <= day(f) <= end[:10]]
    if not wanted:
        return spark.createDataFrame([], "value string, ts timestamp, state string")
    return read_jsonl_window(spark, wanted, start, end, time_field)


def write_report(df: DataFrame, path: str, day: str) -> None:
    """Write a report as the copy of its day and as the latest one; both replace what was there."""
    df = df.cache()
    df.write.mode("overwrite").json(f"{path}/{day}")
    df.write.mode("overwrite").json(f"{path}/latest")
    df.unpersist()


def drop_old_partitions(spark: SparkSession, path: str, days: int, today: str) -> list[str]:
    """Delete the dated folders and files below ``path`` older than ``days``; the names deleted.

    What bears no date, ``latest`` among it, stays.
    """
    import datetime
    import re

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    limit, gone = datetime.date.fromisoformat(today) - datetime.timedelta(days=days), []
    for f in fs.listStatus(folder):
        found = re.fullmatch(r"(?:ds=)?(\d{4}-\d{2}-\d{2})(?:\.\w+)?", f.getPath().getName())
        try:
            old = bool(found) and datetime.date.fromisoformat(found[1]) < limit
        except ValueError:
            old = False
        if old:
            fs.delete(f.getPath(), True)
            gone.append(f.getPath().getName())
    return sorted(gone)


def _text(html: Column) -> Column:
    plain = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    return squash(plain)


def parse_sitemap_slugs(raw: DataFrame, roles: list[str]) -> DataFrame:
    """Sitemap bodies to (url, id, slug, company, title).

    An address ends in ``/id/slug``. A month mark such as ``-oct23`` is cut off; the slug is split
    at the first word of ``roles`` behind its first word, and both parts get capitals.
    """
    url = raw.select(F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"))).alias("url")).distinct()
    rows = url.select("url", F.regexp_extract("url", r"/(\d+)/[^/]+/?$", 1).alias("id"), F.regexp_replace(F.regexp_extract("url", r"/\d+/([^/]+)/?$", 1), r"-[a-z]{3}\d{2}$", "").alias("slug")).where("id <> ''")
    words = F.split("slug", "-")
    hit = F.array_min(F.filter(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*roles), i)), lambda i: i.isNotNull()))
    at = F.coalesce(hit, F.lit(0))
    return rows.select("url", "id", "slug", F.initcap(F.array_join(F.slice(words, F.lit(1), at), " ")).alias("company"), F.initcap(F.array_join(F.slice(words, at + 1, F.size(words)), " ")).alias("title"))


def parse_embedded_json(pages: DataFrame, schema: str, items: str, mark: str = "JSON.parse") -> DataFrame:
    """(page_id, item) of the list ``items`` in a script's string that holds JSON, encoded twice."""
    inner = F.regexp_extract("html", rf'(?s)\Q{mark}\E\(\s*("(?:[^"\\]|\\.)*+")\s*\)', 1)
    decoded = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")[0]
    return pages.select("page_id", F.explode(F.from_json(decoded, schema)[items]).alias("item"))


def extract_html_table(pages: DataFrame, n: int, prefix: str, cells: int = 4) -> DataFrame:
    """(page_id, row, values) of the page's ``n``-th table: rows of enough cells, the first with ``prefix``."""
    table = F.try_element_at(F.regexp_extract_all("html", F.lit(r"(?is)(<table\b.*?</table\s*>)")), F.lit(n))
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)(<tr\b.*?)(?=<tr\b|</tr|</table)"))).alias("row", "tr"))
    values = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dhr]|$)")), _text)
    return rows.select("page_id", "row", values.alias("values")).where((F.size("values") >= cells) & F.get("values", F.lit(0)).startswith(prefix))


_POSTING = "`@type`: string, title: string, description: string, hiringOrganization: struct<name: string>, jobLocation: struct<address: struct<addressLocality: string, addressRegion: string>>"


def extract_jsonld(pages: DataFrame, wanted: str = "JobPosting") -> DataFrame:
    """(page_id, organisation, locality, region, description) of the first JSON-LD object of a type.

    Blocks are objects, lists, or objects with a ``@graph``; blocks that don't parse are skipped.
    """
    block = F.trim(F.col("block"))
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script"))).alias("pos", "block"))
    parsed = F.from_json(F.when(block.startswith("["), block).otherwise(F.concat(F.lit("["), block, F.lit("]"))), f"array<struct<{_POSTING}, `@graph`: array<struct<{_POSTING}>>>>")
    fields = ("@type", "title", "description", "hiringOrganization", "jobLocation")
    own = F.transform(parsed, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    below = F.flatten(F.transform(F.filter(parsed, lambda x: x["@graph"].isNotNull()), lambda x: x["@graph"]))
    rows = blocks.select("page_id", "pos", F.posexplode(F.concat(own, below)).alias("at", "o")).where(F.col("o.@type").contains(wanted))
    first = rows.groupBy("page_id").agg(F.min_by("o", F.struct("pos", "at")).alias("o"))
    return first.select("page_id", F.col("o.hiringOrganization.name").alias("organisation"), F.col("o.jobLocation.address.addressLocality").alias("locality"), F.col("o.jobLocation.address.addressRegion").alias("region"), F.col("o.description").alias("description"))


def extract_description(pages: DataFrame, blocks: list[str], known: str | None = None, limit: int = 12_000, least: int = 50) -> DataFrame:
    """(page_id, text): the best description of a page.

    ``blocks`` are patterns of opening tags, tried in order; the longest block of the first that
    gives over ``least`` characters counts, else article, main or body. A longer JSON-LD description
    wins. ``limit`` characters are kept, as of the source's rule; shorter finds keep ``known``.
    """
    clean = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(nav|header|footer|aside|form|button)\b.*?</\1\s*>", " ")
    longest = lambda c: F.element_at(F.array_sort(F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))), F.transform(c, lambda h: F.struct(F.length(_text(h)).alias("n"), _text(h).alias("t"))))), -1)["t"]
    text = F
    for p in blocks:
        found = longest(F.regexp_extract_all(clean, F.lit(rf"(?is){p}(.*?)</(?:div|section|article)\s*>"), F.lit(1)))
        text = text.when(F.length(found) > least, found)
    for tag in ("article", "main", "body"):
        found = longest(F.regexp_extract_all(clean, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)))
        text = text.when(F.length(found) > least, found)
    rows = pages.join(extract_jsonld(pages).select("page_id", F.col("description").alias("__ld")), "page_id", "left")
    best, ld = F.coalesce(text.otherwise(""), F.lit("")), _text(F.coalesce("__ld", F.lit("")))
    best = F.substring(F.when(F.length(ld) > F.length(best), ld).otherwise(best), 1, limit)
    return rows.select("page_id", F.when(F.length(best) > least, best).otherwise(F.coalesce(F.col(known), F.lit("")) if known else F.lit("")).alias("text"))
