"""Announcement pages: listing stubs, prose, rough rows by patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text, values
from ..registry import BRANCHES


def parse_listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """Stubs in the order of a page: tags that carry an article id and are of the one content type, their three attributes decoded, the title's date."""
    tags = pages.select("page", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)(<[^>]*article-id=.*?>)"), 1)).alias("position", "tag")).where(F.col("tag").contains('content-type-name="Contracts"'))
    found = tags.select("page", "position", *[F.regexp_extract("tag", rf'{a}="({v})"', 1).alias(n) for a, v, n in (("article-id", r"\d+", "announcement_id"), ("article-title", '[^"]*', "raw_title"), ("article-url", '[^"]*', "raw_url"))], F.col("tag").rlike('article-title="').alias("t"), F.col("tag").rlike('article-url="').alias("u"))
    named = found.where("announcement_id <> '' AND t AND u").select("page", "position", "announcement_id", text.unescape("raw_title").alias("title"), text.unescape("raw_url").alias("url"))
    return named.withColumn("announced_date", text.title_date(F.col("title")))


def prose_markup(html: Column) -> Column:
    """The part of a page that holds the prose, tags turned into newlines, references still encoded."""
    h = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    body = F.regexp_replace(h, r'(?is)\A.*?<div[^>]*class="[^"]*\bbody\b[^"]*"[^>]*>(.*?)</div>\s*</div>.*\z', "$1")
    return F.regexp_replace(body, r"<[^>]+>", "\n")


def tidy_prose(decoded: Column) -> Column:
    """Blanks collapsed, empty lines dropped, cut to the first service header if there is one."""
    t = F.regexp_replace(decoded, r"[ \t\x{A0}]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\n[\s\x{A0}]*\n+", "\n"), r"^\s+|\s+\z", "")
    head = r"(?dms)^\s*(?:ARMY|NAVY|AIR FORCE|DEFENSE|SPACE FORCE|MARINE).*"
    return F.when(t.rlike(head), F.regexp_extract(t, f"({head})", 1)).otherwise(t)


def body_text(pages: DataFrame, html: str = "html", decode: Callable[[Column], Column] = text.unescape) -> DataFrame:
    """``pages`` with ``prose`` instead of ``html``; ``decode`` turns references into characters."""
    decoded = pages.withColumn("prose", decode(prose_markup(F.coalesce(html, F.lit("")))))
    return decoded.withColumn("prose", tidy_prose(F.col("prose"))).drop(html)


def scan_lines(docs: DataFrame) -> DataFrame:
    """Rough rows of prose (announcement_id, prose), a line each, under the last branch header before it."""
    lines = docs.select("announcement_id", F.posexplode(F.split("prose", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    head = F.nullif(F.regexp_extract("line", text.BRANCH_LINE, 1), F.lit(""))
    w = Window.partitionBy("announcement_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    under = lines.withColumn("head", head).withColumn("branch", F.last("head", ignorenulls=True).over(w))
    rows = under.where(F.col("head").isNull() & F.substring("line", 1, 400).rlike(text.AWARD)).withColumn("ordinal", F.row_number().over(Window.partitionBy("announcement_id").orderBy("at")) - 1)
    some = lambda p, g=1: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    name = F.coalesce(F.trim(some(text.NAME)), F.lit("unknown"))
    money, unit = (F.regexp_extract("money", text.DOLLARS, k) for k in (1, 2))
    action = F.when(F.col("line").rlike(text.MODIFICATION), "modification").when(F.col("line").rlike(text.OPTION), "option_exercise").otherwise("new_award")
    return rows.withColumn("money", some(text.DOLLARS, 0)).select(
        keys.award_uid(F.col("announcement_id"), F.lit(""), name, F.col("ordinal")).alias("award_uid"), "announcement_id", F.when(F.col("branch").isin(BRANCHES), F.col("branch")).otherwise("OTHER").alias("service_branch"), name.alias("contractor_raw"),
        values.dollars_with_unit(money, unit).alias("amount_usd"), action.alias("action_type"), some(text.MOD_NUMBER).alias("modification_number"), F.col("line").rlike(text.IDIQ).alias("is_idiq"), F.col("line").rlike(text.MULTI).alias("is_multi_award"),
        F.col("line").rlike(text.STAR).alias("small_business"), some(text.BIDS).cast("int").alias("bids_received"), F.substring("line", 1, 600).alias("work_description"), F.lit(0.5).alias("extraction_confidence"),
    )


def scan_names(pages: DataFrame, html: str = "html") -> DataFrame:
    """Contractor names of paragraphs that look like awards, counted without regard to case, in the spelling seen first."""
    paras = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1)).alias("at", "para"))
    flat = paras.withColumn("para", F.trim(F.regexp_replace(text.unescape(F.regexp_replace("para", r"<[^>]+>", "")), r"[\s\x{A0}]+", " "))).where(F.substring("para", 1, 400).rlike(text.AWARD))
    named = flat.withColumn("name", F.trim(F.regexp_extract("para", text.PLAIN_NAME, 1))).where((F.col("name") != "") & (F.size(F.split("name", r"\s+")) <= 12) & F.col("name").rlike("[A-Za-z]{3}"))
    return named.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("page_id", "at")).alias("name"), F.count("*").alias("n"))
