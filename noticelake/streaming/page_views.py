"""Visitor events as streams. Each stream, on bounded input, equals its batch twin; an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = "id long, visitor_id string, path string, referrer_host string, agent string, created_at timestamp"
#: The form of a visitor's id, and the names by which robots go.
VISITOR = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ROBOT_NAMES = (
    "bot\\b", "bot/", "crawler", "crawl(?:ing)?", "spider", "slurp", "yeti", "daumoa", "mediapartners", "adsbot", "facebookexternalhit", "embedly",
    "scrapy", "curl/", "wget", "python-requests", "python-urllib", "go-http-client", "okhttp", "java/", "libwww", "headless", "phantomjs",
    "puppeteer", "playwright", "selenium", "webdriver", "lighthouse", "pingdom", "uptimerobot", "gtmetrix", "semrush", "ahrefs", "mj12",
    "dotbot", "petalbot", "bytespider", "applebot", "amazonbot", "claudebot", "gptbot", "ccbot", "perplexity",
)
LEAST_AGENT, LONGEST_PATH, LONGEST_HOST = 10, 200, 100


def is_robot(agent: Column) -> Column:
    """Whether an agent is a robot by its name, or by having hardly any; people's browsers always send one."""
    short = F.length(F.trim(F.coalesce(agent, F.lit("")))) < LEAST_AGENT
    return short | F.coalesce(agent, F.lit("")).rlike("(?i)" + "|".join(ROBOT_NAMES))


def referrer(host: Column) -> Column:
    """A bare host name in lower case; null for anything with a path or white space in it."""
    name = F.substring(F.lower(F.trim(host)), 1, LONGEST_HOST)
    return F.when((name != "") & ~name.rlike(r"[\s/]"), name)


def valid_views(raw: DataFrame) -> DataFrame:
    """Views with a proper visitor and path; queries, fragments, robots and the back office are left out."""
    path = F.substring(F.regexp_replace("path", "(?s)[?#].*$", ""), 1, LONGEST_PATH)
    good = F.col("visitor_id").rlike(VISITOR) & F.col("path").startswith("/") & ~path.startswith("/admin")
    return raw.filter(~is_robot(F.col("agent")) & good).withColumn("path", path).withColumn("referrer_host", referrer(F.col("referrer_host")))


def daily_views(views: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Views per path and day in Korea; on a stream, days close when the watermark passes them."""
    shifted = views.withWatermark("created_at", lateness)
    return shifted.groupBy(F.window("created_at", "1 day", startTime="15 hours").alias("w"), "path").agg(F.count("*").alias("views")).select(
        F.to_date(F.from_utc_timestamp(F.col("w.start"), "Asia/Seoul")).alias("day"), "path", "views"
    )


def daily_visitors(views: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Distinct visitors per day: one event of each visitor and day passes, then events are counted."""
    day = F.window("created_at", "1 day", startTime="15 hours")
    once = views.withWatermark("created_at", lateness).withColumn("w", day).dropDuplicates(["visitor_id", "w"])
    return once.groupBy("w").agg(F.count("*").alias("visitors")).select(
        F.to_date(F.from_utc_timestamp(F.col("w.start"), "Asia/Seoul")).alias("day"), "visitors"
    )


def online_visitors(views: DataFrame, lateness: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Distinct visitors in windows of five minutes that start every minute.

    Sketches keep the state of a window small; ``exact`` keeps the visitors themselves, for windows that few visit.
    """
    recent = views.withWatermark("created_at", lateness)
    number = F.size(F.collect_set("visitor_id")).cast("long") if exact else F.approx_count_distinct("visitor_id")
    return recent.groupBy(F.window("created_at", "5 minutes", "1 minute").alias("w")).agg(number.alias("visitors")).select(F.col("w.start").alias("start"), "visitors")


def read_views(spark: SparkSession, folder: str, schema: str = VIEW) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)


def upsert_batches(target: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes snapshot after snapshot under ``target``.

    The snapshot of a batch is named by its number, so a batch that is run again writes the same one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{target}/v={number - 1}" if number else None
        old = spark.read.parquet(before) if before else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(f"{target}/v={number}")

    return write
