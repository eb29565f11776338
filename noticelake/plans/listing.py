"""Filtered, faceted and paged listings of notices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators.relational import SortKey, all_of, asc, desc, facets, from_cursor, keyset_page, union_tagged
from noticelake.plans.base import AS_OF, CLOSED_SQL, NOTICE_SQL, as_of, closed, notices, shown
from noticelake.registry import query

PAGE = 24


@dataclass(frozen=True)
class Filters:
    """Optional conditions of a listing; a type set to none does not filter."""

    sector: str | None = None
    agency: str | None = None
    housing_type: str | None = None
    sido: str | None = None
    sigungu: str | None = None
    max_deposit: int | None = None
    max_rent: int | None = None
    closing: bool = False
    include_closed: bool = False

    def predicates(self) -> list[Column]:
        out = [F.col("canonical_id").isNull()]
        # a district means something only within its province, as several provinces have one of the same name
        named = ("sector", "agency", "housing_type", "sido", *(["sigungu"] if self.sido is not None else []))
        for c in named:
            if getattr(self, c) is not None:
                out.append(F.col(c) == getattr(self, c))
        if self.max_deposit is not None:
            out.append(F.col("min_deposit") <= self.max_deposit)
        if self.max_rent is not None:
            out.append(F.col("min_rent") <= self.max_rent)
        if self.closing:
            out.append((F.col("apply_end") >= as_of()) & (F.col("apply_end") < F.date_add(as_of(), 7)))
        if not self.include_closed:
            out.append(~closed())
        return out


def deadline_rank() -> Column:
    """0 if it can still be applied for until a known day, 1 if that day or the notice is over, 2 without a day."""
    open_still = (F.col("apply_end") >= as_of()) & ~closed()
    return F.when(F.col("apply_end").isNull(), 2).when(open_still, 0).otherwise(1)


def deadline_key() -> Column:
    """The last day of what can still be applied for; null otherwise."""
    return F.when(deadline_rank() == 0, F.col("apply_end"))


def order_of(sort: str) -> list[SortKey]:
    """The order of a listing by its name; an unknown name is the newest first."""
    newest = SortKey(F.col("id"), "long", descending=True)
    if sort == "rent":
        return [SortKey(F.col("min_rent"), "long"), SortKey(F.col("min_deposit"), "long"), newest]
    posted = [SortKey(F.col("posted_at"), "date", descending=True), SortKey(F.col("source_rank"), "long"), newest]
    if sort == "deadline":
        last_day = SortKey(F.col("apply_end"), "date", descending=True)
        return [SortKey(deadline_rank(), "int"), SortKey(deadline_key(), "date"), last_day, *posted]
    return posted


def page(df: DataFrame, filters: Filters, sort: str, cursor: str | None = None, limit: int = PAGE) -> DataFrame:
    """One page of the listing and one row more, if there is one; an invalid cursor is the first page."""
    keys = order_of(sort)
    return keyset_page(df.filter(all_of(filters.predicates())), keys, from_cursor(keys, cursor), limit)


def page_after(df: DataFrame, filters: Filters, sort: str, *bounds: object) -> DataFrame:
    """The page behind the row with these keys."""
    keys = order_of(sort)
    at = [F.lit(v).cast(k.kind) for k, v in zip(keys, bounds, strict=True)]
    return keyset_page(df.filter(all_of(filters.predicates())), keys, at, PAGE)


COLUMNS = ["id", "agency", "posted_at", "apply_end", "min_rent", "min_deposit"]
COLUMNS_SQL = """id, agency, CAST(posted_at AS VARCHAR) AS posted_at, CAST(apply_end AS VARCHAR) AS apply_end, min_rent,
  min_deposit"""
POSTED_SQL = "posted_at DESC, source_rank ASC NULLS LAST, id DESC"
RANK_SQL = f"(CASE WHEN apply_end IS NULL THEN 2 WHEN apply_end >= DATE '{AS_OF}' AND NOT {CLOSED_SQL} THEN 0 ELSE 1 END)"
DEADLINE_SQL = f"""{RANK_SQL}, CASE WHEN {RANK_SQL} = 0 THEN apply_end END ASC NULLS LAST,
  apply_end DESC NULLS LAST, {POSTED_SQL}"""


@query(f"WITH {NOTICE_SQL} SELECT {COLUMNS_SQL} FROM notice WHERE canonical_id IS NULL AND NOT {CLOSED_SQL} ORDER BY {DEADLINE_SQL} LIMIT 25")
def keyset_page_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(page(notices(spark, sf_dir), Filters(), "deadline"), *COLUMNS)


# The twins number all rows in order and take those behind the first row that is not before the bounds.
def behind_sql(where: str, order: str, before: str) -> str:
    """The page behind the last row for which ``before`` holds, by numbering the whole list."""
    return f"""WITH {NOTICE_SQL}, listed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM notice WHERE canonical_id IS NULL AND {where})
SELECT {COLUMNS_SQL} FROM listed WHERE place > (SELECT coalesce(max(place), 0) FROM listed WHERE {before}) ORDER BY place LIMIT 25"""


PAST_SQL = f"""{RANK_SQL} = 0 OR ({RANK_SQL} = 1 AND (apply_end > DATE '1997-03-05' OR (apply_end = DATE '1997-03-05'
  AND (posted_at > DATE '1997-02-20' OR (posted_at = DATE '1997-02-20' AND (source_rank < 10 OR (source_rank = 10 AND id >= 500)))))))"""


@query(behind_sql("sector = 'public'", DEADLINE_SQL, PAST_SQL))
def keyset_page_deadline_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = Filters(sector="public", include_closed=True)
    return shown(page_after(notices(spark, sf_dir), chosen, "deadline", 1, None, "1997-03-05", "1997-02-20", 10, 500), *COLUMNS)


@query(behind_sql("min_deposit <= 2000", POSTED_SQL, """posted_at > DATE '1998-01-01' OR (posted_at = DATE '1998-01-01'
  AND (source_rank < 20 OR (source_rank = 20 AND id >= 3000)))"""))
def keyset_page_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = Filters(max_deposit=2000, include_closed=True)
    return shown(page_after(notices(spark, sf_dir), chosen, "posted", "1998-01-01", 20, 3000), *COLUMNS)


@query(behind_sql("true", "min_rent NULLS LAST, min_deposit NULLS LAST, id DESC",
                  "min_rent < 100 OR (min_rent = 100 AND (min_deposit < 1010 OR (min_deposit = 1010 AND id >= 700)))"))
def keyset_page_rent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(page_after(notices(spark, sf_dir), Filters(include_closed=True), "rent", 100, 1010, 700), *COLUMNS)


@query(behind_sql("true", "min_rent NULLS LAST, min_deposit NULLS LAST, id DESC",
                  "min_rent IS NOT NULL OR min_deposit < 1500 OR (min_deposit = 1500 AND id >= 0)"))
def keyset_page_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(page_after(notices(spark, sf_dir), Filters(include_closed=True), "rent", None, 1500, 0), *COLUMNS)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id < 5000 AND event_type = 'click' ORDER BY event_id DESC LIMIT 50")
def id_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.filter((F.col("event_id") < 5000) & (F.col("event_type") == "click"))
    return rows.orderBy(F.col("event_id").desc()).limit(50).select("event_id", "user_id", "event_type")


@query(f"""WITH {NOTICE_SQL} SELECT {COLUMNS_SQL} FROM notice WHERE id IN (1, 2, 3, 7, 14, 35, 70, 100, 101)
  ORDER BY {RANK_SQL}, CASE WHEN {RANK_SQL} = 0 THEN apply_end END ASC NULLS LAST, posted_at DESC, id DESC""")
def list_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).filter(F.col("id").isin(1, 2, 3, 7, 14, 35, 70, 100, 101))
    return shown(rows.orderBy(deadline_rank(), asc(deadline_key()), F.col("posted_at").desc(), F.col("id").desc()), *COLUMNS)


@query(f"WITH {NOTICE_SQL} SELECT {COLUMNS_SQL} FROM notice WHERE canonical_id IS NULL AND sector = 'public' AND agency = '2-HIGH' AND min_rent <= 200 AND NOT {CLOSED_SQL}")
def filter_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = Filters(sector="public", agency="2-HIGH", max_rent=200)
    return shown(notices(spark, sf_dir).filter(all_of(chosen.predicates())), *COLUMNS)


@query(f"""WITH {NOTICE_SQL}, base AS (SELECT * FROM notice WHERE canonical_id IS NULL AND NOT {CLOSED_SQL})
SELECT 'both' AS asked, id FROM base WHERE sido = 'province2' AND sigungu = 'district1' UNION ALL SELECT 'alone', id FROM base WHERE min_deposit <= 900 UNION ALL SELECT 'province', id FROM base WHERE sido = 'province4'""")
def filter_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By province and district, by a district alone, which does not filter, with a cap, and by a province."""
    chosen = {"both": Filters(sido="province2", sigungu="district1"), "alone": Filters(sigungu="district1", max_deposit=900), "province": Filters(sido="province4")}
    rows = notices(spark, sf_dir)
    return union_tagged({k: rows.filter(all_of(f.predicates())).select("id") for k, f in chosen.items()}, "asked")


@query(f"WITH {NOTICE_SQL} SELECT id, {CLOSED_SQL} AS closed FROM notice")
def closed_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", closed().alias("closed"))


@query(f"WITH {NOTICE_SQL} SELECT id, CAST(apply_end AS VARCHAR) AS apply_end FROM notice WHERE apply_end >= DATE '{AS_OF}' AND apply_end < DATE '{AS_OF}' + 7")
def closing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    return shown(rows.filter((F.col("apply_end") >= as_of()) & (F.col("apply_end") < F.date_add(as_of(), 7))), "id", "apply_end")


@query(f"WITH {NOTICE_SQL} SELECT id, {RANK_SQL} AS deadline_rank, CAST(CASE WHEN {RANK_SQL} = 0 THEN apply_end END AS VARCHAR) AS deadline_key FROM notice")
def case_rank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = deadline_rank()
    return notices(spark, sf_dir).select(
        "id", rank.alias("deadline_rank"), deadline_key().cast("string").alias("deadline_key")
    )


FACET_SQL = f"""WITH {NOTICE_SQL}, base AS (SELECT * FROM notice WHERE canonical_id IS NULL AND NOT {CLOSED_SQL})
SELECT 'sector' AS kind, sector AS value, count(*) AS n FROM base WHERE agency = '2-HIGH' AND housing_type = 'type1' GROUP BY sector
UNION ALL SELECT 'agency', agency, count(*) FROM base WHERE sector = 'private' AND housing_type = 'type1' GROUP BY agency
UNION ALL SELECT 'housing_type', housing_type, count(*) FROM base WHERE sector = 'private' AND agency = '2-HIGH' GROUP BY housing_type"""


@query(FACET_SQL)
def facets_drill_sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {"sector": "private", "agency": "2-HIGH", "housing_type": "type1"}
    axes = {c: (F.col(c), F.col(c) == v) for c, v in chosen.items()}
    return facets(notices(spark, sf_dir), axes, F.col("canonical_id").isNull() & ~closed())


@query(f"""WITH {NOTICE_SQL}, base AS (SELECT * FROM notice WHERE canonical_id IS NULL AND NOT {CLOSED_SQL})
SELECT 'sector' AS kind, sector AS value, count(*) AS n FROM base GROUP BY sector
UNION ALL SELECT 'type', housing_type, count(*) FROM base WHERE sector = 'public' GROUP BY housing_type ORDER BY kind, n DESC, value""")
def union_all_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = notices(spark, sf_dir).filter(F.col("canonical_id").isNull() & ~closed())

    def counted(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))

    parts = {"sector": counted(base, "sector"), "type": counted(base.filter("sector = 'public'"), "housing_type")}
    return union_tagged(parts).orderBy("kind", F.col("n").desc(), "value")


@query(f"""WITH {NOTICE_SQL} SELECT housing_type, count(*) AS total, count(*) FILTER (WHERE NOT {CLOSED_SQL}) AS open_n,
  count(DISTINCT agency) AS agencies FROM notice WHERE canonical_id IS NULL GROUP BY housing_type ORDER BY total DESC""")
def hub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).filter("canonical_id IS NULL")
    return rows.groupBy("housing_type").agg(
        F.count("*").alias("total"), F.count_if(~closed()).alias("open_n"), F.countDistinct("agency").alias("agencies")
    ).orderBy(F.col("total").desc())


@query(f"""WITH {NOTICE_SQL} SELECT id, agency, CAST(posted_at AS VARCHAR) AS posted_at, {CLOSED_SQL} AS closed FROM notice WHERE canonical_id IS NULL
  ORDER BY closed, {POSTED_SQL} LIMIT 30""")
def landing_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).filter("canonical_id IS NULL").withColumn("closed", closed())
    return shown(rows.orderBy("closed", *[k.order() for k in order_of("posted")]).limit(30), "id", "agency", "posted_at", "closed")


@query(f"WITH {NOTICE_SQL} SELECT id, CAST(posted_at AS VARCHAR) AS posted_at, source_rank FROM notice ORDER BY {POSTED_SQL} LIMIT 100")
def order_nulls_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(notices(spark, sf_dir).orderBy(*[k.order() for k in order_of("posted")]).limit(100), "id", "posted_at", "source_rank")


@query(f"WITH {NOTICE_SQL} SELECT id, CAST(apply_end AS VARCHAR) AS apply_end FROM notice ORDER BY apply_end DESC NULLS FIRST, id LIMIT 100")
def order_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(notices(spark, sf_dir).orderBy(desc("apply_end"), "id").limit(100), "id", "apply_end")


@query(f"WITH {NOTICE_SQL} SELECT id, agency FROM notice ORDER BY list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], agency) NULLS LAST, id LIMIT 100")
def enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.nullif(F.array_position(F.array(*map(F.lit, ("3-MEDIUM", "1-URGENT", "5-LOW"))), F.col("agency")), F.lit(0))
    return notices(spark, sf_dir).orderBy(asc(place), "id").limit(100).select("id", "agency")


@query("SELECT p_partkey, p_name FROM part ORDER BY TRY_CAST(nullif(regexp_replace(p_name, '[^0-9]', '', 'g'), '') AS BIGINT) NULLS LAST, p_partkey LIMIT 50")
def numeric_in_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.nullif(F.regexp_replace("p_name", "[^0-9]", ""), F.lit("")).try_cast("long")
    return spark.read.parquet(f"{sf_dir}/part.parquet").orderBy(asc(number), "p_partkey").limit(50).select("p_partkey", "p_name")
