"""The relations of the domain as the driver's tables give them, with the same in SQL.

A notice is an order: its agency is the order's priority, its housing type and its optional columns
follow from the keys, so that every column that may be null is. Its children are line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.session import read_table

AS_OF = "1998-09-02"

NOTICE_SQL = """notice AS (
  SELECT o_orderkey AS id, o_orderpriority AS agency, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS posted_at,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) END AS apply_end,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 60 END AS announce,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 50 END AS source_rank,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS min_rent,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) END AS min_deposit,
    'type' || CAST(o_orderkey % 6 AS VARCHAR) AS housing_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'public' ELSE 'private' END AS sector,
    o_custkey, CAST(NULL AS BIGINT) AS nothing,
    CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1 END AS canonical_id,
    'province' || CAST(o_custkey % 5 AS VARCHAR) AS sido, CASE WHEN o_orderkey % 9 <> 0 THEN 'district' || CAST(o_orderkey % 4 AS VARCHAR) END AS sigungu
  FROM orders)"""

CLOSED_SQL = f"""((status = 'F') OR (apply_end IS NOT NULL AND apply_end < DATE '{AS_OF}')
  OR (announce IS NOT NULL AND announce < DATE '{AS_OF}'))"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return read_table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_orderpriority").alias("agency"),
        F.col("o_orderstatus").alias("status"),
        day.alias("posted_at"),
        F.when(key % 7 != 0, F.date_add(day, (key % 40).cast("int"))).alias("apply_end"),
        F.when(key % 5 != 0, F.date_add(day, 60)).alias("announce"),
        F.when(key % 3 != 0, F.col("o_custkey") % 50).alias("source_rank"),
        F.when(key % 11 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("min_rent"),
        F.when(key % 13 != 0, F.floor(F.col("o_totalprice") / 100)).alias("min_deposit"),
        F.concat(F.lit("type"), (key % 6).cast("string")).alias("housing_type"),
        F.when(key % 2 == 0, "public").otherwise("private").alias("sector"),
        "o_custkey",
        F.when(key % 17 == 0, key - 1).alias("canonical_id"),
        F.concat(F.lit("province"), (F.col("o_custkey") % 5).cast("string")).alias("sido"),
        F.when(key % 9 != 0, F.concat(F.lit("district"), (key % 4).cast("string"))).alias("sigungu"),
    )


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def closed() -> Column:
    """Closed by its status, its last day or its announcement; a null date says nothing."""
    past = [F.coalesce(F.col(c) < as_of(), F.lit(False)) for c in ("apply_end", "announce")]
    return (F.col("status") == "F") | past[0] | past[1]


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, dates as text, so that every client compares them alike."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in columns or df.columns])
