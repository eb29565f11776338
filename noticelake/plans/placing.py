"""The reference of places, names of dwellings, areas and schedules, and saved items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions.geo import to_degrees
from noticelake.operators.relational import distinct_on
from noticelake.plans.base import NOTICE_SQL, line_items, notices, shown
from noticelake.registry import query
from noticelake.session import read_table


@query("""WITH r AS (SELECT l_partkey, l_linenumber, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey DESC, l_suppkey DESC) AS rn FROM lineitem)
SELECT l_partkey, l_linenumber, l_suppkey FROM r WHERE rn = 1 AND l_returnflag <> 'R'""")
def reference_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all records of a place, in the order of their files, the last one holds; if that one deletes, the place goes."""
    last = distinct_on(line_items(spark, sf_dir), ["l_partkey", "l_linenumber"], [F.col("l_orderkey").desc(), F.col("l_suppkey").desc()])
    return last.filter("l_returnflag <> 'R'").select("l_partkey", "l_linenumber", "l_suppkey")


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(round(CAST(avg(c_custkey) AS DECIMAL(28,8)), 4) AS DECIMAL(18,4))::DOUBLE AS lon,
CAST(round(CAST(avg(c_custkey % 90) AS DECIMAL(28,8)), 4) AS DECIMAL(18,4))::DOUBLE AS lat FROM customer GROUP BY 1, 2""")
def dong_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mean(column: Column) -> Column:
        return F.round(F.avg(column).cast("decimal(28,8)"), 4).cast("double")

    return read_table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count("*").alias("n"), mean(F.col("c_custkey")).alias("lon"), mean(F.col("c_custkey") % 90).alias("lat")
    )


@query()
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers placed on the national grid, in degrees."""
    k = F.col("c_custkey")
    point = to_degrees((950_000 + k % 1000 * 100).cast("double"), (1_900_000 + k % 777 * 200).cast("double"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", point.alias("p")).select("c_custkey", "p.lon", "p.lat")


@query("""WITH d AS (SELECT p_partkey, p_brand || ' ' || p_type AS name FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS i FROM d)
SELECT p_partkey, CASE WHEN n > 1 THEN name || ' (' || CAST(i AS VARCHAR) || ')' ELSE name END AS name FROM c""")
def dwelling_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several dwellings share are told apart by their place in the list."""
    d = read_table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    same = Window.partitionBy("name")
    numbered = d.withColumn("n", F.count("*").over(same)).withColumn("i", F.row_number().over(same.orderBy("p_partkey")))
    told = F.concat("name", F.lit(" ("), F.col("i").cast("string"), F.lit(")"))
    return numbered.select("p_partkey", F.when(F.col("n") > 1, told).otherwise(F.col("name")).alias("name"))


@query(f"""WITH {NOTICE_SQL}, s AS (SELECT id, posted_at, CASE WHEN id % 4 = 0 THEN apply_end - 365 WHEN id % 9 = 0 THEN apply_end - 900 ELSE apply_end END AS first_day FROM notice)
SELECT id, CAST(CASE WHEN first_day >= posted_at - 3 THEN first_day WHEN CAST(first_day + INTERVAL 12 MONTH AS DATE) >= posted_at - 3 THEN CAST(first_day + INTERVAL 12 MONTH AS DATE) END AS VARCHAR) AS first_day FROM s""")
def schedule_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first day long before the posting is taken for one of the next year; if that does not help either, it is dropped."""
    case, end = F.col("id"), F.col("apply_end")
    read = F.when(case % 4 == 0, F.date_sub(end, 365)).when(case % 9 == 0, F.date_sub(end, 900)).otherwise(end)
    least, later = F.date_sub("posted_at", 3), F.add_months("read", 12)
    fixed = F.when(F.col("read") >= least, F.col("read")).when(later >= least, later)
    return shown(notices(spark, sf_dir).withColumn("read", read).select("id", fixed.alias("first_day")))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_partkey % 9000 + 300 AS BIGINT) AS VARCHAR) AS digits FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE length(digits) WHEN 4 THEN CAST(digits AS BIGINT) / 100.0::DOUBLE WHEN 3 THEN CAST(digits AS BIGINT) / 10.0::DOUBLE END AS area,
CASE WHEN length(digits) = 3 THEN 'narrow' WHEN CAST(digits AS BIGINT) <= 4000 THEN 'to40' WHEN CAST(digits AS BIGINT) < 6000 THEN 'to60' ELSE 'over60' END AS band FROM a""")
def area_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas whose point was lost: four digits have two decimals, three have one."""
    digits = (F.col("l_partkey") % 9000 + 300).cast("string")
    number, size = digits.cast("long"), F.length(digits)
    area = F.when(size == 4, number / F.lit(100.0)).when(size == 3, number / F.lit(10.0))
    band = F.when(size == 3, "narrow").when(number <= 4000, "to40").when(number < 6000, "to60").otherwise("over60")
    return line_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", area.alias("area"), band.alias("band"))


@query(f"""WITH {NOTICE_SQL}, saved AS (SELECT DISTINCT l_suppkey AS person, l_orderkey AS id FROM lineitem WHERE l_orderkey > 0)
SELECT s.id, n.agency, count(*) AS people FROM saved s JOIN notice n ON n.id = s.id GROUP BY 1, 2 ORDER BY people DESC, s.id DESC LIMIT 20""")
def top_saved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = line_items(spark, sf_dir).select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("id")).filter("id > 0").distinct()
    # counted before the join, so that only one row of an item meets its notice
    counted = saved.groupBy("id").agg(F.count("*").alias("people"))
    return counted.join(notices(spark, sf_dir).select("id", "agency"), "id").orderBy(F.col("people").desc(), F.col("id").desc()).limit(20).select("id", "agency", "people")


@query("""WITH s AS (SELECT l_suppkey AS person, l_orderkey AS item FROM lineitem WHERE l_linenumber <= 2), new AS (SELECT DISTINCT l_suppkey AS person, l_partkey AS item FROM lineitem WHERE l_linenumber = 3),
known AS (SELECT n.* FROM new n WHERE n.item IN (SELECT o_orderkey FROM orders)) SELECT person, item FROM s UNION SELECT person, item FROM known""")
def saved_items_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items saved on a device join those of the account: only items that exist, each once."""
    li = line_items(spark, sf_dir)
    old = li.filter("l_linenumber <= 2").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("item"))
    new = li.filter("l_linenumber = 3").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("item"))
    there = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    return old.unionByName(new.join(there, "item", "left_semi").select("person", "item")).distinct()


# Longer terms first, so that a term within another is not cut out of it.
TERMS = ["PROMO STEEL", "STEEL", "PROMO", "SMALL"]


@query(r"""SELECT p_partkey, array_to_string(regexp_extract_all(p_type, 'PROMO STEEL|STEEL|PROMO|SMALL'), ',') AS terms, regexp_replace(p_type, 'PROMO STEEL|STEEL|PROMO|SMALL', '<>', 'g') AS rest FROM part""")
def glossary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "|".join(sorted(TERMS, key=lambda t: (-len(t), TERMS.index(t))))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.regexp_extract_all("p_type", F.lit(pattern), F.lit(0)), ",").alias("terms"),
        F.regexp_replace("p_type", pattern, "<>").alias("rest"),
    )
