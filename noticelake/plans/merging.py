"""Merges of links, snapshots, coordinates and rule tables, and projections of estates and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import money
from noticelake.operators import merge
from noticelake.operators.relational import SortKey
from noticelake.plans.base import NOTICE_SQL, line_items, notices
from noticelake.registry import query
from noticelake.session import read_table


@query("""WITH old AS (SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || CAST(o_custkey AS VARCHAR) END AS code FROM orders),
e AS (SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || CAST(o_custkey AS VARCHAR) END AS code FROM orders WHERE o_orderkey % 2 = 0)
SELECT old.slug, CASE WHEN e.slug IS NOT NULL THEN e.code ELSE old.code END AS code, old.code IS DISTINCT FROM CASE WHEN e.slug IS NOT NULL THEN e.code ELSE old.code END AS changed FROM old LEFT JOIN e USING (slug)""")
def scoped_link_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.concat(F.lit("c"), F.col("o_custkey")).alias("code"))
    old = o.withColumn("code", F.when(F.col("slug") % 3 == 0, F.col("code")))
    return merge.update_evaluated(old, o.filter("slug % 4 = 0"), o.filter("slug % 2 = 0"), "slug", "code")


@query("""WITH old AS (SELECT l_partkey AS complex, l_returnflag AS unit, CAST(l_shipdate AS VARCHAR) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS waiting FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2, 3),
new AS (SELECT l_partkey AS complex, l_returnflag AS unit, CAST(l_shipdate AS VARCHAR) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS waiting FROM lineitem WHERE l_linenumber >= 5 GROUP BY 1, 2, 3)
SELECT coalesce(o.complex, n.complex) AS complex, coalesce(o.unit, n.unit) AS unit, coalesce(o.day, n.day) AS day, coalesce(n.waiting, o.waiting) AS waiting
FROM old o FULL JOIN new n ON o.complex = n.complex AND o.unit = n.unit AND o.day = n.day""")
def waitlist_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey days are part of the key, so each day keeps its own numbers."""
    keys = ["complex", "unit", "day"]

    def counted(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("l_partkey").alias("complex"), F.col("l_returnflag").alias("unit"), F.col("l_shipdate").cast("string").alias("day"), "l_quantity")
        return named.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("long")).alias("waiting"))

    li = line_items(spark, sf_dir)
    return merge.upsert(counted(li.filter("l_linenumber < 5")), counted(li.filter("l_linenumber >= 5")), keys).drop("inserted", "changed")


@query("""WITH t AS (SELECT c_custkey AS id, c_address AS address, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS lat FROM customer),
m AS (SELECT c_custkey AS id, c_custkey * 0.5::DOUBLE AS lon, c_custkey * 0.25::DOUBLE AS lat, CASE WHEN c_custkey % 3 = 0 THEN 'road' ELSE 'building' END AS precision FROM customer WHERE c_custkey % 2 = 0)
SELECT t.id, coalesce(m.lon, t.lon) AS lon, coalesce(m.lat, t.lat) AS lat, m.precision FROM t LEFT JOIN m USING (id)""".replace(", c_address AS address", ""))
def geo_result_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a geocoding run found is written to the places; those it missed keep what they had."""
    k = F.col("c_custkey")
    c = read_table(spark, sf_dir, "customer")
    empty = F.lit(None)
    places = c.select(k.alias("id"), empty.cast("double").alias("lon"), empty.cast("double").alias("lat"), empty.cast("string").alias("precision"))
    found = c.filter(k % 2 == 0).select(
        k.alias("id"), (k * 0.5).alias("lon"), (k * 0.25).alias("lat"), F.when(k % 3 == 0, "road").otherwise("building").alias("precision")
    )
    return merge.upsert(places, found, ["id"]).drop("inserted", "changed")


@query("""SELECT p_size AS household, p_partkey % 4 AS year, count(*) AS n FROM part WHERE p_partkey % 4 <> 2 GROUP BY 1, 2
UNION ALL SELECT p_size, 2, -count(*) FROM part WHERE p_size < 10 GROUP BY 1""")
def rule_table_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year of a rule table is replaced by its seed; other years stay."""
    part = read_table(spark, sf_dir, "part")
    old = part.groupBy(F.col("p_size").alias("household"), (F.col("p_partkey") % 4).alias("year")).agg(F.count("*").alias("n"))
    seed = part.filter("p_size < 10").groupBy(F.col("p_size").alias("household")).agg((-F.count("*")).alias("n"))
    return merge.sync(old, seed.withColumn("year", F.lit(2).cast("long")), F.col("year") == 2)


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS town, c_mktsegment AS dong, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::DOUBLE END AS lon FROM customer),
d AS (SELECT town, dong, round(CAST(avg(id) AS DECIMAL(28,8)), 4)::DOUBLE AS lon FROM a GROUP BY 1, 2)
SELECT a.id, coalesce(a.lon, CASE WHEN a.id % 5 <> 0 THEN d.lon END) AS lon, CASE WHEN a.lon IS NOT NULL THEN 'road' WHEN a.id % 5 <> 0 THEN 'dong' END AS precision FROM a JOIN d USING (town, dong)""")
def dong_centre_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without a point get the centre of their quarter, if the address names all of province, town and quarter."""
    k = F.col("c_custkey")
    a = read_table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("town"), F.col("c_mktsegment").alias("dong"), F.when(k % 3 == 0, k.cast("double")).alias("lon")
    )
    centres = a.groupBy("town", "dong").agg(F.round(F.avg("id").cast("decimal(28,8)"), 4).cast("double").alias("centre"))
    named = a.withColumn("dong", F.when((F.col("id") % 5 != 0) & F.col("lon").isNull(), F.col("dong")))
    met = named.join(centres, ["town", "dong"], "left")
    precision = F.when(F.col("lon").isNotNull(), "road").when(F.col("centre").isNotNull(), "dong")
    return met.select("id", F.coalesce("lon", "centre").alias("lon"), precision.alias("precision"))


@query()
def korean_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in the order of Korean readers: by ICU's collation, not by code points."""
    names = F.array(*map(F.lit, ("나무", "가람", "apple", "Banana", "하늘", "1단지")))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", names[F.col("p_partkey") % 6].alias("name"))
    key = SortKey(F.collate("name", "ko"), "string")
    return rows.orderBy(key.order(), "p_partkey").limit(100)


AREA_SQL = "CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,4)) END AS a, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DECIMAL(18,4)) END AS b"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN CAST(round(coalesce(a, 0) + coalesce(b, 0), 2) AS DOUBLE) END AS common_area
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {AREA_SQL} FROM lineitem)""")
def common_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    area = money.common_area(F.when(n % 3 != 0, F.col("l_extendedprice")), F.when(n % 2 == 0, F.col("l_tax")))
    return line_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", area.alias("common_area"))


PRICE_SQL = """WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS d, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS r,
CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 2 * 500 END AS md, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + o_orderkey % 10 END AS mr,
CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 7 * 10 END AS down, CASE WHEN o_orderkey % 12 = 0 THEN o_orderkey % 5 * 10 END AS interim, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 11 * 10 END AS balance FROM orders),
g AS (SELECT *, coalesce(down, 0) <= 0 AND coalesce(interim, 0) <= 0 AND coalesce(balance, 0) <= 0 AND r IS NULL AND d IS NOT NULL AS guessed FROM n)
SELECT id, 'base' AS "row", d AS deposit, r AS rent FROM g UNION ALL SELECT id, 'down', down, NULL FROM g WHERE down > 0 UNION ALL SELECT id, 'interim', interim, NULL FROM g WHERE interim > 0
UNION ALL SELECT id, 'balance', balance, NULL FROM g WHERE balance > 0 UNION ALL SELECT id, 'down-est', CAST(floor(d / 10.0 + 0.5) AS BIGINT), NULL FROM g WHERE guessed
UNION ALL SELECT id, 'balance-est', CAST(floor(d * 9 / 10.0 + 0.5) AS BIGINT), NULL FROM g WHERE guessed
UNION ALL SELECT id, 'max', coalesce(md, d), coalesce(mr, r) FROM g WHERE (md IS NOT NULL AND md IS DISTINCT FROM d) OR (mr IS NOT NULL AND mr IS DISTINCT FROM r)"""


@query(PRICE_SQL)
def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price rows of each notice: base, payments as stated or a tenth and nine tenths, and the most."""
    k, d, c = F.col("o_orderkey"), F.floor("o_totalprice"), F.col("o_custkey")
    rows = money.price_rows(
        F.when(k % 13 != 0, d), F.when(k % 3 != 0, c), F.when(k % 4 != 0, d + k % 2 * 500), F.when(k % 5 == 0, c + k % 10),
        F.when(k % 6 == 0, k % 7 * 10), F.when(k % 12 == 0, k % 5 * 10), F.when(k % 6 == 0, k % 11 * 10),
    )
    return read_table(spark, sf_dir, "orders").select(k.alias("id"), F.inline(rows))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 OR l_linenumber % 2 = 0 THEN CAST(round(CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END
 + CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DECIMAL(18,4)) ELSE 0 END, 2) AS DOUBLE) END AS common_area,
CAST(floor(CAST(l_quantity AS BIGINT) * 10000 / 10.0 + 0.5) AS BIGINT) AS low, CAST(floor(CAST(l_quantity AS BIGINT) * 10000 * 9 / 10.0 + 0.5) AS BIGINT) AS high FROM lineitem""")
def common_areas_and_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared areas, and the tenth and nine tenths that a deposit without stated payments is paid in."""
    n, none = F.col("l_linenumber"), F.lit(None).cast("long")
    area = money.common_area(F.when(n % 3 != 0, F.col("l_extendedprice")), F.when(n % 2 == 0, F.col("l_tax")))
    paid = money.price_rows(F.col("l_quantity").cast("long") * 10_000, *[none] * 6)
    return line_items(spark, sf_dir).select("l_orderkey", "l_linenumber", area.alias("common_area"), paid[1]["deposit"].alias("low"), paid[2]["deposit"].alias("high"))


@query("""SELECT l_partkey AS complex, count(*) AS units, CAST(min(nullif(CAST(l_quantity AS BIGINT) - 1, 0)) AS BIGINT) AS min_deposit, CAST(min(CAST(l_quantity AS BIGINT) % 7) AS BIGINT) AS min_rent,
min(l_discount) AS min_area, max(l_discount) AS max_area FROM lineitem GROUP BY 1""")
def complex_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of an estate; a deposit of nothing is one that is not stated, a rent of nothing is a rent."""
    q = F.col("l_quantity").cast("long")
    return line_items(spark, sf_dir).groupBy(F.col("l_partkey").alias("complex")).agg(
        F.count("*").alias("units"), F.min(F.nullif(q - 1, F.lit(0))).alias("min_deposit"), F.min(q % 7).alias("min_rent"),
        F.min("l_discount").alias("min_area"), F.max("l_discount").alias("max_area"),
    )


@query(f"WITH {NOTICE_SQL} SELECT CAST(extract(year FROM posted_at) AS INTEGER) AS year, count(*) AS n FROM notice GROUP BY 1")
def notices_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).groupBy(F.year("posted_at").alias("year")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey AS cluster, o_orderkey % 3 = 0 AS amended, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS canonical FROM orders),
s AS (SELECT cluster, max(id) FILTER (WHERE NOT amended) AS original FROM n GROUP BY 1) SELECT id, CASE WHEN canonical AND amended THEN original END AS amends FROM n JOIN s USING (cluster)""")
def amendment_link_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"))
    last = o.groupBy("cluster").agg(F.max("id").alias("last"))
    return merge.amendment_links(o.join(last, "cluster"), "cluster", "id", F.col("id") % 3 == 0, F.col("id") == F.col("last"))


@query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size >= 10 AND p_size < 30 AND p_retailprice <= 1500 AND contains(lower(p_name), '1')""")
def multi_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District, half-open band, cap and part of the name together."""
    chosen = [F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), (F.col("p_size") >= 10) & (F.col("p_size") < 30),
              F.col("p_retailprice") <= 1500, F.lower("p_name").contains("1")]
    rows = read_table(spark, sf_dir, "part")
    for condition in chosen:
        rows = rows.filter(condition)
    return rows.select("p_partkey")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_photo FROM orders""")
def list_columns_with_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = line_items(spark, sf_dir).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct().withColumn("has_photo", F.lit(True))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return o.join(photos, "id", "left").select("id", "status", F.coalesce("has_photo", F.lit(False)).alias("has_photo"))
