"""Foldings, repairs and cascades of the loading stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.operators import linking
from noticelake.operators.relational import distinct_on
from noticelake.operators.rules import monotonic
from noticelake.plans.base import NOTICE_SQL, line_items, notices
from noticelake.registry import query
from noticelake.session import read_table


@query("""WITH s AS (SELECT p_partkey, p_size AS low, p_size + p_partkey % 10 AS high FROM part), b(label, lo, hi) AS (VALUES ('small', 0, 15), ('middle', 15, 30), ('large', 30, 1000))
SELECT p_partkey, label FROM s JOIN b ON low < hi AND high >= lo""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([("small", 0, 15), ("middle", 15, 30), ("large", 30, 1000)], "label string, lo int, hi int")
    s = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("low"), (F.col("p_size") + F.col("p_partkey") % 10).alias("high"))
    return s.join(F.broadcast(bands), (F.col("low") < F.col("hi")) & (F.col("high") >= F.col("lo"))).select("p_partkey", "label")


@query("""SELECT conv_id, string_agg(CASE WHEN turn = 1 THEN 'new' ELSE role END, ',' ORDER BY CASE WHEN turn = 1 THEN 1000000 ELSE turn END) AS steps FROM conversations GROUP BY 1""")
def array_append_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    others = F.transform(F.filter("a", lambda x: x["turn"] != 1), lambda x: x["role"])
    fresh = F.when(F.exists("a", lambda x: x["turn"] == 1), F.array(F.lit("new"))).otherwise(F.array().cast("array<string>"))
    return per.select("conv_id", F.array_join(F.concat(others, fresh), ",").alias("steps"))


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)")
def regional_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read_table(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(0, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    return read_table(spark, sf_dir, "customer").join(chosen, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS show_flag, count(DISTINCT l_linestatus) > 1 AS show_status, count(DISTINCT nullif(l_tax, 0)) > 1 AS show_tax FROM lineitem GROUP BY 1")
def column_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).groupBy("l_orderkey").agg(
        (F.countDistinct("l_returnflag") > 1).alias("show_flag"), (F.countDistinct("l_linestatus") > 1).alias("show_status"),
        (F.countDistinct(F.nullif(F.col("l_tax"), F.lit(0.0))) > 1).alias("show_tax"),
    )


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, min(CAST(l_quantity AS BIGINT)) AS deposit, min(50 - l_suppkey % 50) AS rent FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, lag(deposit) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pd, lag(rent) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pr FROM o)
SELECT l_orderkey, bool_and(coalesce(deposit >= pd, TRUE) AND coalesce(rent <= pr, TRUE)) AS sane FROM w GROUP BY 1""")
def monotonic_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = line_items(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.col("l_quantity").cast("long")).alias("deposit"), F.min(50 - F.col("l_suppkey") % 50).alias("rent")
    )
    per = o.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "deposit", "rent"))).alias("o"))
    return per.select("l_orderkey", monotonic(F.col("o")).alias("sane"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS DOUBLE) * CASE o_orderkey % 20 WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 1 END AS x FROM orders),
m AS (SELECT o_custkey, percentile_cont(0.5) WITHIN GROUP (ORDER BY x) AS med FROM v GROUP BY 1),
c AS (SELECT o_orderkey, x, med, list_filter([x * 10, x / 10, x * 100, x / 100], lambda y: y BETWEEN med / 2 AND med * 2) AS fits FROM v JOIN m USING (o_custkey))
SELECT o_orderkey, CASE WHEN x BETWEEN med / 5 AND med * 5 THEN CAST(x AS BIGINT) WHEN len(fits) = 1 THEN CAST(floor(fits[1]) AS BIGINT) END AS x FROM c""")
def digit_typo_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values far from their group's median are moved by the one power of ten that brings them near, or dropped."""
    case = F.col("o_orderkey") % 20
    typo = F.when(case == 0, 100).when(case == 1, 10).otherwise(1)
    v = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.floor("o_totalprice").cast("double") * typo).alias("x"))
    m = v.groupBy("o_custkey").agg(F.percentile("x", 0.5).alias("med"))
    x, med = F.col("x"), F.col("med")
    fits = F.filter(F.array(x * 10, x / 10, x * 100, x / 100), lambda y: (y >= med / 2) & (y <= med * 2))
    fixed = F.when(x.between(med / 5, med * 5), x.cast("long")).when(F.size(fits) == 1, F.floor(fits[0]))
    return v.join(m, "o_custkey").select("o_orderkey", fixed.alias("x"))


@query("""WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS q, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(q) < 3 THEN len(q) ELSE len(list_filter(q, lambda x: x BETWEEN med / 2 AND med * 2)) END AS kept FROM g""")
def outlier_within_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = line_items(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"), F.percentile("l_quantity", 0.5).alias("med"))
    near = F.filter("q", lambda x: (x >= F.col("med") / 2) & (x <= F.col("med") * 2))
    return g.select("l_orderkey", F.when(F.size("q") < 3, F.size("q")).otherwise(F.size(near)).cast("long").alias("kept"))


@query("""WITH s AS (SELECT 'nation_' || CAST(l_suppkey % 30 AS VARCHAR) AS short, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT s.*, n_name, count(*) OVER (PARTITION BY short) AS hits, (lower(n_name) = short) AS exact FROM s JOIN nation ON lower(n_name) = short OR starts_with(lower(n_name), short) OR ends_with(lower(n_name), short)),
k AS (SELECT * FROM c WHERE exact OR hits = 1)
SELECT n_name, CAST(sum(units) AS BIGINT) AS units, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def district_shorthand_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = line_items(spark, sf_dir).groupBy(F.concat(F.lit("nation_"), F.col("l_suppkey") % 30).alias("short")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("units"), F.count("*").alias("n")
    )
    name = F.lower("n_name")
    # every beginning and end of each of the few names, so that the join is on equal keys
    cuts = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.array(F.substring(name, 1, i), F.substring(name, -i, i)))
    nations = read_table(spark, sf_dir, "nation").select("n_name", F.explode(F.array_distinct(F.flatten(cuts))).alias("short"))
    c = s.join(nations, "short").withColumn("exact", name == F.col("short"))
    counted = c.groupBy("short").agg(F.count("*").alias("hits"))
    kept = c.join(counted, "short").filter((F.col("hits") == 1) | F.col("exact"))
    return kept.groupBy("n_name").agg(F.sum("units").alias("units"), F.sum("n").alias("n"))


CASCADE_SQL = """WITH p AS (SELECT c_custkey, s_suppkey, CASE WHEN c_custkey % 1000 = s_suppkey THEN 0 WHEN substr(c_name, -2) = substr(s_name, -2) THEN 1 WHEN abs(CAST(c_acctbal AS DECIMAL(18,4)) - CAST(s_acctbal AS DECIMAL(18,4))) < 300 THEN 2 END AS tier FROM customer JOIN supplier ON c_nationkey = s_nationkey),
t AS (SELECT *, min(tier) OVER (PARTITION BY c_custkey) AS best FROM p WHERE tier IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS n FROM t WHERE tier = best)
SELECT c_custkey, s_suppkey, tier FROM n WHERE n = 1"""


@query(CASCADE_SQL)
def cascading_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    c = c.select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 1000).alias("key"), F.substring("c_name", -2, 2).alias("ends"), "c_acctbal")
    s = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.substring("s_name", -2, 2).alias("ends"), "s_acctbal")
    exact = linking.unique_by_key(c, s, ["nation", "key"], "s_suppkey")
    rest = exact.filter("n = 0").drop("n", "other")
    alike = linking.unique_by_key(rest, s, ["nation", "ends"], "s_suppkey")
    rest = alike.filter("n = 0").drop("n", "other")
    at = [df.withColumnRenamed(c, "at") for df, c in ((rest, "c_acctbal"), (s, "s_acctbal"))]
    close = linking.lone_near(*at, ["nation"], "c_custkey", "s_suppkey", "at", 300)
    found = linking.first_tier([exact, alike, close], "c_custkey")
    return found.select("c_custkey", F.col("other").alias("s_suppkey"), "tier")


@query(f"""WITH {NOTICE_SQL} SELECT id, '{{"agency":"' || agency || '","rent":' || coalesce(CAST(min_rent AS VARCHAR), 'null') || '}}' AS payload FROM notice""")
def nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.to_json(F.struct("agency", F.col("min_rent").alias("rent")), {"ignoreNullFields": "false"})
    return notices(spark, sf_dir).select("id", nested.alias("payload"))


@query("""SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS waiting, count(*) AS raw_rows, CAST(min(l_linenumber) AS INTEGER) AS first_line FROM lineitem GROUP BY 1, 2""")
def waitlist_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).groupBy("l_suppkey", "l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("waiting"), F.count("*").alias("raw_rows"), F.min("l_linenumber").alias("first_line")
    )


@query("""SELECT CAST(l_quantity AS BIGINT) AS q, CAST(rint_tax AS BIGINT) AS tax, l_returnflag, l_linestatus, count(*) AS n FROM (SELECT *, floor(l_tax * 100 + 0.5) AS rint_tax FROM lineitem) GROUP BY ALL""")
def unit_tuple_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).groupBy(
        F.col("l_quantity").cast("long").alias("q"), F.floor(F.col("l_tax") * 100 + 0.5).cast("long").alias("tax"), "l_returnflag", "l_linestatus"
    ).agg(F.count("*").alias("n"))


@query("""WITH cand AS (SELECT o_orderkey, l_partkey, l_suppkey, (l_suppkey % 6 = o_orderkey % 6) AS same FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
p AS (SELECT *, bool_or(same) OVER (PARTITION BY o_orderkey) AS any_same FROM cand), k AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM p WHERE same OR NOT any_same),
r AS (SELECT o_orderkey, CASE WHEN max(n) = 1 THEN 'linked' ELSE 'several' END AS reason FROM k GROUP BY 1)
SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM orders LEFT JOIN r USING (o_orderkey) GROUP BY 1""")
def parcel_linkage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read_table(spark, sf_dir, "orders").select("o_orderkey"), line_items(spark, sf_dir)
    cand = o.join(li, o.o_orderkey == li.l_orderkey)
    kept = linking.keep_all_if_none(cand, "o_orderkey", F.col("l_suppkey") % 6 == F.col("o_orderkey") % 6)
    per = kept.groupBy("o_orderkey").agg(F.count("*").alias("c"))
    reason = F.when(F.col("c").isNull(), "none").when(F.col("c") == 1, "linked").otherwise("several")
    return o.join(per, "o_orderkey", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_custkey AS person, max(floor(o_totalprice)) AS total FROM orders GROUP BY 1), six AS (SELECT person, total FROM h WHERE person % 10 = 6), seven AS (SELECT person, total FROM h WHERE person % 10 = 7), five AS (SELECT person, total FROM h WHERE person % 10 = 5)
SELECT seven.person, CAST(CASE WHEN seven.total < six.total THEN six.total + (six.total - five.total) ELSE seven.total END AS BIGINT) AS total FROM seven LEFT JOIN six ON six.person = seven.person - 1 LEFT JOIN five ON five.person = seven.person - 2""")
def seven_person_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is lower than the one before it is continued by that one's step."""
    h = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.max(F.floor("o_totalprice")).alias("total"))

    def size(n: int) -> DataFrame:
        return h.filter(F.col("person") % 10 == n).select((F.col("person") + (7 - n)).alias("person"), F.col("total").alias(f"t{n}"))

    joined = size(7).join(size(6), "person", "left").join(size(5), "person", "left")
    fixed = F.when(F.col("t7") < F.col("t6"), F.col("t6") + (F.col("t6") - F.col("t5"))).otherwise(F.col("t7"))
    return joined.select("person", fixed.cast("long").alias("total"))


@query("""WITH u AS (SELECT url, page_id, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS rn FROM pages) SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id FROM u WHERE rn = 1""")
def order_preserving_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id")
    return distinct_on(rows, ["url"], [F.col("page_id")])


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '<title>[^<]*</title>') THEN trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END AS title, len(regexp_extract_all(html, '<li>')) AS items FROM pages""")
def html_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    has = F.col("html").rlike("<title>[^<]*</title>")
    return read_table(spark, sf_dir, "pages").select("page_id", F.when(has, F.trim(title)).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))
