"""Aggregations: basic, filtered, ordered-set, folded and conditional ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.operators.relational import cap_steps, distinct_on, ratio_of_sums, runs
from noticelake.plans.base import AS_OF, CLOSED_SQL, NOTICE_SQL, closed, line_items, notices, shown
from noticelake.registry import query
from noticelake.session import read_table


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
CAST(min(l_quantity) AS BIGINT) AS least, CAST(max(l_quantity) AS BIGINT) AS most, CAST(round(avg(l_quantity), 4) AS DECIMAL(12,4))::DOUBLE AS mean
FROM lineitem GROUP BY 1, 2""")
def grouped_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return line_items(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(q.cast("long")).alias("units"), F.min(q).cast("long").alias("least"),
        F.max(q).cast("long").alias("most"), F.round(F.avg(q), 4).cast("decimal(12,4)").cast("double").alias("mean"),
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT props) AS props FROM events GROUP BY 1")
def multi_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("props").alias("props")
    )


@query(f"""WITH {NOTICE_SQL} SELECT agency, count(*) AS total, count(*) FILTER (WHERE NOT {CLOSED_SQL}) AS open_n,
count(*) FILTER (WHERE min_rent IS NULL) AS no_rent, count(DISTINCT o_custkey) FILTER (WHERE sector = 'public') AS public_sources FROM notice GROUP BY agency""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).groupBy("agency").agg(
        F.count("*").alias("total"), F.count_if(~closed()).alias("open_n"), F.count_if(F.col("min_rent").isNull()).alias("no_rent"),
        F.countDistinct(F.when(F.col("sector") == "public", F.col("o_custkey"))).alias("public_sources"),
    )


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1 HAVING count(*) >= 15 AND count(DISTINCT o_orderpriority) > 3")
def having_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds")
    )
    return counted.filter("n >= 15 AND kinds > 3")


@query("""SELECT l_returnflag, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS DECIMAL(12,3))::DOUBLE AS median,
CAST(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS DECIMAL(12,3))::DOUBLE AS p90 FROM lineitem GROUP BY 1""")
def percentiles_median_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).groupBy("l_returnflag").agg(
        F.percentile("l_quantity", 0.5).cast("decimal(12,3)").cast("double").alias("median"), F.percentile("l_quantity", 0.9).cast("decimal(12,3)").cast("double").alias("p90")
    )


@query("""SELECT l_linestatus, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) FILTER (WHERE l_discount > 0.05) AS DECIMAL(12,3))::DOUBLE AS median,
CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS DECIMAL(12,3))::DOUBLE AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def percentile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = line_items(spark, sf_dir), read_table(spark, sf_dir, "orders")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_linestatus").agg(
        F.percentile(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")), 0.5).cast("decimal(12,3)").cast("double").alias("median"),
        F.percentile(days, 0.5).cast("decimal(12,3)").cast("double").alias("days"),
    )


@query("""SELECT o_custkey, o_orderpriority AS priority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("priority"))


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_return, CASE WHEN bool_or(l_linestatus = 'F') THEN 'final' ELSE 'document' END AS stage FROM lineitem GROUP BY 1""")
def bool_or_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_return"),
        F.when(F.bool_or(F.col("l_linestatus") == "F"), "final").otherwise("document").alias("stage"),
    )


@query("""SELECT l_suppkey, CAST(round(CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE), 0) AS DECIMAL(28,8)), 1) AS DECIMAL(18,1))::DOUBLE AS ratio
FROM lineitem GROUP BY 1""")
def ratio_of_sums_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return line_items(spark, sf_dir).groupBy("l_suppkey").agg(ratio_of_sums(F.col("l_quantity").cast("long"), returned, 1).alias("ratio"))


@query("SELECT user_id, CAST(floor(100.0 * avg(CASE WHEN value < 20 THEN 1 ELSE 0 END) + 0.5) AS BIGINT) AS low_pct FROM events GROUP BY 1")
def zero_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(F.col("value") < 20, 1).otherwise(0)
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.lit(100.0) * F.avg(low) + 0.5).cast("long").alias("low_pct"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' F' ELSE '' END, '|' ORDER BY o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' F' ELSE '' END) AS labels
FROM orders GROUP BY 1""")
def array_agg_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", " F").otherwise(""))
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(label)), "|").alias("labels"))


@query("SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def json_list_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("turn", "role")))
    texts = F.transform(pairs, lambda p: F.concat_ws(":", p["turn"].cast("string"), p["role"]))
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(texts, " ").alias("turns"))


@query("""SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS units FROM (SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q,
row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1""")
def count_once_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c).desc() for c in ("l_linenumber", "l_partkey", "l_quantity")]
    once = distinct_on(line_items(spark, sf_dir), ["l_orderkey", "l_returnflag", "l_linestatus"], order)
    return once.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("units"))


SUPPLY_SQL = f"""WITH {NOTICE_SQL}, detail AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1),
base AS (SELECT n.*, coalesce(min_rent, q) AS units FROM notice n LEFT JOIN detail ON l_orderkey = id WHERE canonical_id IS NULL AND posted_at >= DATE '{AS_OF}' - 60)
SELECT agency, count(*) AS notices, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, count(*) FILTER (WHERE units IS NULL) AS unknown FROM base GROUP BY agency ORDER BY units DESC, notices DESC"""


@query(SUPPLY_SQL)
def coalesce_header_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = line_items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    base = notices(spark, sf_dir).filter(F.col("canonical_id").isNull() & (F.col("posted_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 60)))
    known = base.join(detail, "id", "left").withColumn("units", F.coalesce("min_rent", "q"))
    return known.groupBy("agency").agg(
        F.count("*").alias("notices"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.count_if(F.col("units").isNull()).alias("unknown")
    ).orderBy(F.col("units").desc(), F.col("notices").desc())


@query("""SELECT l_suppkey, CAST(a[CAST(len(a) // 2 AS INTEGER) + 1] AS DECIMAL(12,2))::DOUBLE AS upper_median, CAST(m AS DECIMAL(12,3))::DOUBLE AS median FROM (
SELECT l_suppkey, list(l_quantity ORDER BY l_quantity) AS a, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS m FROM lineitem GROUP BY 1)""")
def upper_median_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # values are counted first, so a group is as long as it has distinct values
    counted = line_items(spark, sf_dir).groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("l_suppkey").orderBy("l_quantity")
    upto = counted.withColumn("upto", F.sum("n").over(by_value)).withColumn("all", F.sum("n").over(Window.partitionBy("l_suppkey")))
    upper = upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("l_suppkey").agg(
        F.min("l_quantity").cast("decimal(12,2)").cast("double").alias("upper_median")
    )
    middle = line_items(spark, sf_dir).groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5).cast("decimal(12,3)").cast("double").alias("median"))
    return upper.join(middle, "l_suppkey")


@query("""SELECT l_partkey, l_returnflag, count(*) AS n, CAST(min(l_quantity) AS BIGINT) AS low, CAST(nullif(max(l_quantity), min(l_quantity)) AS BIGINT) AS high
FROM lineitem GROUP BY 1, 2""")
def type_fold_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.min("l_quantity"), F.max("l_quantity")
    return line_items(spark, sf_dir).groupBy("l_partkey", "l_returnflag").agg(
        F.count("*").alias("n"), low.cast("long").alias("low"), F.nullif(high, low).cast("long").alias("high")
    )


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1""")
def dominant_value_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = read_table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first")
    )
    top = distinct_on(counted, ["o_custkey"], [F.col("n").desc(), F.col("first")])
    return top.select("o_custkey", F.col("o_orderpriority").alias("dominant"))


@query("""WITH li AS (SELECT l_orderkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 10 THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
h AS (SELECT l_orderkey, l_suppkey AS head FROM li WHERE rn = 1)
SELECT li.l_orderkey, any_value(head) AS head, CAST(nullif(sum(q), 0) AS BIGINT) AS supply, CASE WHEN count(DISTINCT l_suppkey % 10) = 1 THEN min(l_suppkey % 10) END AS only_district
FROM li JOIN h ON li.l_orderkey = h.l_orderkey GROUP BY li.l_orderkey""")
def row_group_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct((F.col("l_quantity") <= 10).cast("int"), "l_linenumber", "l_partkey", "l_suppkey")
    district = F.col("l_suppkey") % 10
    return line_items(spark, sf_dir).groupBy("l_orderkey").agg(
        F.min_by("l_suppkey", order).alias("head"), F.nullif(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("supply"),
        F.when(F.countDistinct(district) == 1, F.min(district)).alias("only_district"),
    )


@query(f"""WITH {NOTICE_SQL}, caps AS (SELECT unnest([10, 20, 30, 50, 100, 200, 300, 400, 500, 1000]) AS cap),
c AS (SELECT cap, (SELECT count(*) FROM notice WHERE min_rent <= cap) AS n, (SELECT count(min_rent) FROM notice) AS total FROM caps),
w AS (SELECT *, lag(n) OVER (ORDER BY cap) AS before FROM c)
SELECT CAST(cap AS BIGINT) AS cap, n FROM w WHERE n > 0 AND n < total AND n IS DISTINCT FROM before""")
def cap_step_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_steps(notices(spark, sf_dir), "min_rent", [10, 20, 30, 50, 100, 200, 300, 400, 500, 1000])


@query(f"""WITH {NOTICE_SQL}, per AS (SELECT o_custkey % 25 AS district, agency, count(DISTINCT id) AS n FROM notice WHERE canonical_id IS NULL GROUP BY 1, 2),
amb AS (SELECT o_custkey % 25 AS district FROM notice GROUP BY 1 HAVING count(DISTINCT agency) > 4)
SELECT per.district, per.agency, per.n, (amb.district IS NOT NULL) AS ambiguous FROM per LEFT JOIN amb ON per.district = amb.district""")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).withColumn("district", F.col("o_custkey") % 25)
    per = n.filter("canonical_id IS NULL").groupBy("district", "agency").agg(F.countDistinct("id").alias("n"))
    # ambiguity counts all rows, duplicates too
    several = n.groupBy("district").agg(F.countDistinct("agency").alias("a")).filter("a > 4").select("district", F.lit(True).alias("hit"))
    return per.join(several, "district", "left").select("district", "agency", "n", F.col("hit").isNotNull().alias("ambiguous"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("""SELECT tag, count(*) AS total, count(DISTINCT p_brand) AS brands FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY tag ORDER BY total DESC, tag""")
def exploded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("tag"))
    return words.groupBy("tag").agg(F.count("*").alias("total"), F.countDistinct("p_brand").alias("brands")).orderBy(F.col("total").desc(), "tag")


HOT_SQL = """WITH r AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 20)
(SELECT 'hot' AS kind, * FROM r ORDER BY units DESC, l_suppkey LIMIT 10) UNION ALL (SELECT 'calm' AS kind, * FROM r ORDER BY units, l_suppkey LIMIT 10)"""


@query(HOT_SQL)
def hot_cold_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_items(spark, sf_dir).groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("units"), F.count("*").alias("n")).filter("n >= 20")
    hot = r.orderBy(F.col("units").desc(), "l_suppkey").limit(10).withColumn("kind", F.lit("hot"))
    return hot.unionByName(r.orderBy("units", "l_suppkey").limit(10).withColumn("kind", F.lit("calm")))


@query("""SELECT year(o_orderdate) AS year, o_orderpriority, count(DISTINCT o_orderkey) AS notices, count(*) AS n, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS DECIMAL(12,3))::DOUBLE AS median,
CAST(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS DECIMAL(12,3))::DOUBLE AS p90, CAST(max(l_quantity) AS BIGINT) AS most
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity BETWEEN 1 AND 2000 AND l_returnflag <> 'R' GROUP BY 1, 2 HAVING count(*) >= 30""")
def competition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = line_items(spark, sf_dir), read_table(spark, sf_dir, "orders")
    ok = li.filter(F.col("l_quantity").between(1, 2000) & (F.col("l_returnflag") != "R"))
    return ok.join(o, ok.l_orderkey == o.o_orderkey).groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(
        F.countDistinct("o_orderkey").alias("notices"), F.count("*").alias("n"), F.percentile("l_quantity", 0.5).cast("decimal(12,3)").cast("double").alias("median"),
        F.percentile("l_quantity", 0.9).cast("decimal(12,3)").cast("double").alias("p90"), F.max("l_quantity").cast("long").alias("most"),
    ).filter("n >= 30")


@query(f"""WITH {NOTICE_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY ({CLOSED_SQL}) ORDER BY (agency LIKE '1%') DESC, posted_at DESC, id DESC) AS rn FROM notice WHERE agency LIKE '%-%')
SELECT id, agency, CAST(posted_at AS VARCHAR) AS posted_at, rn FROM w WHERE rn <= 8""")
def topk_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).filter(F.col("agency").contains("-")).withColumn("closed", closed())
    w = Window.partitionBy("closed").orderBy(F.col("agency").startswith("1").desc(), F.col("posted_at").desc(), F.col("id").desc())
    return shown(rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 8"), "id", "agency", "posted_at", "rn")


@query(f"""WITH {NOTICE_SQL} SELECT agency, housing_type, id FROM (SELECT *, row_number() OVER (PARTITION BY agency, housing_type ORDER BY apply_end NULLS LAST, id) AS rn FROM notice) WHERE rn = 1""")
def distinct_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_on(notices(spark, sf_dir), ["agency", "housing_type"], [F.col("apply_end").asc_nulls_last(), F.col("id")]).select("agency", "housing_type", "id")


@query(f"""WITH {NOTICE_SQL} SELECT id, agency, o_custkey, n, CAST(apply_end AS VARCHAR) AS apply_end FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, agency) AS n,
row_number() OVER (PARTITION BY o_custkey, agency ORDER BY apply_end NULLS LAST, id) AS rn FROM notice WHERE NOT {CLOSED_SQL}) WHERE rn = 1 ORDER BY apply_end NULLS LAST, id DESC LIMIT 60""")
def group_size_before_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = notices(spark, sf_dir).filter(~closed()).withColumn("n", F.count("*").over(Window.partitionBy("o_custkey", "agency")))
    one = distinct_on(open_, ["o_custkey", "agency"], [F.col("apply_end").asc_nulls_last(), F.col("id")])
    return shown(one.orderBy(F.col("apply_end").asc_nulls_last(), F.col("id").desc()).limit(60), "id", "agency", "o_custkey", "n", "apply_end")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_no FROM conversations")
def row_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("row_no"))


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS grp FROM d)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, grp""")
def gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read_table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"))
    return runs(days, ["user_id"], "day")


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS start FROM conversations),
s AS (SELECT *, sum(start) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM m)
SELECT conv_id, CAST(span AS BIGINT) AS span, min(role) AS role, min(turn) AS first, count(*) AS n FROM s GROUP BY conv_id, span""")
def equal_value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    start = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    spans = read_table(spark, sf_dir, "conversations").withColumn("start", start).withColumn("span", F.sum("start").over(w))
    return spans.groupBy("conv_id", "span").agg(F.min("role").alias("role"), F.min("turn").alias("first"), F.count("*").alias("n"))
