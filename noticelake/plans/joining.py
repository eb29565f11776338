"""Joins: facts with dimensions, children with parents, latest rows, prior rows and computed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions.text import name_key_a
from noticelake.operators.linking import lone_near, lone_other
from noticelake.operators.relational import distinct_on, latest_rows, latest_snapshot, top_k_per_group
from noticelake.plans.base import NOTICE_SQL, line_items, notices, shown
from noticelake.registry import query
from noticelake.session import read_table


@query("""SELECT n_name, count(*) AS n, CAST(sum(CAST(c_acctbal * 100 AS BIGINT)) AS BIGINT) AS cents
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def inner_fact_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    cents = F.rint(F.col("c_acctbal") * 100).cast("long")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


@query("""WITH days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) t(d)),
daily AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1)
SELECT CAST(days.day AS VARCHAR) AS day, coalesce(views, 0) AS views, coalesce(visitors, 0) AS visitors FROM days LEFT JOIN daily ON days.day = daily.day""")
def left_calendar_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS day")
    local = F.to_date(F.from_utc_timestamp("ts", "Asia/Seoul"))
    daily = read_table(spark, sf_dir, "events").groupBy(local.alias("day")).agg(
        F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors")
    )
    filled = days.join(daily, "day", "left").select(
        "day", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("visitors", F.lit(0)).alias("visitors")
    )
    return shown(filled)


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = line_items(spark, sf_dir).filter("l_quantity >= 49")
    o = read_table(spark, sf_dir, "orders")
    return o.join(big, o.o_orderkey == big.l_orderkey, "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read_table(spark, sf_dir, "orders"), line_items(spark, sf_dir)
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("""SELECT o_orderkey, (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS has_return
FROM orders WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def exists_or_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = line_items(spark, sf_dir).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    flagged = read_table(spark, sf_dir, "orders").join(returned.withColumn("hit", F.lit(True)), "o_orderkey", "left")
    has = F.col("hit").isNotNull()
    return flagged.filter((F.col("o_orderstatus") == "F") | has).select("o_orderkey", has.alias("has_return"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(returned, 0) AS returned, flags
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
  string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def lateral_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = line_items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"),
    )
    return read_table(spark, sf_dir, "orders").join(per, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("returned", F.lit(0)).alias("returned"), "flags"
    )


TOP1_SQL = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1)"""


@query(f"SELECT o_orderkey, l_partkey, l_linenumber FROM orders LEFT JOIN {TOP1_SQL} ON l_orderkey = o_orderkey")
def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]
    first = distinct_on(line_items(spark, sf_dir), ["l_orderkey"], order)
    o = read_table(spark, sf_dir, "orders")
    return o.join(first, o.o_orderkey == first.l_orderkey, "left").select("o_orderkey", "l_partkey", "l_linenumber")


@query(f"SELECT o_orderkey, l_partkey FROM orders JOIN {TOP1_SQL} ON l_orderkey = o_orderkey")
def cross_lateral_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateral_top1(spark, sf_dir).filter("l_partkey IS NOT NULL").select("o_orderkey", "l_partkey")


@query("""SELECT o_orderkey, count(DISTINCT l_returnflag) AS kinds FROM orders JOIN lineitem ON l_orderkey = o_orderkey
AND (l_partkey % 100 = o_custkey % 100 OR l_linestatus = o_orderstatus) GROUP BY o_orderkey""")
def or_residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read_table(spark, sf_dir, "orders"), line_items(spark, sf_dir)
    either = (F.col("l_partkey") % 100 == F.col("o_custkey") % 100) | (F.col("l_linestatus") == F.col("o_orderstatus"))
    return o.join(li, (o.o_orderkey == li.l_orderkey) & either).groupBy("o_orderkey").agg(F.countDistinct("l_returnflag").alias("kinds"))


@query("""WITH post AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
  ORDER BY CAST(o_orderdate AS DATE) DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn
  FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT o_custkey, o_orderstatus, o_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
FROM post JOIN lineitem ON l_orderkey = o_orderkey WHERE rn = 1 GROUP BY 1, 2, 3""")
def latest_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = line_items(spark, sf_dir)
    posts = read_table(spark, sf_dir, "orders").join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    # the sequence number is text, so it is compared as text
    order = [F.to_date("o_orderdate").desc_nulls_first(), F.col("o_orderkey").cast("string").desc()]
    last = latest_rows(posts, ["o_custkey", "o_orderstatus"], order)
    return last.join(li, last.o_orderkey == li.l_orderkey).groupBy("o_custkey", "o_orderstatus", "o_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("units")
    )


@query("""SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY user_id) m
ON e.user_id = m.user_id AND CAST(e.ts AS DATE) = m.d""")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return latest_snapshot(e, ["user_id"], "day").select("user_id", "event_id", "event_type")


PRIOR_SQL = f"""WITH {NOTICE_SQL}, pairs AS (
  SELECT n.id, p.id AS prior_id, p.id % 3 AS family, n.id % 3 AS own, row_number() OVER (PARTITION BY n.id ORDER BY p.posted_at DESC, p.id DESC) AS rn
  FROM notice n JOIN notice p ON n.agency = p.agency AND n.o_custkey = p.o_custkey AND p.posted_at < n.posted_at AND p.id <> n.id),
near AS (SELECT * FROM pairs WHERE rn <= 12 AND family = own)
SELECT id, prior_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS first FROM near) WHERE first = 1"""


@query(PRIOR_SQL)
def prior_lookup_top12_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).select("id", "agency", "o_custkey", "posted_at")
    keys = ["agency", "o_custkey"]
    # no more than the twelve latest of a day, and of the twelve days before, can be among the twelve latest before a day
    latest = top_k_per_group(n, [*keys, "posted_at"], [F.col("id").desc()], 12)
    days = latest.groupBy(*keys, "posted_at").agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("ids"))
    earlier = Window.partitionBy(*keys).orderBy("posted_at").rowsBetween(-12, -1)
    prior = days.select(*keys, "posted_at", F.slice(F.flatten(F.reverse(F.collect_list("ids").over(earlier))), 1, 12).alias("prior"))
    # the family is tested after the twelve latest are cut: a match beyond them does not count
    found = F.filter("prior", lambda p: p % 3 == F.col("id") % 3)
    return n.join(prior, [*keys, "posted_at"]).select("id", F.get(found, 0).alias("prior_id")).filter("prior_id IS NOT NULL")


@query(f"""WITH {NOTICE_SQL} SELECT a.id, count(*) AS candidates FROM notice a JOIN notice b ON a.o_custkey = b.o_custkey AND a.agency = b.agency AND a.id <> b.id
AND b.posted_at BETWEEN a.posted_at - 3 AND a.posted_at + 3 GROUP BY a.id""")
def proximity_join_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).select("id", "o_custkey", "agency", "posted_at")
    found = lone_other(rows, "id", ["o_custkey", "agency"], "posted_at", 3)
    return found.filter("n > 0").select("id", F.col("n").alias("candidates"))


KEY_A_SQL = r"lower(regexp_replace(regexp_replace({}, '\([^)]*\)', '', 'g'), '[\]\[_.,·・\s-]', '', 'g'))"


@query(f"""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON
  replace({KEY_A_SQL.format('c_name')}, 'customer#', '') = replace({KEY_A_SQL.format('s_name')}, 'supplier#', '')""")
def computed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").withColumn("key", F.replace(name_key_a(F.col("c_name")), F.lit("customer#"), F.lit("")))
    s = read_table(spark, sf_dir, "supplier").withColumn("key", F.replace(name_key_a(F.col("s_name")), F.lit("supplier#"), F.lit("")))
    return c.join(s, "key").select("c_custkey", "s_suppkey")


@query("""SELECT (SELECT count(*) FROM orders) AS notices, (SELECT count(DISTINCT o_custkey) FROM orders) AS agencies,
(SELECT count(*) FROM lineitem) AS units, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS negative,
(SELECT CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) FROM orders) AS last_day""")
def scalar_crossjoin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, c = (read_table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    parts = [
        o.agg(F.count("*").alias("notices"), F.countDistinct("o_custkey").alias("agencies"),
              F.max(F.to_date("o_orderdate")).cast("string").alias("last_day")),
        li.agg(F.count("*").alias("units")),
        c.filter("c_acctbal < 0").agg(F.count("*").alias("negative")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query(f"""WITH {NOTICE_SQL} SELECT n.id, c.id AS canonical, c.agency AS canonical_agency, (n.canonical_id IS NOT NULL AND c.id IS NULL) AS broken
FROM notice n LEFT JOIN notice c ON n.canonical_id = c.id""")
def canonical_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).select("id", "canonical_id")
    c = notices(spark, sf_dir).select(F.col("id").alias("canonical"), F.col("agency").alias("canonical_agency"))
    # rows without a link meet nothing; in the join all of them would go to one task
    joined = n.filter("canonical_id IS NOT NULL").join(c, F.col("canonical_id") == F.col("canonical"), "left")
    linked = joined.select("id", "canonical", "canonical_agency", F.col("canonical").isNull().alias("broken"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in c.dtypes]
    return linked.unionByName(n.filter("canonical_id IS NULL").select("id", *none, F.lit(False).alias("broken")))


@query("""WITH cand AS (SELECT c_custkey, s_suppkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN supplier
  ON c_nationkey = s_nationkey AND abs(CAST(c_acctbal AS DECIMAL(18,4)) - CAST(s_acctbal AS DECIMAL(18,4))) < 25)
SELECT c_custkey, s_suppkey FROM cand WHERE n = 1""")
def unique_candidate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    found = lone_near(c.withColumnRenamed("c_nationkey", "nation").withColumnRenamed("c_acctbal", "at"), s.withColumnRenamed("s_nationkey", "nation").withColumnRenamed("s_acctbal", "at"), ["nation"], "c_custkey", "s_suppkey", "at", 25)
    return found.filter("n = 1").select("c_custkey", F.col("other").alias("s_suppkey"))
