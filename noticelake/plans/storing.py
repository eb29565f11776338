"""Snapshot merges, shown as the rows the next snapshot has; quality rules; links and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators import linking, merge
from noticelake.operators.quality import quarantine
from noticelake.operators.relational import completeness
from noticelake.plans.base import AS_OF, NOTICE_SQL, as_of, line_items, notices, shown
from noticelake.registry import query
from noticelake.session import read_table


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot of customers and a later delivery: some rows new, some changed, some fields missing."""
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    old = c.filter("k % 10 <> 0")
    new = c.filter("k % 3 = 0").select(
        "k", F.when(F.col("k") % 9 != 0, F.concat("name", F.lit("x"))).alias("name"),
        F.when(F.col("k") % 2 == 0, F.col("segment")).alias("segment"), F.col("nation"),
    )
    return old, new


OLD_NEW_SQL = """c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer),
o AS (SELECT * FROM c WHERE k % 10 <> 0), n AS (SELECT k, CASE WHEN k % 9 <> 0 THEN name || 'x' END AS name, CASE WHEN k % 2 = 0 THEN segment END AS segment, nation FROM c WHERE k % 3 = 0)"""


@query(f"""WITH {OLD_NEW_SQL} SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(n.segment, o.segment) AS segment,
CASE WHEN n.k IS NOT NULL THEN n.nation ELSE o.nation END AS nation, o.k IS NULL AS inserted,
(o.k IS NOT NULL AND n.k IS NOT NULL AND (o.name IS DISTINCT FROM n.name OR o.segment IS DISTINCT FROM coalesce(n.segment, o.segment) OR o.nation IS DISTINCT FROM n.nation)) AS changed
FROM o FULL JOIN n ON o.k = n.k""")
def upsert_changed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return merge.upsert(old, new, ["k"], keep_if_null=["segment"])


@query(f"""WITH {OLD_NEW_SQL} SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, CASE WHEN o.k IS NOT NULL THEN o.segment ELSE n.segment END AS segment,
CASE WHEN n.k IS NOT NULL AND o.k IS NOT NULL THEN o.nation + n.nation WHEN n.k IS NOT NULL THEN n.nation ELSE o.nation END AS nation FROM o FULL JOIN n ON o.k = n.k""")
def keep_if_null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    merged = merge.upsert(old, new, ["k"], ["name"], ["segment"], expressions={"nation": F.col("o.nation") + F.col("n.nation")})
    return merged.drop("inserted", "changed")


@query(f"""WITH {OLD_NEW_SQL} SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k % 4 = 0 AND n.name IS NOT NULL THEN n.name ELSE coalesce(o.name, n.name) END AS name FROM o FULL JOIN n ON o.k = n.k""")
def provenance_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    attached = F.when((F.col("o.k") % 4 == 0) & F.col("n.name").isNotNull(), F.col("n.name")).otherwise(F.coalesce("o.name", "n.name"))
    return merge.upsert(old.select("k", "name"), new.select("k", "name"), ["k"], expressions={"name": attached}).select("k", "name")


CHILD_SQL = """old AS (SELECT l_orderkey AS parent, l_linenumber AS child, CAST(min(l_quantity) AS BIGINT) AS q, min(l_suppkey) AS geom FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
new AS (SELECT l_orderkey AS parent, l_linenumber AS child, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber >= 3)"""


def children(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = line_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.col("l_quantity").cast("long").alias("q"), F.col("l_suppkey").alias("geom")
    )
    old = li.filter("child <= 4").groupBy("parent", "child").agg(F.min("q").alias("q"), F.min("geom").alias("geom"))
    return old, li.filter("parent % 5 = 0 AND child >= 3").drop("geom")


@query(f"WITH {CHILD_SQL} SELECT n.parent, n.child, n.q, n.low, geom FROM (SELECT parent, child, CAST(sum(q) AS BIGINT) AS q, min(q) AS low FROM new GROUP BY 1, 2) n LEFT JOIN old ON old.parent = n.parent AND old.child = n.child")
def replace_set_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = children(spark, sf_dir)
    doubled = new.withColumn("low", F.col("q"))
    return merge.replace_folded(old, doubled, ["parent", "child"], {"q": "sum", "low": "min"}, ["geom"])


@query(f"""WITH {CHILD_SQL}, f AS (SELECT parent, child, min(q) AS q FROM new GROUP BY 1, 2)
SELECT parent, child, q FROM f UNION ALL SELECT parent, child, q FROM old WHERE parent NOT IN (SELECT parent FROM new)""")
def scoped_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = children(spark, sf_dir)
    folded = new.groupBy("parent", "child").agg(F.min("q").alias("q"))
    return merge.replace_children(old.drop("geom"), folded, new, "parent")


@query(f"WITH {CHILD_SQL} SELECT parent, child, q FROM (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY q) AS rn FROM new) WHERE rn = 1")
def first_wins_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new = children(spark, sf_dir)
    return merge.first_wins(new, ["parent", "child"], "q")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read_table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"))
    new = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return merge.insert_if_absent(old, new, ["k"])


@query(f"""WITH {NOTICE_SQL} SELECT id, status AS before, 'F' AS status FROM notice WHERE posted_at BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND status IS DISTINCT FROM 'F'
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_linenumber >= 3)""")
def sweep_missing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = line_items(spark, sf_dir).filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("id"))
    covered = F.col("posted_at").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return merge.sweep(notices(spark, sf_dir), seen, "id", covered, "status", "F").select("id", "before", "status")


@query(f"WITH {NOTICE_SQL} SELECT id, CAST(posted_at AS VARCHAR) AS posted_at FROM notice WHERE posted_at >= DATE '{AS_OF}' - INTERVAL 12 MONTH")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge.retain(notices(spark, sf_dir), F.col("posted_at"), as_of(), 12), "id", "posted_at")


@query("SELECT md5(c_name || '|' || c_mktsegment) AS digest, c_custkey FROM customer WHERE md5(c_name || '|' || c_mktsegment) NOT IN (SELECT md5(c_name || '|' || c_mktsegment) FROM customer WHERE c_custkey % 2 = 0) ORDER BY c_custkey LIMIT 200")
def delta_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select(F.md5(F.concat_ws("|", "c_name", "c_mktsegment")).alias("digest"), "c_custkey")
    sent = rows.filter("c_custkey % 2 = 0").select("digest")
    return rows.join(sent, "digest", "left_anti").orderBy("c_custkey").limit(200)


@query("SELECT o_custkey AS k, count(*) + 1 AS login_count FROM orders GROUP BY 1")
def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("login_count"))
    new = old.select("k", F.lit(1).cast("long").alias("login_count"))
    return merge.upsert(old, new, ["k"], expressions={"login_count": F.col("o.login_count") + F.col("n.login_count")}).select("k", "login_count")


SCORE_SQL = """(CASE WHEN apply_end IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN announce IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN source_rank IS NOT NULL THEN 1 ELSE 0 END
 + CASE WHEN min_rent IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN min_deposit IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l.k IS NOT NULL THEN 1 ELSE 0 END)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = line_items(spark, sf_dir).select(F.col("l_orderkey").alias("id")).distinct().withColumn("child", F.lit(True))
    n = notices(spark, sf_dir).join(has, "id", "left")
    fields = [F.col(c).isNotNull() for c in ("apply_end", "announce", "source_rank", "min_rent", "min_deposit", "child")]
    return n.withColumn("score", completeness(fields))


@query(f"WITH {NOTICE_SQL} SELECT id, {SCORE_SQL} AS score FROM notice LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = id")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "score")


@query(f"WITH {NOTICE_SQL} SELECT id FROM notice LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = id WHERE canonical_id IS NULL AND {SCORE_SQL} >= 5 ORDER BY posted_at DESC, id LIMIT 500")
def completeness_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).filter("canonical_id IS NULL AND score >= 5")
    return rows.orderBy(F.col("posted_at").desc(), "id").limit(500).select("id")


@query(f"""WITH {NOTICE_SQL} SELECT id, agency, (min_rent IS NULL) AS no_rent, (apply_end IS NULL) AS no_end FROM notice
WHERE agency IN ('1-URGENT', '2-HIGH') AND posted_at >= DATE '{AS_OF}' - 120 AND (min_rent IS NULL OR apply_end IS NULL)""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).filter(F.col("agency").isin("1-URGENT", "2-HIGH") & (F.col("posted_at") >= F.date_sub(as_of(), 120)))
    flagged = n.select("id", "agency", F.col("min_rent").isNull().alias("no_rent"), F.col("apply_end").isNull().alias("no_end"))
    return flagged.filter("no_rent OR no_end")


QC_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_quantity < 9 THEN 'small' END, CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_extendedprice <= 0 OR l_extendedprice > 90000 THEN 'price' END) AS reasons
FROM lineitem WHERE l_quantity < 9 OR l_quantity > 45 OR l_extendedprice <= 0 OR l_extendedprice > 90000"""


@query(QC_SQL)
def qc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "small": F.col("l_quantity") < 9, "large": F.col("l_quantity") > 45,
        "price": (F.col("l_extendedprice") <= 0) | (F.col("l_extendedprice") > 90000),
    }
    _, bad = quarantine(line_items(spark, sf_dir), rules)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH cells AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity <= 25 THEN CAST(floor(l_quantity * 2 + 0.5) AS BIGINT) WHEN l_quantity <= 30 THEN NULL ELSE 1 END AS stated, CAST(floor(l_quantity * 2 + 0.5) AS BIGINT) AS expected FROM lineitem),
v AS (SELECT l_orderkey, count(*) FILTER (WHERE stated = expected) AS clean, count(*) FILTER (WHERE stated IS NULL) AS holes, count(*) FILTER (WHERE stated <> expected) AS mismatches FROM cells GROUP BY 1)
SELECT *, (clean >= 4 AND mismatches = 0) AS verified FROM v""")
def income_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    expected = F.floor(q * 2 + 0.5)
    stated = F.when(q <= 25, expected).when(q > 30, F.lit(1))
    return line_items(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count_if(stated == expected).alias("clean"), F.count_if(stated.isNull()).alias("holes"), F.count_if(stated != expected).alias("mismatches")
    ).withColumn("verified", (F.col("clean") >= 4) & (F.col("mismatches") == 0))


CLUSTER_SQL = """WITH RECURSIVE d AS (SELECT c_custkey AS id, c_nationkey * 1000 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 97 AS k1, CAST(floor(abs(c_acctbal)) AS BIGINT) % 4999 AS k2 FROM customer),
e AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.k1 = b.k1 OR a.k2 = b.k2),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS id, min(b) AS cluster FROM r GROUP BY a"""


@query(CLUSTER_SQL)
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.floor(F.abs("c_acctbal"))
    d = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 1000 + units % 97).alias("k1"), (units % 4999).alias("k2")
    )
    edges = linking.shared_key_edges(d, "id", F.col("k1")).union(linking.shared_key_edges(d, "id", F.col("k2")))
    return linking.clusters(d, edges, "id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey <> first THEN first END AS canonical FROM (SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority
ORDER BY (o_orderstatus = 'P') DESC, CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS first FROM orders)""")
def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").withColumn("cluster", F.concat_ws("|", "o_custkey", "o_orderpriority"))
    order = [(F.col("o_orderstatus") == "P").desc(), F.to_date("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return linking.canonical_pick(o, "cluster", order, "o_orderkey").select("o_orderkey", "canonical")


TIER_SQL = f"""WITH {NOTICE_SQL}, p AS (SELECT a.id AS post, b.id AS notice, CASE WHEN b.posted_at = a.posted_at AND b.housing_type = a.housing_type THEN 0 WHEN b.housing_type = a.housing_type AND abs(date_diff('day', a.posted_at, b.posted_at)) <= 30 THEN 1
WHEN b.sector = a.sector THEN 2 END AS tier FROM notice a JOIN notice b ON a.o_custkey = b.o_custkey AND a.agency = b.agency AND a.id <> b.id),
f AS (SELECT *, min(tier) OVER (PARTITION BY post) AS best FROM p WHERE tier IS NOT NULL), c AS (SELECT *, count(*) OVER (PARTITION BY post) AS n FROM f WHERE tier = best)
SELECT post, notice, tier FROM c WHERE n = 1"""


@query(TIER_SQL)
def narrow_to_one_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).select("id", "o_custkey", "agency", "posted_at", "housing_type", "sector")
    keys = ["o_custkey", "agency"]
    tiers = [
        linking.lone_other(n, "id", [*keys, "housing_type", "posted_at"]),
        linking.lone_other(n, "id", [*keys, "housing_type"], "posted_at", 30),
        linking.lone_other(n, "id", [*keys, "sector"]),
    ]
    return linking.first_tier(tiers, "id").select(F.col("id").alias("post"), F.col("other").alias("notice"), "tier")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey, (s.n_regionkey = c.n_regionkey) AS keep FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey),
k AS (SELECT *, bool_or(keep) OVER (PARTITION BY l_orderkey) AS any_kept FROM u) SELECT l_orderkey, l_linenumber, l_suppkey FROM k WHERE keep OR NOT any_kept""")
def region_fallback_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order whose supplier is of the buyer's region; all lines where none is."""
    nation = read_table(spark, sf_dir, "nation")

    def regions(of: str) -> DataFrame:
        return nation.select(F.col("n_nationkey").alias(f"{of}_nationkey"), F.col("n_regionkey").alias(f"{of}_region"))

    buyer = read_table(spark, sf_dir, "customer").join(regions("c"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_region")
    wanted = read_table(spark, sf_dir, "orders").join(buyer, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "c_region")
    sellers = read_table(spark, sf_dir, "supplier").join(regions("s"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "s_region")
    units = line_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey").join(wanted, "l_orderkey").join(sellers, "l_suppkey")
    return linking.keep_all_if_none(units, "l_orderkey", F.col("s_region") == F.col("c_region")).select("l_orderkey", "l_linenumber", "l_suppkey")


#: Parts over which the rows of one digest are spread.
SALTS = 64


LADDER_SQL = """WITH idx AS (SELECT p_brand AS road, p_size AS main, CAST(p_partkey % 3 AS INTEGER) AS sub, p_type AS district, CAST(p_partkey AS BIGINT) AS lon, CAST(p_partkey * 2 AS BIGINT) AS lat FROM part),
q AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(p_brand) AS road, min(p_size) AS main, CAST(min(l_partkey % 4) AS INTEGER) AS sub, CASE WHEN l_orderkey % 2 = 0 THEN min(substr(p_type, 1, 3)) END AS district
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber),
h1 AS (SELECT q.id, idx.district AS found, lon, lat FROM q JOIN idx ON q.road = idx.road AND q.main = idx.main AND q.sub = idx.sub WHERE q.district IS NULL OR starts_with(idx.district, q.district)),
e AS (SELECT id, count(DISTINCT found) AS n, arg_min(lon, (found, lon, lat)) AS lon, arg_min(lat, (found, lon, lat)) AS lat FROM h1 GROUP BY id HAVING count(DISTINCT found) = 1),
h2 AS (SELECT q.id, idx.district AS found, lon, lat FROM q JOIN idx ON q.road = idx.road AND q.main = idx.main WHERE q.sub <> 0 AND q.id NOT IN (SELECT id FROM e) AND (q.district IS NULL OR starts_with(idx.district, q.district))),
r AS (SELECT id, count(DISTINCT found) AS n, arg_min(lon, (found, lon, lat)) AS lon, arg_min(lat, (found, lon, lat)) AS lat FROM h2 GROUP BY id HAVING count(DISTINCT found) = 1)
SELECT id, lon, lat, 'building' AS precision FROM e UNION ALL SELECT id, lon, lat, 'road' FROM r"""


@query(LADDER_SQL)
def address_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    index = part.select(
        F.col("p_brand").alias("road"), F.col("p_size").alias("main"), (F.col("p_partkey") % 3).cast("int").alias("sub"),
        F.col("p_type").alias("district"), F.col("p_partkey").alias("lon"), (F.col("p_partkey") * 2).alias("lat"),
    )
    li = line_items(spark, sf_dir)
    asked = li.join(part, li.l_partkey == part.p_partkey).groupBy("l_orderkey", "l_linenumber").agg(
        F.min("p_brand").alias("road"), F.min("p_size").alias("main"), F.min(F.col("l_partkey") % 4).cast("int").alias("sub"),
        F.min(F.substring("p_type", 1, 3)).alias("d"),
    ).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "road", "main", "sub", F.when(F.col("l_orderkey") % 2 == 0, F.col("d")).alias("district"))
    return linking.address_ladder(asked, index)


@query("""WITH k AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS n FROM k""")
def seen_set_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read_table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    # a digest of many documents is spread over parts, whose minima and numbers are folded and given back to each part
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    salted = k.withColumn("part", part)
    parts = salted.groupBy("h", "part").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    whole = parts.groupBy("h").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("part").alias("parts"))
    back = whole.select("h", "first", "n", F.explode("parts").alias("part"))
    return salted.join(back, ["h", "part"]).select("doc_id", "first", "n")


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 AND coalesce(l.toxic, 0) = 0 THEN 'verified' ELSE 'rejected' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def three_valued_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read_table(spark, sf_dir, "documents").select("doc_id").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return joined.select("doc_id", F.when(F.col("quality").isNull(), "unknown").when(good, "verified").otherwise("rejected").alias("verdict"))
