"""Rule engines, search, tables rebuilt from glyphs, fuzzy links and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.text import search_norm
from noticelake.operators import eligibility, glyphs, rules
from noticelake.operators.matching import best_match
from noticelake.operators.relational import distinct_on, top_k_per_group
from noticelake.registry import query
from noticelake.session import checkpoint_dir, read_table
from noticelake.streaming.page_views import daily_views

# A small rule table, in the columns of eligibility.RULE.
TYPES = [
    ("young", 19, 39, ["대학생"], "미혼", None, False, [], "본인", 100, None, True, "본인", 2500, "본인", 500, "서울"),
    ("couple", 0, 999, [], "혼인", 7, True, [], "세대원", 100, 120, True, "세대", 3500, "세대", 800, "서울"),
    ("senior", 65, 999, [], "무관", None, False, ["고령자", "장애인"], "세대원", 80, None, False, "세대", None, "세대", None, None),
    ("branch", 19, 39, [], "무관", 7, False, [], "본인", 100, None, True, "세대주분기", 2500, "세대주분기", 0, "모집지역"),
    ("parents", 0, 999, [], "무관", None, False, ["대학생"], "본인", 100, None, False, "본인+부모", None, "본인", None, None),
    ("open", 0, 999, [], "무관", None, False, [], "세대원", None, None, False, "세대", None, "세대", None, None),
]
TIERS = [("강남구", "sigungu", "서울"), ("서울특별시", "sido", "서울"), ("인천광역시", "sido", "연접")]
INCOME = [(1, 100, 1000), (2, 100, 1800), (3, 100, 2500), (4, 100, 3000), (5, 100, 3200), (6, 100, 3400), (7, 100, 3600), (3, 80, 1990)]
PLACES, CLASSES = ("강남구", "서울특별시 강서구", "인천광역시 서구", "수원시", ""), ("대학생", "고령자", "한부모", "신생아", "없음")


def sql_rows(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if isinstance(v, list):
            return f"CAST([{', '.join(map(one, v))}] AS VARCHAR[])"
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


PROFILE_SQL = """p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN 18 + c_custkey % 60 END AS age, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 <> 0 END AS homeless,
1 + c_custkey % 9 AS household, CASE WHEN c_custkey % 7 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) END AS income, CASE WHEN c_custkey % 11 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) // 2 END AS assets,
CASE WHEN c_nationkey < 12 THEN 'A' ELSE 'B' END AS region FROM customer)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, money = F.col("c_custkey"), F.floor(F.abs("c_acctbal"))
    return read_table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 17 != 0, 18 + k % 60).alias("age"), F.when(k % 5 != 0, k % 3 != 0).alias("homeless"),
        (1 + k % 9).alias("household"), F.when(k % 7 != 0, money).alias("income"),
        F.when(k % 11 != 0, F.floor(money / 2)).alias("assets"), F.when(F.col("c_nationkey") < 12, "A").otherwise("B").alias("region"),
    )


APPLICANT_SQL = f"""a AS (SELECT c_custkey AS id, CAST(18 + c_custkey % 60 AS INTEGER) AS age, CASE c_custkey % 3 WHEN 0 THEN '미혼' WHEN 1 THEN '기혼' ELSE '예비신혼부부' END AS marital_state,
CAST(c_custkey % 13 AS INTEGER) AS married_years, [{sql_rows([(c,) for c in CLASSES]).replace('(', '').replace(')', '')}][1 + c_custkey % 5] AS class, c_custkey % 4 <> 0 AS homeless, c_custkey % 8 <> 0 AS homeless_self,
CAST(1 + c_custkey % 9 AS INTEGER) AS household, CAST(floor(abs(c_acctbal) / 4) AS BIGINT) AS income_self, CAST(floor(abs(c_acctbal) / 3) AS BIGINT) AS income_home,
CAST(floor(abs(c_acctbal) / 3) AS BIGINT) AS asset_self, CAST(floor(abs(c_acctbal) / 2) AS BIGINT) AS asset_home, CAST(c_custkey % 7 * 150 AS BIGINT) AS car, c_custkey % 10 = 0 AS has_newborn, c_custkey % 6 = 1 AS dual,
[{sql_rows([(c,) for c in PLACES]).replace('(', '').replace(')', '')}][1 + c_custkey % 5] AS residence FROM customer)"""


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, money = F.col("c_custkey"), F.abs("c_acctbal")
    state = F.element_at(F.array(*map(F.lit, ("미혼", "기혼", "예비신혼부부"))), (k % 3 + 1).cast("int"))
    return read_table(spark, sf_dir, "customer").select(
        k.alias("id"), (18 + k % 60).cast("int").alias("age"), state.alias("marital_state"), (k % 13).cast("int").alias("married_years"),
        F.array(F.element_at(F.array(*map(F.lit, CLASSES)), (k % 5 + 1).cast("int"))).alias("classes"),
        (k % 4 != 0).alias("homeless"), (k % 8 != 0).alias("homeless_self"), (1 + k % 9).cast("int").alias("household"),
        F.floor(money / 4).alias("income_self"), F.floor(money / 3).alias("income_home"), F.floor(money / 3).alias("asset_self"),
        F.floor(money / 2).alias("asset_home"), (k % 7 * 150).alias("car"), (k % 10 == 0).alias("has_newborn"), (k % 6 == 1).alias("dual"),
        F.element_at(F.array(*map(F.lit, PLACES)), (k % 5 + 1).cast("int")).alias("residence"),
    )


BOTH_SQL = "CASE WHEN {s} = '세대주분기' AND household > 1 THEN {own} <= {l1} OR {home} <= {l2} WHEN {s} IN ('본인', '세대주분기') THEN {own} <= {l1} ELSE {home} <= {l2} END"
INCOME_OK = BOTH_SQL.format(s="income_scope", own="income_self", home="income_home", l1="limit_self", l2="limit_home")
ASSET_OK = BOTH_SQL.format(s="asset_scope", own="asset_self", home="asset_home", l1="asset_limit", l2="asset_limit")
RULE_NAMES = ", ".join(x.split()[0] for x in eligibility.RULE.split(", "))
CHECKS_SQL = f"""(age_min <= 0 AND age_max >= 999) OR list_contains(age_exempt, class) OR age BETWEEN age_min AND age_max AS c1,
CASE marital WHEN '무관' THEN coalesce(marital_max_yr, 0) = 0 OR marital_state <> '기혼' OR married_years <= marital_max_yr WHEN '미혼' THEN marital_state = '미혼'
  ELSE marital_state <> '미혼' OR class IN ('한부모', '신생아') END AS c2,
marital = '혼인' AND marital_state = '기혼' AND class NOT IN ('한부모', '신생아') AND NOT has_newborn AND married_years > marital_max_yr AS u2,
len(required_class) = 0 OR list_contains(required_class, class) AS c3, homeless OR (homeless_scope = '본인' AND homeless_self) AS c4,
income_pct IS NULL OR ({INCOME_OK}) AS c5,
income_pct IS NOT NULL AND ((income_scope = '세대주분기' AND household > 1 AND (income_self <= limit_self) <> (income_home <= limit_home)) OR (income_scope = '본인+부모' AND income_home <= limit_home)) AS u5,
asset_limit IS NULL OR ({ASSET_OK}) AS c6, coalesce(asset_scope = '세대주분기' AND household > 1 AND (asset_self <= asset_limit) <> (asset_home <= asset_limit), FALSE) AS u6,
car_limit IS NULL OR car <= car_limit AS c7, region_limit IS DISTINCT FROM '서울' OR residence = '' OR residence = '강남구' OR residence LIKE '서울특별시%' AS c8,
coalesce(region_limit = '서울' AND residence = '', FALSE) AS u8"""


@query(f"""WITH {APPLICANT_SQL}, t({RULE_NAMES}) AS (VALUES {sql_rows(TYPES)}), s(household, pct, amount) AS (VALUES {sql_rows(INCOME)}),
x AS (SELECT a.*, t.*, greatest(1, least(7, a.household)) AS size, CASE WHEN dual AND marital_state <> '미혼' AND income_pct_dual IS NOT NULL THEN income_pct_dual ELSE income_pct END AS own FROM a CROSS JOIN t),
y AS (SELECT *, own + CASE WHEN NOT income_small_bonus THEN 0 WHEN household = 1 THEN 20 WHEN household = 2 THEN 10 ELSE 0 END AS p2, own + CASE WHEN income_small_bonus THEN 20 ELSE 0 END AS p1 FROM x),
l AS (SELECT y.*, coalesce(e.amount, floor(b.amount * p2 / 100.0::DOUBLE + 0.5)) AS limit_home, floor(1000 * p1 / 100.0::DOUBLE + 0.5) AS limit_self
  FROM y LEFT JOIN s e ON e.household = size AND e.pct = p2 LEFT JOIN s b ON b.household = size AND b.pct = 100),
z AS (SELECT id, code, {CHECKS_SQL} FROM l)
SELECT id, code, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AND c8 AS ok, u2 OR u5 OR u6 OR u8 AS unsure, concat_ws(',', CASE WHEN NOT c1 THEN '1' END, CASE WHEN NOT c2 THEN '2' END,
 CASE WHEN NOT c3 THEN '3' END, CASE WHEN NOT c4 THEN '4' END, CASE WHEN NOT c5 THEN '5' END, CASE WHEN NOT c6 THEN '6' END, CASE WHEN NOT c7 THEN '7' END, CASE WHEN NOT c8 THEN '8' END) AS failed FROM z""")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame(TYPES, eligibility.RULE)
    standard = spark.createDataFrame(INCOME, "household int, pct int, amount long")
    pairs = applicants(spark, sf_dir).withColumn("tier", eligibility.tier_of(F.col("residence"), TIERS)).join(F.broadcast(types))  # six rows
    known = eligibility.with_income_limits(pairs, standard)
    ok, unsure, failed = eligibility.diagnose(known)
    return known.select("id", "code", ok.alias("ok"), unsure.alias("unsure"), F.array_join(failed.cast("array<string>"), ",").alias("failed"))


@query(f"""WITH {APPLICANT_SQL}, k AS (SELECT *, ['대학생', '청년', '신혼부부', '고령자', '주거급여수급자', '기타'][1 + id % 6] AS kind, residence LIKE '서울%' OR residence = '강남구' AS seoul, id % 30 AS deposits FROM a)
SELECT id, kind, CAST(CASE kind WHEN '대학생' THEN CASE WHEN married_years >= 3 THEN 3 ELSE 1 END
WHEN '고령자' THEN CASE WHEN age >= 75 THEN 3 WHEN age >= 70 THEN 2 WHEN age >= 65 THEN 1 ELSE 0 END + CASE WHEN NOT seoul THEN 0 WHEN married_years >= 5 THEN 3 ELSE 2 END + CASE WHEN has_newborn THEN 3 ELSE 0 END
WHEN '주거급여수급자' THEN CASE WHEN NOT seoul THEN 0 WHEN married_years >= 5 THEN 3 ELSE 2 END + CASE WHEN has_newborn THEN 3 ELSE 0 END
WHEN '기타' THEN NULL ELSE CASE WHEN NOT seoul THEN 0 WHEN married_years >= 3 THEN 3 ELSE 1 END + CASE WHEN deposits >= 24 THEN 3 WHEN deposits >= 6 THEN 1 ELSE 0 END END AS INTEGER) AS points FROM k""")
def fit_happy_home_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, (*eligibility.MOST_POINTS, "기타")))
    seoul = eligibility.tier_of(F.col("residence"), TIERS) == "서울"
    points = eligibility.priority_points(F.col("kind"), seoul, F.col("married_years"), F.col("id") % 30, F.col("age"), F.col("has_newborn"))
    return applicants(spark, sf_dir).withColumn("kind", kinds[F.col("id") % 6]).select("id", "kind", points.cast("int").alias("points"))


RANKS = [(1, 100, 120, 24), (2, 120, None, 12), (3, 150, 180, None)]


@query(f"""WITH {APPLICANT_SQL}, b AS (SELECT *, id % 3 AS newborns, CASE WHEN id % 3 = 2 OR (id % 3 = 1 AND id % 2 = 0) THEN 20 WHEN id % 3 = 1 THEN 10 ELSE 0 END AS bonus, id % 30 AS deposits,
 [1000, 1800, 2500, 3000, 3200, 3400, 3600][least(7, household)] AS base FROM a),
r(rank, pct, dual_pct, need) AS (VALUES {sql_rows(RANKS)}), f AS (SELECT id, rank, CASE WHEN dual AND dual_pct IS NOT NULL THEN greatest(dual_pct, pct + bonus) ELSE pct + bonus END AS pct, income_home, base, deposits, need FROM b CROSS JOIN r)
SELECT id, min(rank) AS rank, arg_min(pct, rank) AS pct FROM f WHERE income_home <= floor(base * pct / 100.0::DOUBLE + 0.5) AND deposits >= coalesce(need, 0) GROUP BY id""")
def fit_long_lease_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.createDataFrame(RANKS, "rank int, pct int, dual_pct int, need int")
    id_ = F.col("id")
    bonus = eligibility.birth_bonus(id_ % 3, id_ % 2 == 0)
    base = F.array(*[F.lit(a) for _, p, a in INCOME if p == 100])[F.least(F.col("household"), F.lit(7)) - 1]
    pairs = applicants(spark, sf_dir).join(F.broadcast(ranks))  # three rows
    tried = pairs.withColumn("own", eligibility.rank_percentage(F.col("pct"), F.col("dual_pct"), bonus, F.col("dual")))
    fits = (F.col("income_home") <= F.floor(base * F.col("own") / 100 + 0.5)) & (id_ % 30 >= F.coalesce("need", F.lit(0)))
    best = F.min(F.struct("rank", F.col("own").alias("pct"))).alias("b")
    return tried.filter(fits).groupBy("id").agg(best).select("id", "b.rank", "b.pct")


@query("""SELECT l_suppkey % 50 AS complex, l_returnflag AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, CAST(sum(l_partkey) AS BIGINT) AS applicants,
round(sum(l_partkey) / sum(CAST(l_quantity AS BIGINT)), 2) AS ratio FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2""")
def prior_by_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    units = F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long"))
    rows = li.select((F.col("l_suppkey") % 50).alias("complex"), F.col("l_returnflag").alias("kind"), units.alias("units"), F.col("l_partkey").alias("applicants"))
    return eligibility.prior_lines(rows, ["complex", "kind"])


STEPS = [(8000, 3), (5000, 2), (2000, 1)]


@query(f"""WITH {PROFILE_SQL}, s AS (SELECT id, CASE WHEN income IS NULL THEN NULL WHEN income >= 8000 THEN 3 WHEN income >= 5000 THEN 2 WHEN income >= 2000 THEN 1 ELSE 0 END AS score, CASE WHEN region = 'A' THEN 1 ELSE 2 END AS rank FROM p)
SELECT id, score, CASE WHEN score IS NULL THEN NULL WHEN rank < 2 AND id % 2 = 0 THEN 'win' WHEN rank > CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END THEN 'below' WHEN id % 3 = 0 OR score > 2 THEN 'win' WHEN score = 2 THEN 'tie' ELSE 'below' END AS standing FROM s""")
def score_and_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = rules.band_score(F.col("income"), STEPS)
    p = profiles(spark, sf_dir).select("id", score.alias("score"), F.when(F.col("region") == "A", 1).otherwise(2).alias("rank"))
    cut_rank = F.when(F.col("id") % 2 == 0, 2).otherwise(1)
    cut_score = F.when(F.col("id") % 3 != 0, 2)
    return p.select("id", "score", rules.standing(F.col("rank"), F.col("score"), cut_rank, cut_score).alias("standing"))


@query(f"""WITH {PROFILE_SQL}, r(place, least) AS (VALUES (1, 9000), (2, 6000), (3, 3000), (4, 0)) SELECT id, place FROM (SELECT id, place, row_number() OVER (PARTITION BY id ORDER BY place) AS rn FROM p JOIN r ON income >= least) WHERE rn = 1""")
def first_fitting_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.createDataFrame([(1, 9000), (2, 6000), (3, 3000), (4, 0)], "place int, least int")
    return rules.first_fitting(profiles(spark, sf_dir), ranks, "id", F.col("income") >= F.col("least"), "place").select("id", "place")


@query("""WITH s AS (SELECT l_partkey, l_suppkey, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_suppkey, l_orderkey) AS rn FROM lineitem)
SELECT l_partkey, count(*) AS n, CAST(min(q) AS BIGINT) AS deposit, min(l_suppkey) FILTER (WHERE rn = 1) AS label FROM s GROUP BY 1""")
def argmin_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    option = F.struct(F.col("l_quantity").cast("long").alias("deposit"), F.lit(0).cast("long").alias("rent"), F.col("l_suppkey").alias("label"))
    per = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(option).alias("best"))
    return per.select("l_partkey", "n", F.col("best.deposit").alias("deposit"), F.col("best.label").alias("label"))


@query("""WITH s AS (SELECT p_partkey AS id, lower(regexp_replace(p_type, '\\s+', '', 'g')) AS name, lower(p_brand) AS brand, p_size FROM part),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, brand ORDER BY p_size DESC, id) AS rn FROM s WHERE name LIKE '%a%') WHERE rn = 1),
r AS (SELECT id, name, row_number() OVER (PARTITION BY p_size > 25 ORDER BY (name LIKE 'e%') DESC, name, id) AS place FROM d) SELECT id, name, place FROM r WHERE place <= 10""")
def search_complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), search_norm(F.col("p_type")).alias("name"), search_norm(F.col("p_brand")).alias("brand"), "p_size")
    one = distinct_on(s.filter(F.col("name").contains("a")), ["name", "brand"], [F.col("p_size").desc(), F.col("id")])
    order = [F.col("name").startswith("e").desc(), F.col("name"), F.col("id")]
    return top_k_per_group(one, [F.col("p_size") > 25], order, 10, rank="place").select("id", "name", "place")


@query("""WITH n AS (SELECT n_name AS label, lower(n_name) AS k, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT label, n, CASE WHEN k LIKE 'nation_1%' THEN 0 WHEN k LIKE '%1%' THEN 1 END AS rank FROM n WHERE k LIKE '%1%' ORDER BY rank, n DESC, label""")
def match_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, nation = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    n = c.join(nation, c.c_nationkey == nation.n_nationkey).groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("n")).filter("n >= 5")
    key = F.lower("label")
    hit = n.withColumn("rank", F.when(key.rlike("^nation.1"), 0).when(key.contains("1"), 1)).filter("rank IS NOT NULL")
    return hit.orderBy("rank", F.col("n").desc(), "label").select("label", "n", "rank")


HEADERS = [("name", 10.0), ("brand", 400.0), ("size", 600.0)]


@query("SELECT p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def glyph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints the parts as pages of positioned glyphs, then reads the tables back."""
    part = read_table(spark, sf_dir, "part")
    rows = part.select(
        F.floor(F.col("p_partkey") / 20).cast("int").alias("page"), (F.col("p_partkey") % 20 + 1).alias("line"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"),
    )
    heads = rows.select("page").distinct().select("page", F.lit(0).cast("long").alias("line"), *[F.lit(n).alias(n) for n, _ in HEADERS])
    cells = rows.unionByName(heads).select("page", "line", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(n).alias("s")) for n, x in HEADERS])).alias("c"))
    each = cells.select("page", "line", "c.x", F.posexplode(F.split("c.s", "")).alias("i", "ch")).filter("ch <> ''")
    placed = each.select(
        F.lit("parts").alias("doc_id"), "page", F.lit(800.0).alias("page_h"), (F.col("x") + 6 * F.col("i")).alias("l"),
        (F.col("line") * 20.0 + 40).alias("t"), F.lit(6.0).alias("w"), F.lit(10.0).alias("h"), "ch",
    )
    return glyphs.under_header(glyphs.page_cells(placed), [n for n, _ in HEADERS]).select("name", "brand", "size")


@query()
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = s.withColumnRenamed("s_nationkey", "c_nationkey")
    return best_match(c, s, ["c_nationkey"], ("c_custkey", "c_name"), ("s_suppkey", "s_name"), 0.55)


@query("""SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, event_type AS path, count(*) AS views FROM events GROUP BY 1, 2""")
def stream_daily_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream to its end; the last complete result is what the batch query gives."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    views = raw.select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("path"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    started = daily_views(views).writeStream.outputMode("complete").foreachBatch(keep)
    started.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("day").cast("string").alias("day"), "path", "views")
