"""Profiles against the tables of five kinds of notices, what they may pick, and how many applied before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.titles import name_key_b
from noticelake.operators import fitting
from noticelake.plans.base import line_items
from noticelake.plans.deciding import sql_rows
from noticelake.registry import query
from noticelake.session import read_table

GUS, GROUPS, CLASSES = ("강남구", "강서구", "연접", "경기기타", "기타", ""), ("건설형", "매입형", "없음"), ("대학생 계층", "청년", "신혼부부", "고령자", "주거급여 수급자", "없음")
APPLICANTS = ("청년", "이공계", "취업준비생", "")
#: notice, table_no, group, seq, rank, area, income_pct, dual_pct, requirement
LONG = [
    (0, 1, "건설형", 1, 1, "59", 100, 120, "청약 24회 이상"), (0, 1, "건설형", 2, 2, "59", 120, None, "청약 12회이상"), (0, 1, "건설형", 3, 1, "49", 100, None, None),
    (0, 1, "건설형", 4, None, "49", 150, None, "우선공급"), (0, 2, "매입형", 5, 1, "59", 100, 110, "단지가 위치한 자치구 거주"), (0, 2, "매입형", 6, 2, "59", 100, 110, "연접자치구 거주"),
    (0, 2, "매입형", 7, 3, "59", 100, 110, "그 외 서울시 자치구 거주"), (1, 1, "매입형", 1, None, "59", None, None, None), (1, 1, "매입형", 2, None, "49", 100, 130, "6 회 이상"),
    (2, 1, "건설형", 1, 2, "49", 150, None, None), (2, 1, "건설형", 2, 1, "49", 100, None, None),
]
LONG_KIND = "notice int, table_no int, group string, seq int, rank int, area string, income_pct int, dual_pct int, requirement string"
#: notice, seq, label, is_car, columns, limits
ASSETS = [
    (0, 1, "총자산", False, 3, [2500, 2800, 3000]), (0, 2, "자동차", True, 3, [500, None, 700]), (1, 1, "총자산(청년, 대학생)", False, 4, [2000, 2200, 2300, 2600]),
    (1, 2, "총자산(신혼부부, 고령자)", False, 4, [3000, 3200, 3300, 3600]), (1, 3, "자동차(청년)", True, 4, [0, 0, 0, 0]), (1, 4, "자동차(신혼부부)", True, 4, [450, None, None, 600]), (2, 1, "총자산", False, 1, [None]),
]
ASSET_KIND = "notice int, seq int, label string, is_car boolean, columns int, limits array<int>"
#: notice, block_no, name, ranked
BLOCKS = [(1, 1, "대학생 계층", True), (1, 2, "청년", True), (1, 3, "신혼부부", False), (1, 4, "고령자", True), (1, 5, "주거급여 수급자", True), (2, 1, "신혼부부·한부모", True), (2, 2, "고령자", False)]
#: notice, table_no, seq, rank, income_pct, asset, car_limit
PURCHASE = [(0, 1, 1, 2, 70, 3000, 500), (0, 1, 2, 1, 50, None, None), (0, 1, 3, 3, 100, 2000, None), (0, 2, 4, 1, None, None, None), (1, 1, 1, 1, None, None, None), (1, 1, 2, 2, 100, 2500, 450), (2, 3, 1, None, 100, None, None), (2, 3, 2, 3, 120, None, 300)]
PURCHASE_KIND = "notice int, table_no int, seq int, rank int, income_pct int, asset int, car_limit int"
#: notice, pct, household, won, per_person
STATED = [(n, p, h, 600 + 8 * p + 300 * h + 50 * n, 250 if n == 0 else None) for n in (0, 1) for p in (50, 70, 100) for h in range(1, 6)]
SEED = [(h, 900 + 450 * h) for h in range(1, 8) if h != 6]
LIMITS = [("청년", 2500, 450), ("신혼부부", 3400, None)]
PRIVATE_INCOME = [(h, p, (700 + 300 * h) * p // 100) for h in range(1, 8) for p in (100, 110, 120) if (h, p) != (4, 110)]


def pick(values: tuple, at: Column) -> Column:
    return F.array(*map(F.lit, values))[at.cast("int")]


def sql_pick(values: tuple, at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + CAST({at} AS INTEGER)]"


PERSON_SQL = f"""p AS (SELECT c_custkey AS id, CAST(c_custkey % 4 AS INTEGER) AS notice, 1 + c_custkey % 9 AS household, CAST(floor(abs(c_acctbal) / 3) AS BIGINT) AS income, CAST(floor(abs(c_acctbal) / 5) AS BIGINT) AS income_self,
CAST(floor(abs(c_acctbal) / 2) AS BIGINT) AS assets, c_custkey % 7 * 150 AS car, 15 + c_custkey % 65 AS age, c_custkey % 6 = 1 AS dual, c_custkey % 3 AS newborns, c_custkey % 5 = 0 AS older_minor, c_custkey % 30 AS deposits,
c_custkey % 8 AS years, {sql_pick(GUS, 'c_custkey % 6')} AS gu, c_custkey % 10 = 0 AS special, {sql_pick(GROUPS, 'c_custkey % 3')} AS grp, CASE WHEN c_custkey % 16 >= 4 THEN CASE WHEN c_custkey % 2 = 0 THEN '59' ELSE '49' END END AS area,
{sql_pick(CLASSES, 'c_custkey // 4 % 6')} AS class, CASE WHEN c_custkey % 9 >= 3 THEN '강남구' END AS estate_gu, {sql_pick(APPLICANTS, 'c_custkey // 4 % 4')} AS applicant,
CASE WHEN c_custkey % 27 = 0 THEN '수급자' WHEN c_custkey % 27 = 1 THEN '한부모' END AS priority_class, c_custkey % 2 = 0 AS parents_homeless, c_custkey % 11 = 0 AS disabled_self, c_custkey % 13 = 0 AS disabled_family, c_custkey % 5 <> 0 AS homeless FROM customer),
b AS (SELECT *, CASE WHEN newborns >= 2 OR (newborns = 1 AND older_minor) THEN 20 WHEN newborns = 1 THEN 10 ELSE 0 END AS bonus, gu NOT IN ('', '연접', '경기기타', '기타') AS city FROM p),
stated(notice, pct, household, won, per) AS (VALUES {sql_rows(STATED)}), seed(household, amount) AS (VALUES {sql_rows(SEED)}),
lims AS (SELECT n AS notice, pc AS pct, h AS household, coalesce(s.won, CASE WHEN h > 5 THEN e.won + e.per * (h - 5) END, CAST(floor(seed.amount * pc / 100.0 + 0.5) AS BIGINT)) AS plain,
  coalesce(s.won, CASE WHEN h > 5 THEN e.won + e.per * (h - 5) END, CAST(floor(seed.amount * (pc + CASE WHEN h = 1 THEN 20 WHEN h = 2 THEN 10 ELSE 0 END) / 100.0 + 0.5) AS BIGINT)) AS bumped
  FROM range(4) AS a(n), range(50, 201, 10) AS c(pc), range(1, 8) AS d(h) LEFT JOIN stated s ON s.notice = n AND s.pct = pc AND s.household = h LEFT JOIN stated e ON e.notice = n AND e.pct = pc AND e.household = 5 LEFT JOIN seed ON seed.household = h),
asset(notice, seq, label, is_car, cols, limits) AS (VALUES {', '.join(f"({n}, {q}, '{t}', {str(c).upper()}, {k}, [{', '.join('NULL' if x is None else str(x) for x in v)}]::INTEGER[])" for n, q, t, c, k, v in ASSETS)}),
kept AS (SELECT id, asset.seq, label, is_car, CASE WHEN is_car THEN car ELSE assets END AS mine, coalesce(limits[1 + CASE WHEN cols >= 4 THEN CASE WHEN newborns >= 2 THEN 3 WHEN newborns = 1 AND older_minor THEN 2 WHEN newborns = 1 THEN 1 ELSE 0 END WHEN bonus = 20 THEN 2 WHEN bonus = 10 THEN 1 ELSE 0 END], limits[1]) AS lim
  FROM b JOIN asset USING (notice))"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, money = F.col("c_custkey"), F.abs("c_acctbal")
    return read_table(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 4).cast("int").alias("notice"), (1 + k % 9).alias("household"), F.floor(money / 3).alias("income"), F.floor(money / 5).alias("income_self"),
        F.floor(money / 2).alias("assets"), (k % 7 * 150).alias("car"), (15 + k % 65).alias("age"), (k % 6 == 1).alias("dual"), (k % 3).alias("newborns"),
        (k % 5 == 0).alias("older_minor"), (k % 30).alias("deposits"), (k % 8).alias("years"), pick(GUS, k % 6).alias("gu"), (k % 10 == 0).alias("special"),
        pick(GROUPS, k % 3).alias("group"), F.when(k % 16 >= 4, F.when(k % 2 == 0, "59").otherwise("49")).alias("area"), pick(CLASSES, F.floor(k / 4) % 6).alias("class"),
        F.when(k % 9 >= 3, "강남구").alias("estate_gu"), pick(APPLICANTS, F.floor(k / 4) % 4).alias("applicant"),
        F.when(k % 27 == 0, "수급자").when(k % 27 == 1, "한부모").alias("priority_class"), (k % 2 == 0).alias("parents_homeless"), (k % 11 == 0).alias("disabled_self"),
        (k % 13 == 0).alias("disabled_family"), (k % 5 != 0).alias("homeless"),
    )


def incomes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(STATED, "notice int, pct int, household int, won long, per_person long"), spark.createDataFrame(SEED, "household int, amount long")


LONG_SQL = f"""WITH {PERSON_SQL}, r(notice, tno, grp, seq, rank, area, pct, dual_pct, req) AS (VALUES {sql_rows(LONG)}),
t AS (SELECT b.*, coalesce((SELECT min(tno) FROM r WHERE r.notice = b.notice AND r.grp = b.grp), (SELECT min(tno) FROM r WHERE r.notice = b.notice)) AS tno FROM b),
x AS (SELECT t.*, r.seq, r.rank, r.req, CASE WHEN dual AND dual_pct IS NOT NULL AND r.pct IS NOT NULL THEN greatest(dual_pct, r.pct + bonus) ELSE r.pct + bonus END AS own, CAST(nullif(regexp_extract(req, '([0-9]+)\\s*회\\s*이상', 1), '') AS INTEGER) AS need
  FROM t JOIN r ON r.notice = t.notice AND r.tno = t.tno AND (t.area IS NULL OR t.area = r.area)),
y AS (SELECT x.*, lims.plain AS lim FROM x LEFT JOIN lims ON lims.notice = x.notice AND lims.pct = x.own AND lims.household = least(7, x.household)),
f AS (SELECT *, (lim IS NULL OR income <= lim) AND (need IS NULL OR deposits >= need) AND CASE WHEN req LIKE '%위치한 자치구 거주%' THEN estate_gu IS NULL OR estate_gu = gu WHEN req LIKE '%연접자치구 거주%' THEN estate_gu IS NULL
  WHEN req LIKE '%그 외 서울시 자치구 거주%' THEN city ELSE TRUE END AS fits, bool_or(rank IS NOT NULL) OVER (PARTITION BY id) AS ranked FROM y),
h AS (SELECT * FROM f WHERE fits AND (NOT ranked OR rank IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, seq) = 1),
j AS (SELECT DISTINCT id FROM f), a AS (SELECT id, bool_and(mine <= lim) FILTER (WHERE lim IS NOT NULL) AS ok FROM kept GROUP BY id)
SELECT p.id, CASE WHEN j.id IS NOT NULL THEN h.id IS NOT NULL AND a.ok IS DISTINCT FROM FALSE END AS ok, h.rank, h.own AS pct, CASE WHEN h.own IS NOT NULL THEN h.lim END AS won FROM p LEFT JOIN j USING (id) LEFT JOIN h USING (id) LEFT JOIN a USING (id)"""


@query(LONG_SQL)
def fit_long_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, assets = spark.createDataFrame(LONG, LONG_KIND), spark.createDataFrame(ASSETS, ASSET_KIND)
    return fitting.long_lease_fit(people(spark, sf_dir), ranks, assets, *incomes(spark))


HAPPY_SQL = f"""WITH {PERSON_SQL}, c(notice, no, name, ranked) AS (VALUES {sql_rows(BLOCKS)}),
t AS (SELECT b.*, c.name, c.ranked FROM b LEFT JOIN c ON c.notice = b.notice AND c.no = coalesce((SELECT min(no) FROM c WHERE c.notice = b.notice AND c.name = b.class), (SELECT min(no) FROM c WHERE c.notice = b.notice))),
k AS (SELECT *, CASE WHEN name LIKE '%대학생%' THEN '대학생' WHEN name LIKE '%청년%' THEN '청년' WHEN name LIKE '%신혼%' OR name LIKE '%한부모%' THEN '신혼부부' WHEN name LIKE '%고령자%' THEN '고령자' WHEN name LIKE '%주거급여%' THEN '주거급여수급자' ELSE name END AS key FROM t),
q AS (SELECT *, CASE WHEN key IS NOT NULL THEN CASE WHEN key = '신혼부부' AND dual THEN 120 ELSE 100 END + bonus END AS pct FROM k),
y AS (SELECT q.*, lims.bumped AS lim FROM q LEFT JOIN lims ON lims.notice = q.notice AND lims.pct = q.pct AND lims.household = least(7, q.household)),
a AS (SELECT kept.id, kept.is_car, mine <= kept.lim AS ok FROM kept JOIN y USING (id) WHERE label LIKE '%' || key || '%' AND key <> '주거급여수급자' AND label LIKE CASE WHEN is_car THEN '%자동차%' ELSE '%총자산%' END QUALIFY row_number() OVER (PARTITION BY kept.id, is_car ORDER BY kept.seq) = 1),
g AS (SELECT id, bool_and(ok) AS ok FROM a GROUP BY id)
SELECT y.id, coalesce(key, '') AS key, CASE WHEN key IS NOT NULL THEN (key <> '고령자' OR age >= 65) AND (key = '주거급여수급자' OR ((income <= lim) IS DISTINCT FROM FALSE AND g.ok IS DISTINCT FROM FALSE)) END AS ok,
CAST(CASE WHEN ranked THEN CASE WHEN city OR gu = '연접' THEN 1 WHEN gu = '경기기타' THEN 2 ELSE 3 END END AS INTEGER) AS rank, CASE WHEN key IS NOT NULL AND city THEN 2 END AS priority,
CAST(CASE WHEN city THEN CASE key WHEN '대학생' THEN CASE WHEN years >= 3 THEN 3 ELSE 1 END WHEN '고령자' THEN CASE WHEN age >= 75 THEN 3 WHEN age >= 70 THEN 2 WHEN age >= 65 THEN 1 ELSE 0 END + CASE WHEN years >= 5 THEN 3 ELSE 2 END + CASE WHEN special THEN 3 ELSE 0 END
  WHEN '주거급여수급자' THEN CASE WHEN years >= 5 THEN 3 ELSE 2 END + CASE WHEN special THEN 3 ELSE 0 END WHEN '청년' THEN CASE WHEN years >= 3 THEN 3 ELSE 1 END + CASE WHEN deposits >= 24 THEN 3 WHEN deposits >= 6 THEN 1 ELSE 0 END
  WHEN '신혼부부' THEN CASE WHEN years >= 3 THEN 3 ELSE 1 END + CASE WHEN deposits >= 24 THEN 3 WHEN deposits >= 6 THEN 1 ELSE 0 END END END AS INTEGER) AS points, pct, CASE WHEN key IS NOT NULL THEN lim END AS won
FROM y LEFT JOIN g USING (id)"""


@query(HAPPY_SQL)
def fit_happy_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, assets = spark.createDataFrame(BLOCKS, "notice int, block_no int, name string, ranked boolean"), spark.createDataFrame(ASSETS, ASSET_KIND)
    return fitting.happy_home_fit(people(spark, sf_dir), classes, assets, *incomes(spark))


PURCHASE_SQL = f"""r0(notice, tno, seq, rank, pct, asset, car_limit) AS (VALUES {sql_rows(PURCHASE)}), r AS (SELECT * FROM r0 QUALIFY tno = min(tno) OVER (PARTITION BY notice))"""


@query(f"""WITH {PERSON_SQL}, {PURCHASE_SQL},
x AS (SELECT b.id, b.income, r.seq, r.rank, r.pct, lims.bumped AS lim FROM b JOIN r USING (notice) LEFT JOIN lims ON lims.notice = b.notice AND lims.pct = r.pct AND lims.household = least(7, b.household)),
h AS (SELECT * FROM x WHERE pct IS NULL OR lim IS NULL OR income <= lim QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(rank, 9), seq) = 1)
SELECT p.id, CASE WHEN p.notice < 3 THEN h.id IS NOT NULL END AS ok, h.rank, h.pct, CASE WHEN h.pct IS NOT NULL THEN h.lim END AS won FROM p LEFT JOIN h USING (id)""")
def fit_purchase_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.purchase_lease_fit(people(spark, sf_dir), spark.createDataFrame(PURCHASE, PURCHASE_KIND), *incomes(spark))


YOUTH_SQL = f"""WITH {PERSON_SQL}, {PURCHASE_SQL}, two AS (SELECT * FROM r WHERE rank = 2 QUALIFY row_number() OVER (PARTITION BY notice ORDER BY seq) = 1), three AS (SELECT * FROM r WHERE rank = 3 QUALIFY row_number() OVER (PARTITION BY notice ORDER BY seq) = 1),
x AS (SELECT b.*, coalesce(two.pct, 100) AS pct2, coalesce(three.pct, 100) AS pct3, two.asset AS a2, two.car_limit AS c2, three.asset AS a3, three.car_limit AS c3, three.notice IS NOT NULL AS has3 FROM b LEFT JOIN two ON two.notice = b.notice LEFT JOIN three ON three.notice = b.notice),
y AS (SELECT x.*, l2.bumped AS w2, l3.bumped AS w3, h2.bumped AS half2, h3.bumped AS half3 FROM x LEFT JOIN lims l2 ON l2.notice = x.notice AND l2.pct = pct2 AND l2.household = least(7, x.household) LEFT JOIN lims l3 ON l3.notice = x.notice AND l3.pct = pct3 AND l3.household = 1
  LEFT JOIN lims h2 ON h2.notice = x.notice AND h2.pct = 50 AND h2.household = least(7, x.household) LEFT JOIN lims h3 ON h3.notice = x.notice AND h3.pct = 50 AND h3.household = 1),
z AS (SELECT *, CASE WHEN notice = 3 THEN NULL WHEN priority_class IS NOT NULL THEN 1 WHEN (income <= w2) IS DISTINCT FROM FALSE AND (assets <= a2) IS DISTINCT FROM FALSE AND (car <= c2) IS DISTINCT FROM FALSE THEN 2
  WHEN has3 AND (income_self <= w3) IS DISTINCT FROM FALSE AND (assets <= a3) IS DISTINCT FROM FALSE AND (car <= c3) IS DISTINCT FROM FALSE THEN 3 END AS rank FROM y)
SELECT id, CASE WHEN notice < 3 THEN rank IS NOT NULL AND (applicant NOT IN ('청년', '이공계') OR age BETWEEN 19 AND 39) END AS ok, rank,
CASE WHEN rank IS NOT NULL THEN CASE WHEN rank = 1 THEN 3 ELSE 0 END + CASE WHEN parents_homeless THEN 2 ELSE 0 END + CASE WHEN disabled_self THEN 2 ELSE 0 END + CASE WHEN disabled_family THEN 1 ELSE 0 END
 + CASE WHEN (rank = 2 AND income <= half2) OR (rank = 3 AND income_self <= half3) THEN 3 ELSE 0 END + CASE WHEN deposits >= 24 THEN 3 WHEN deposits >= 12 THEN 2 WHEN deposits >= 6 THEN 1 ELSE 0 END END AS points,
CASE rank WHEN 2 THEN pct2 WHEN 3 THEN pct3 END AS pct, CASE rank WHEN 2 THEN w2 WHEN 3 THEN w3 END AS won FROM z"""


@query(YOUTH_SQL)
def fit_youth_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.youth_lease_fit(people(spark, sf_dir), spark.createDataFrame(PURCHASE, PURCHASE_KIND), *incomes(spark))


PRIVATE_SQL = f"""{PERSON_SQL}, l(class, asset, car_limit) AS (VALUES {sql_rows(LIMITS)}), i(household, pct, won) AS (VALUES {sql_rows(PRIVATE_INCOME)}),
u AS (SELECT p.*, CASE WHEN id % 2 = 0 THEN '청년' ELSE '신혼부부' END AS cls FROM p),
w AS (SELECT u.id, arg_min(i.pct, i.pct) AS pct FROM u JOIN i ON i.household = least(7, u.household) AND u.income <= i.won GROUP BY u.id),
v AS (SELECT u.*, w.pct, age BETWEEN 19 AND 39 AND homeless AND (car <= car_limit) IS DISTINCT FROM FALSE AS common, asset, l.car_limit FROM u LEFT JOIN w USING (id) JOIN l ON l.class = u.cls),
t AS (SELECT * EXCLUDE (special), common AND pct IS NOT NULL AND assets <= asset AS special, CASE WHEN gu <> '' AND estate_gu IS NOT NULL THEN CASE WHEN gu = estate_gu THEN 1 WHEN gu <> '기타' THEN 2 ELSE 3 END END AS region FROM v)"""


def private_verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = people(spark, sf_dir).withColumn("class", F.when(F.col("id") % 2 == 0, "청년").otherwise("신혼부부"))
    limits, income = spark.createDataFrame(LIMITS, "class string, asset int, car_limit int"), spark.createDataFrame(PRIVATE_INCOME, "household int, pct int, won long")
    return own, fitting.private_lease_fit(own, limits, income)


@query(f"WITH {PRIVATE_SQL} SELECT id, common, special, common AS general, CASE WHEN special THEN (pct - 90) // 10 END AS rank, pct, region FROM t")
def fit_private_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_verdicts(spark, sf_dir)[1]


CLASS_WORDS, OPTIONS = ("청년", "신혼부부", "전체", "", "대학생·1인", "기타"), ("특별공급", "일반공급(추첨)", "")
SUPPLY_SQL = f"""s AS (SELECT CAST(p_size % 4 AS INTEGER) AS notice, p_partkey AS line, CASE WHEN p_partkey % 7 <> 0 THEN {sql_pick(CLASS_WORDS, 'p_partkey % 6')} END AS words, CASE WHEN p_partkey % 5 <> 0 THEN {sql_pick(OPTIONS, 'p_partkey % 3')} END AS opt FROM part WHERE p_partkey < 60)"""


@query(f"""WITH {PRIVATE_SQL}, {SUPPLY_SQL} SELECT t.id, s.line, CASE WHEN opt LIKE '%특별%' THEN 'special' WHEN opt LIKE '%일반%' THEN 'general' END AS "option", CASE WHEN opt LIKE '%특별%' THEN special ELSE common END AS can FROM t JOIN s USING (notice)
WHERE coalesce(words, '') IN ('', '전체', '기타') OR (cls = '청년' AND (words LIKE '%청년%' OR words LIKE '%1인%')) OR (cls <> '청년' AND words LIKE '%신혼%')""")
def private_supply_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of its notice that each profile may look at, by class, and whether its tracks allow them."""
    own, found = private_verdicts(spark, sf_dir)
    k = F.col("p_partkey")
    supply = read_table(spark, sf_dir, "part").filter("p_partkey < 60").select(
        (F.col("p_size") % 4).cast("int").alias("notice"), k.alias("line"), F.when(k % 7 != 0, pick(CLASS_WORDS, k % 6)).alias("tenant_class"), F.when(k % 5 != 0, pick(OPTIONS, k % 3)).alias("income_option")
    )
    return fitting.private_picks(supply, own.select("id", "notice", "class").join(found, "id"))


BRACKETS = ("소계", "일반", "우선", "일반 1순위", "2순위", "일반2순위")
PRIOR_SQL = f"""WITH res AS (SELECT CAST(l_orderkey % 200 AS INTEGER) AS notice, l_suppkey % 8 AS est, {sql_pick(BRACKETS, 'l_partkey % 6')} AS bracket, CASE WHEN l_partkey % 11 <> 0 THEN {sql_pick(CLASSES, 'l_partkey // 6 % 6')} END AS cls,
 CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS BIGINT) - 6 END AS units, CASE WHEN l_linenumber <> 4 THEN l_partkey END AS applicants, l_linenumber % 3 AS post FROM lineitem),
post AS (SELECT CAST(o_orderkey % 200 AS INTEGER) AS notice, k AS post, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 3 = k) AS posted, count(*) FILTER (WHERE o_orderkey % 3 = k AND o_orderstatus = 'F') AS n FROM orders, range(3) AS r(k) GROUP BY 1, 2),
last AS (SELECT notice, post FROM post WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY notice ORDER BY posted DESC, post DESC) = 1),
r AS (SELECT res.* FROM res SEMI JOIN last USING (notice, post)),
a AS (SELECT c_custkey AS id, CAST(c_custkey % 200 AS INTEGER) AS notice, c_custkey % 8 AS est, CASE WHEN c_custkey % 2 = 0 THEN 'happy' ELSE 'youth' END AS kind, CASE WHEN c_custkey % 5 <> 0 THEN {sql_pick(CLASSES, 'c_custkey // 2 % 6')} END AS cls, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 END AS rank, c_custkey % 4 = 0 AS priority FROM customer),
j AS (SELECT a.id, r.bracket, r.units, r.applicants, a.kind = 'happy' AND a.cls IS NOT NULL AS happy, r.cls IS NOT NULL AND {{key}}(r.cls) = {{key}}(a.cls) AS same, CASE WHEN a.kind = 'happy' AND a.cls IS NOT NULL THEN r.bracket = CASE WHEN priority THEN '우선' ELSE '일반' END
  ELSE a.kind <> 'happy' AND r.bracket <> '소계' AND ends_with(replace(r.bracket, ' ', ''), CAST(rank AS VARCHAR) || '순위') END AS mine FROM a JOIN r USING (notice, est) WHERE r.units > 0 AND r.applicants IS NOT NULL),
g AS (SELECT id, CAST(sum(units) FILTER (WHERE mine) AS BIGINT) AS mine_units, CAST(sum(applicants) FILTER (WHERE mine) AS BIGINT) AS mine_applicants, CAST(sum(units) FILTER (WHERE bracket = '소계') AS BIGINT) AS all_units, CAST(sum(applicants) FILTER (WHERE bracket = '소계') AS BIGINT) AS all_applicants
  FROM j WHERE NOT happy OR coalesce(same, FALSE) GROUP BY id)
SELECT *, floor(mine_applicants / mine_units * 10 + 0.5) / 10 AS mine_ratio, floor(all_applicants / all_units * 10 + 0.5) / 10 AS all_ratio FROM g WHERE mine_units IS NOT NULL OR all_units IS NOT NULL"""
PRIOR_SQL = PRIOR_SQL.replace("{key}(r.cls)", "replace(replace(r.cls, ' 계층', ''), ' 수급자', '수급자')").replace("{key}(a.cls)", "replace(replace(a.cls, ' 계층', ''), ' 수급자', '수급자')")


@query(PRIOR_SQL)
def prior_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results of a profile's estate, by name, from the latest post of the notice: its own bracket and all."""
    li, k = line_items(spark, sf_dir), F.col("c_custkey")
    rows = li.select(
        (F.col("l_orderkey") % 200).cast("int").alias("notice"), name_key_b(F.concat(F.lit("Estate ("), F.col("l_partkey").cast("string"), F.lit(") "), (F.col("l_suppkey") % 8).cast("string"))).alias("estate"),
        pick(BRACKETS, F.col("l_partkey") % 6).alias("bracket"), F.when(F.col("l_partkey") % 11 != 0, pick(CLASSES, F.floor(F.col("l_partkey") / 6) % 6)).alias("tenant_class"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("long") - 6).alias("units"), F.when(F.col("l_linenumber") != 4, F.col("l_partkey")).alias("applicants"),
        F.lit("result").alias("kind"), (F.col("l_linenumber") % 3).cast("long").alias("post"),
    )
    o = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200).cast("int").alias("notice"), (F.col("o_orderkey") % 3).alias("post"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").cast("int").alias("f"))
    posts = o.groupBy("notice", "post").agg(F.max("day").alias("posted_at"), F.sum("f").alias("row_count")).withColumn("kind", F.lit("result"))
    asked = read_table(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 200).cast("int").alias("notice"), name_key_b(F.concat(F.lit("estate-"), (k % 8).cast("string"))).alias("estate"), F.when(k % 2 == 0, "happy").otherwise("youth").alias("kind"),
        F.when(k % 5 != 0, pick(CLASSES, F.floor(k / 2) % 6)).alias("class"), F.when(k % 3 != 0, k % 3).alias("rank"), (k % 4 == 0).alias("priority"),
    )
    return fitting.prior_for_estate(fitting.latest_posts(rows, posts).drop("kind", "post"), asked, "estate")
