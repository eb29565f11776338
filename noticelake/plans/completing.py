"""Rule workbooks, profiles between forms, units, typing errors and competition tables, ledgers and matches by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import money, text
from noticelake.operators import glyphs, merge, profiles, quality, relational, rulebooks, rules
from noticelake.plans.base import line_items
from noticelake.plans.fitting import pick, sql_pick
from noticelake.registry import query
from noticelake.session import read_table

MARRIED, SCOPES = ("", "미혼", "기혼"), ("세대", "본인", "")
SHEET_SQL = f"""r AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 29 <> 0 THEN 'c' || CAST(p_partkey AS VARCHAR) ELSE ' ' END AS code, p_type AS category, p_name AS name, CAST(p_size AS VARCHAR) AS age_min, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size + 20 AS VARCHAR) || '.0' ELSE '' END AS age_max,
 {sql_pick(MARRIED, 'p_partkey % 3')} AS marital, CASE WHEN p_partkey % 5 = 0 THEN ' 청년 | |' || p_brand || '|' ELSE '' END AS classes, CASE p_partkey % 4 WHEN 0 THEN '999' WHEN 1 THEN '100' WHEN 2 THEN '0' ELSE '' END AS pct,
 CASE p_partkey % 3 WHEN 0 THEN '999999' WHEN 1 THEN '34500.0' ELSE ' ' END AS asset, {sql_pick(SCOPES, 'p_partkey % 3')} AS scope, CASE WHEN p_partkey % 2 = 0 THEN 'y' ELSE 'n' END AS newborn FROM part)"""


def sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, size = F.col("p_partkey"), F.col("p_size")
    part = read_table(spark, sf_dir, "part")
    code = F.when(k % 29 != 0, F.concat(F.lit(" c"), k.cast("string"))).otherwise(" ")

    def as_map(**cells: Column) -> Column:
        return F.create_map(*[x for name, value in cells.items() for x in (F.lit(name.replace("pct", "%")), value)])

    rule = as_map(
        ID=code, 카테고리=F.col("p_type"), 유형명=F.col("p_name"), 최소나이=size.cast("string"), 최대나이=F.when(k % 4 != 0, F.concat((size + 20).cast("string"), F.lit(".0"))).otherwise(""),
        혼인조건=pick(MARRIED, k % 3), 필수계층=F.when(k % 5 == 0, F.concat(F.lit(" 청년 | |"), F.col("p_brand"), F.lit("|"))).otherwise(""),
        소득기준pct=F.coalesce(*[F.when(k % 4 == i, v) for i, v in enumerate(("999", "100", "0", ""))]), 자산만원=F.coalesce(*[F.when(k % 3 == i, v) for i, v in enumerate(("999999", "34500.0", " "))]),
        소득기준방식=pick(SCOPES, k % 3), 신생아혼인면제=F.when(k % 2 == 0, "y").otherwise("n"),
    )
    score = as_map(ID=code, 선정방식=F.when(k % 2 == 0, "배점").otherwise(""), 우선1순위조건=F.col("p_brand"), 우선3순위조건=F.when(k % 3 == 0, F.col("p_type")), 일반2순위조건=F.lit(" 둘 "), 가점=F.concat(F.lit(" "), size.cast("string")))
    return part.select(k.alias("seq"), rule.alias("cells")), part.filter("p_partkey % 7 <> 0").select(k.alias("seq"), score.alias("cells"))


@query(f"""WITH {SHEET_SQL} SELECT code, category, CAST(age_min AS INTEGER) AS age_min, CASE WHEN age_max = '' THEN 999 ELSE CAST(CAST(age_max AS DOUBLE) AS INTEGER) END AS age_max, CASE WHEN marital = '' THEN '무관' ELSE marital END AS marital,
CASE WHEN classes = '' THEN '' ELSE concat_ws(',', '청년', trim(split_part(classes, '|', 3))) END AS classes, CASE WHEN pct NOT IN ('', '999') THEN CAST(pct AS INTEGER) END AS income_pct, CASE WHEN trim(asset) NOT IN ('', '999999') THEN CAST(CAST(asset AS DOUBLE) AS INTEGER) END AS asset_limit,
CASE WHEN scope = '' THEN '무관' ELSE scope END AS income_scope, newborn = 'y' AS newborn_exempt, '세대원' AS homeless_scope, CASE category WHEN 'ECONOMY' THEN '행복주택' WHEN 'PROMO' THEN '국민임대' END AS housing_type,
CASE WHEN seq % 7 <> 0 AND seq % 2 = 0 THEN '배점' END AS ranking_method, CASE WHEN seq % 7 <> 0 THEN concat_ws(',', p_brand, CASE WHEN seq % 3 = 0 THEN category END) ELSE '' END AS ranks, CASE WHEN seq % 7 <> 0 THEN '둘' ELSE '' END AS general_ranks,
CASE WHEN seq % 7 <> 0 THEN age_min END AS points FROM r JOIN part ON p_partkey = seq WHERE trim(code) <> ''""")
def workbook_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of supply from the text cells of two sheets that share a code."""
    found = rulebooks.supply_types(*sheets(spark, sf_dir), {"ECONOMY": "행복주택", "PROMO": "국민임대"})
    return found.select(
        "code", "category", "age_min", "age_max", "marital", F.array_join("required_class", ",").alias("classes"), "income_pct", "asset_limit", "income_scope", "newborn_exempt", "homeless_scope",
        "housing_type", "ranking_method", F.array_join("ranks", ",").alias("ranks"), F.array_join("general_ranks", ",").alias("general_ranks"), F.try_element_at("score", F.lit("가점")).alias("points"),
    )


@query(f"""WITH {SHEET_SQL}, t AS (SELECT code, CAST(age_min AS INTEGER) AS age_min, CASE WHEN pct NOT IN ('', '999') THEN CAST(pct AS INTEGER) END AS income_pct, seq FROM r WHERE trim(code) <> '')
SELECT code, age_min, CASE WHEN seq % 10 = 1 THEN 70 WHEN seq % 10 = 2 THEN NULL ELSE income_pct END AS income_pct, CASE WHEN seq % 10 = 3 THEN 'notice ' || CAST(seq AS VARCHAR) END AS basis, coalesce(seq % 10 = 4, FALSE) AS small_bonus FROM t""")
def rule_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults and corrections by code laid over the rules, twice, as a second time changes nothing."""
    own = rulebooks.supply_types(*sheets(spark, sf_dir)).select("code", "age_min", "income_pct")
    k = F.col("p_partkey")
    named = F.coalesce(
        F.when(k % 10 == 1, F.create_map(F.lit("income_pct"), F.lit("70"))), F.when(k % 10 == 2, F.create_map(F.lit("income_pct"), F.lit(None).cast("string"))),
        F.when(k % 10 == 3, F.create_map(F.lit("basis"), F.concat(F.lit("notice "), k.cast("string")))), F.when(k % 10 == 4, F.create_map(F.lit("small_bonus"), F.lit("true"))),
    )
    patches = read_table(spark, sf_dir, "part").select(F.concat(F.lit("c"), k.cast("string")).alias("code"), named.alias("patch")).filter("patch IS NOT NULL")
    for _ in range(2):
        own = rulebooks.corrected(own.withColumn("basis", F.col("basis") if "basis" in own.columns else F.lit(None).cast("string")), "code", patches, {"small_bonus": False})
    return own


REGIONS, FORM_GUS, TIERS = ("강남구", "인천광역시", "수원시", ""), ("강남구", "연접", "경기기타", "기타", ""), (("강남구", "sigungu", "서울"), ("강서구", "sigungu", "서울"), ("인천광역시", "sido", "연접"))
HELD_SQL = f"""p AS (SELECT c_custkey AS id, {sql_pick(REGIONS, 'c_custkey % 4')} AS region, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {sql_pick(FORM_GUS, 'c_custkey % 5')} END AS gu, 1 + c_custkey % 4 AS household, 20 + c_custkey % 40 AS age,
 CASE c_custkey % 5 WHEN 0 THEN ['청년', '고령자'] WHEN 1 THEN ['신혼부부'] WHEN 2 THEN ['장애인'] ELSE CAST([] AS VARCHAR[]) END AS classes, CASE WHEN c_custkey % 2 = 0 THEN '미혼' ELSE '기혼' END AS marital, c_custkey % 7 = 0 AS homeless FROM customer),
e AS (SELECT *, CASE WHEN region <> '' AND gu = '' THEN CASE WHEN region = '강남구' THEN region WHEN region = '인천광역시' THEN '연접' ELSE '기타' END ELSE gu END AS gu2,
 CASE WHEN gu <> '' AND region = '' AND gu <> '연접' THEN CASE WHEN gu = '강남구' THEN gu ELSE '그 외 지역' END ELSE region END AS region2 FROM p),
v AS (SELECT *, CASE WHEN list_contains(classes, '청년') THEN '청년' WHEN list_contains(classes, '신혼부부') THEN '신혼부부' WHEN marital = '미혼' THEN '청년' ELSE '신혼부부' END AS class, CASE WHEN gu2 IN ('연접', '경기기타') THEN '기타' ELSE gu2 END AS form_gu FROM e)"""


def held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, money_ = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("long")
    classes = F.coalesce(F.when(k % 5 == 0, F.array(F.lit("청년"), F.lit("고령자"))), F.when(k % 5 == 1, F.array(F.lit("신혼부부"))), F.when(k % 5 == 2, F.array(F.lit("장애인"))), F.array().cast("array<string>"))
    rows = read_table(spark, sf_dir, "customer").select(
        k.alias("id"), pick(REGIONS, k % 4).alias("region"), F.when(k % 3 == 0, "").otherwise(pick(FORM_GUS, k % 5)).alias("gu"), (1 + k % 4).alias("household"), (20 + k % 40).alias("age"),
        classes.alias("classes"), F.when(k % 2 == 0, "미혼").otherwise("기혼").alias("marital"), (k % 7 == 0).alias("homeless"), F.lit(True).alias("homeless_self"), money_.alias("income_home"), money_.alias("asset_home"), (k % 3).alias("car"),
    )
    return rows, spark.createDataFrame(TIERS, "name string, kind string, tier string")


@query(f"""WITH {HELD_SQL} SELECT id, region2 AS region, gu2 AS gu, region <> region2 OR gu <> gu2 AS changed, class, form_gu, CASE WHEN class = '신혼부부' AND household < 2 THEN 2 ELSE household END AS household FROM v""")
def profile_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places filled from each other, and what the form of private leases takes."""
    full = profiles.reconciled(*held(spark, sf_dir))
    form = profiles.to_private(full).select("id", "class", F.col("gu").alias("form_gu"), "household")
    return full.select("id", "region", "gu", "changed").join(form, "id")


@query(f"""WITH {HELD_SQL}, f AS (SELECT *, CASE WHEN class = '신혼부부' AND household < 2 THEN 2 ELSE household END AS h FROM v)
SELECT id, CASE WHEN id % 2 = 0 THEN h ELSE household END AS household, CASE WHEN id % 2 = 0 THEN NOT homeless ELSE homeless END AS homeless, CASE WHEN id % 2 = 0 THEN NOT homeless ELSE TRUE END AS homeless_self,
CASE WHEN id % 2 = 0 AND NOT (form_gu = '기타' AND gu2 IN ('연접', '경기기타')) THEN form_gu ELSE gu2 END AS gu,
CASE WHEN id % 2 = 0 AND form_gu <> '' AND form_gu <> '연접' THEN CASE WHEN form_gu = '강남구' THEN form_gu ELSE '그 외 지역' END WHEN id % 2 = 0 AND form_gu = '' THEN '' ELSE region2 END AS region,
array_to_string(CASE WHEN id % 2 = 0 THEN list_concat(list_filter(classes, lambda c: c NOT IN ('청년', '신혼부부')), [class]) ELSE classes END, ',') AS classes FROM f""")
def profiles_from_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after the form of private leases came back for every second one, with the tick on homes turned."""
    rows, tiers = held(spark, sf_dir)
    full = profiles.reconciled(rows, tiers).drop("changed")
    filled = profiles.to_private(full).filter("id % 2 = 0").withColumn("homeless", ~F.col("homeless"))
    out = profiles.from_private(full, filled, tiers)
    return out.select("id", "household", "homeless", "homeless_self", "gu", "region", F.array_join("classes", ",").alias("classes"))




@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 1000 END) END AS BIGINT) AS v, CASE o_orderkey % 5 WHEN 1 THEN 1000 WHEN 2 THEN 10000 END AS col, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 10000 END AS tab FROM orders),
s AS (SELECT *, v * coalesce(col, tab, CASE WHEN v < 100000 THEN 10000 ELSE 1 END) AS d, v * coalesce(col, tab, CASE WHEN v < 10000 THEN 10000 ELSE 1 END) AS r, list_filter([v, v * 1000, v * 10000], lambda x: x BETWEEN 1000000 AND 1500000000) AS fd, list_filter([v, v * 1000, v * 10000], lambda x: x BETWEEN 10000 AND 20000000) AS fr FROM o)
SELECT id, CASE WHEN d BETWEEN 1000000 AND 1500000000 THEN d WHEN len(fd) = 1 THEN fd[1] END AS deposit, CASE WHEN r BETWEEN 10000 AND 20000000 THEN r WHEN len(fr) = 1 THEN fr[1] END AS rent FROM s""")
def amounts_in_won(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by the unit of their column, their table, or their size, whichever is known first, and made plausible."""
    k = F.col("o_orderkey")
    v = F.when(k % 11 != 0, F.floor(F.col("o_totalprice") / F.when(k % 3 == 0, 1).when(k % 3 == 1, 10).otherwise(1000)).cast("long"))
    col, tab = F.when(k % 5 == 1, 1000).when(k % 5 == 2, 10_000), F.when(k % 4 == 1, 1).when(k % 4 == 2, 10_000)
    return read_table(spark, sf_dir, "orders").select(k.alias("id"), money.in_won(v, col, tab).alias("deposit"), money.in_won(v, col, tab, rent=True).alias("rent"))


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey AS tab, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_orderkey % 40 + 20) * (50 + o_orderkey % 3 * 25) * (900 + o_orderkey % 200) * CASE o_orderkey % 20 WHEN 0 THEN 100 WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 1 END AS BIGINT) END AS deposit,
 CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderkey % 40 + 20 AS INTEGER) END AS area, CASE WHEN o_orderkey % 3 <> 2 THEN 50 + o_orderkey % 3 * 25 END AS ratio FROM orders),
n AS (SELECT *, CAST(CAST(deposit AS DECIMAL(28,8)) AS DOUBLE) / (area * coalesce(ratio, 100)) AS norm FROM v),
m AS (SELECT tab, list(norm ORDER BY norm)[CAST(count(norm) // 2 AS INTEGER) + 1] AS mid, count(norm) AS c FROM n WHERE norm IS NOT NULL GROUP BY tab HAVING count(norm) >= 3),
f AS (SELECT n.*, mid, mid IS NULL OR norm IS NULL OR (norm * 5 >= mid AND norm <= mid * 5) AS fine, list_filter([10, 0.1, 100, 0.01], lambda x: norm * x * 2 >= mid AND norm * x <= mid * 2) AS fits FROM n LEFT JOIN m USING (tab))
SELECT id, CASE WHEN fine THEN deposit WHEN len(fits) = 1 THEN CAST(floor(deposit * fits[1]) AS BIGINT) END AS deposit, CASE WHEN NOT fine THEN CASE WHEN len(fits) = 1 THEN 'fixed' ELSE 'dropped' END END AS error FROM f""")
def digit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits with a digit too many or too few, against the middle of what a table's deposits come to by area and ratio."""
    k = F.col("o_orderkey")
    typo = F.when(k % 20 == 0, 100).when(k % 20 == 1, 10).when(k % 20 == 2, 30).otherwise(1)
    deposit = F.when(k % 17 != 0, (k % 40 + 20) * (50 + k % 3 * 25) * (900 + k % 200) * typo)
    rows = read_table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("tab"), deposit.cast("long").alias("deposit"), F.when(k % 23 != 0, (k % 40 + 20).cast("int")).alias("area"), F.when(k % 3 != 2, 50 + k % 3 * 25).alias("ratio")
    )
    return quality.without_digit_errors(rows, ["tab"], "deposit", "area", "ratio").select("id", "deposit", "error")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS units, CASE WHEN l_linenumber <> 6 THEN l_suppkey % 60 END AS online, CASE WHEN l_linenumber <> 7 THEN l_partkey % 40 END AS visit, l_suppkey % 60 + l_partkey % 40 + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS true_total FROM lineitem),
c AS (SELECT *, CASE WHEN l_linenumber <> 5 THEN true_total END AS total, CASE WHEN l_linenumber % 7 <> 3 THEN round(CAST(true_total AS DECIMAL(18,6)) / units, 1)::DOUBLE * CASE WHEN l_linenumber = 4 THEN 10 WHEN l_linenumber = 1 THEN 3 ELSE 1 END END AS ratio FROM l),
d AS (SELECT *, online IS NOT NULL AND visit IS NOT NULL AND coalesce(total = online + visit, FALSE) AS sum_ok, CASE WHEN units > 0 THEN round(CAST(total AS DECIMAL(18,6)) / units, 1)::DOUBLE END AS derived FROM c),
e AS (SELECT *, coalesce(abs(ratio - derived) <= 0.15, FALSE) AS near, total IS NULL AND coalesce(ratio > 0, FALSE) AS made,
 coalesce(derived > 0 AND ratio <> derived AND rtrim(replace(printf('%.1f', ratio), '.', ''), '0') = rtrim(replace(printf('%.1f', derived), '.', ''), '0'), FALSE) AS dropped FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN made THEN CAST(round_even(ratio * units, 0) AS BIGINT) ELSE total END AS total, CASE WHEN sum_ok AND derived IS NOT NULL AND NOT near THEN derived ELSE ratio END AS ratio,
sum_ok OR made OR near OR dropped AS ok, (sum_ok AND derived IS NOT NULL AND NOT near) OR made AS repaired FROM e""")
def competition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of applicants with lost cells, wrong sums and ratios without their point, put right by what else they say."""
    n, units, whole = F.col("l_linenumber"), F.col("l_quantity").cast("long"), F.col("l_suppkey") % 60 + F.col("l_partkey") % 40
    true_total = whole + F.when(n == 2, 1).otherwise(0)
    printed = F.round(true_total.cast("decimal(18,6)") / units, 1).cast("double") * F.when(n == 4, 10).when(n == 1, 3).otherwise(1)
    row = glyphs.competition(units, F.when(n != 6, F.col("l_suppkey") % 60), F.when(n != 7, F.col("l_partkey") % 40), F.when(n != 5, true_total), F.when(n % 7 != 3, printed))
    return line_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", row.alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.*")


LABELS = ("60㎡ 이하", "60㎡ 초과 85㎡ 이하", "50㎡ 미만", "전용 39.5 ㎡ 이상", "면적 무관", "")


@query(f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN {sql_pick(LABELS, 'p_partkey % 6')} END AS label, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE WHEN label IS NOT NULL THEN CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 60.0 WHEN 2 THEN 0.0 WHEN 3 THEN 39.5 END END::DOUBLE AS low, CASE WHEN label IS NOT NULL THEN CASE k WHEN 0 THEN 60.0 WHEN 1 THEN 85.0 WHEN 2 THEN 50.0 END END::DOUBLE AS high FROM t""")
def area_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    band = money.area_band(F.when(k % 13 != 0, pick(LABELS, k % 6)))
    return read_table(spark, sf_dir, "part").select("p_partkey", band.alias("b")).select("p_partkey", "b.low", "b.high")


RESULT_SQL = """old AS (SELECT l_orderkey AS post, l_linenumber AS row_no, CAST(min(l_quantity) AS BIGINT) AS units FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
posts AS (SELECT o_orderkey AS post FROM orders WHERE o_orderkey % 3 = 0), batch AS (SELECT l_orderkey AS post, l_linenumber AS row_no, CAST(l_quantity AS BIGINT) + 100 AS units, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0)"""


def posts_read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = line_items(spark, sf_dir)
    key = [F.col("l_orderkey").alias("post"), F.col("l_linenumber").alias("row_no")]
    lines = li.filter("l_orderkey % 2 = 0").select(*key, "l_quantity")
    old = lines.repartition(relational.tasks_for(lines), "post").groupBy("post", "row_no").agg(F.min("l_quantity").cast("long").alias("units"))
    batch = li.filter("l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0").select(*key, (F.col("l_quantity").cast("long") + 100).alias("units"), (F.col("l_partkey") * 100 + F.col("l_quantity")).alias("place"))
    o = read_table(spark, sf_dir, "orders")
    ledger = o.select(F.col("o_orderkey").alias("post"), F.lit(-1).cast("long").alias("row_count"), F.lit(None).cast("date").alias("parsed_at"), F.lit("old").alias("note"))
    posts = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("post"))
    return merge.replace_by_post(old, ledger, batch, posts, ["post", "row_no"], "place", F.lit("2026-01-01").cast("date"), "no table")


@query(f"""WITH {RESULT_SQL} SELECT post, row_no, units FROM old WHERE post NOT IN (SELECT post FROM posts)
UNION ALL SELECT post, row_no, units FROM batch QUALIFY row_number() OVER (PARTITION BY post, row_no ORDER BY l_partkey * 100 + units) = 1""")
def results_by_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of results after some posts were read again."""
    return posts_read(spark, sf_dir)[0]


@query(f"""WITH {RESULT_SQL}, n AS (SELECT post, count(*) AS n FROM batch GROUP BY 1) SELECT o_orderkey AS post, CASE WHEN p.post IS NULL THEN -1 ELSE coalesce(n, 0) END AS row_count, CASE WHEN p.post IS NOT NULL THEN '2026-01-01' END AS parsed_at,
CASE WHEN p.post IS NULL THEN 'old' WHEN n IS NULL THEN 'no table' END AS note FROM orders LEFT JOIN posts p ON p.post = o_orderkey LEFT JOIN n ON n.post = o_orderkey""")
def ledger_by_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the posts that were read again: how many rows each gave, when, and a note for those without any."""
    ledger = posts_read(spark, sf_dir)[1]
    return ledger.select("post", "row_count", F.col("parsed_at").cast("string").alias("parsed_at"), "note")


@query("""WITH f AS (SELECT c_custkey AS place, 'road ' || CAST(c_custkey % 400 AS VARCHAR) AS address, c_acctbal AS lon FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT address, arg_min(lon, place) AS lon FROM f GROUP BY 1),
old AS (SELECT 'road ' || CAST(p_partkey AS VARCHAR) AS address, CAST(p_partkey AS DOUBLE) AS lon FROM part WHERE p_partkey < 500)
SELECT coalesce(o.address, old.address) AS address, coalesce(o.lon, old.lon) AS lon FROM o FULL JOIN old USING (address)""")
def matches_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of matches after a run: a row for each normalised address, whatever ways places spell it."""
    c, part = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "part")
    address = F.concat(F.lit("road "), (F.col("c_custkey") % 400).cast("string"))
    places = c.select(F.col("c_custkey").alias("place"), *[F.lit(None).cast(t).alias(n) for n, t in (("lon", "double"), ("lat", "double"), ("precision", "string"))])
    found = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("place"), address.alias("address"), F.col("c_acctbal").alias("lon"), F.lit(1.0).alias("lat"), F.lit("road").alias("precision"))
    old = part.filter("p_partkey < 500").select(F.concat(F.lit("road "), F.col("p_partkey").cast("string")).alias("address"), F.col("p_partkey").cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.lit("building").alias("precision"))
    return merge.write_matches(places, old, found)[1].select("address", "lon")


@query("""WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['C'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS held, CASE c_custkey % 3 WHEN 0 THEN ['B', 'C'] WHEN 1 THEN CAST([] AS VARCHAR[]) END AS allowed FROM customer)
SELECT id, CASE WHEN allowed IS NULL OR len(allowed) = 0 THEN TRUE ELSE list_has_any(held, allowed) END AS ok, CASE WHEN held IS NOT NULL AND allowed IS NOT NULL THEN array_to_string(list_sort(list_intersect(held, allowed)), ',') END AS common FROM a""")
def one_of_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of an array's values is among those allowed, and which are."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    a = read_table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, F.array(F.lit("A"), F.lit("B"))).when(k % 4 == 1, F.array(F.lit("C"))).when(k % 4 == 2, none).alias("held"),
        F.when(k % 3 == 0, F.array(F.lit("B"), F.lit("C"))).when(k % 3 == 1, none).alias("allowed"),
    )
    return a.select("id", rules.one_of(F.col("held"), F.col("allowed")).alias("ok"), F.array_join(F.array_sort(F.array_intersect("held", "allowed")), ",").alias("common"))


@query(r"""SELECT p_partkey, lower(regexp_replace(coalesce(p_name, ''), '\s+', '', 'g')) || '|' || lower(regexp_replace(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_type END, ''), '\s+', '', 'g')) AS key, replace(replace(url_encode(p_brand || ' ' || p_name), '+', '%20'), '*', '*') AS path,
nullif(trim(CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END), '') AS name FROM part""")
def search_keys_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of several fields that a search looks in, a name as part of a path, and blanks as nothing."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", text.search_key(name, F.when(k % 3 != 0, F.col("p_type"))).alias("key"), text.url_path(F.concat_ws(" ", "p_brand", name)).alias("path"),
        text.blank_to_null(F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), name, F.lit(" ")))).alias("name"),
    )


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_size - 10 END AS age FROM part) SELECT id, CASE WHEN age IS NOT NULL THEN greatest(0, least(30, age)) END AS age FROM p""")
def clamped_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") - 10)
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rules.clamp(age, 0, 30).alias("age"))
