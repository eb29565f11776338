"""Titles of notices and results, and names of estates, composed for each order of what real ones are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import titles
from noticelake.functions.text import name_key_a
from noticelake.registry import query
from noticelake.session import read_table

TITLES = (
    ("매입임대", "[경남지역본부]26년 3차 분양전환형 든든전세주택 예비입주자 모집 공고"),
    ("장기전세", "제8차 장기전세주택2(미리내집) 입주자 모집 공고(2026. 8. 21.)"),
    ("매입임대", "2025년 1차 미리내집 입주자 모집공고(신혼·신생아 매입임대주택Ⅱ)"),
    ("매입임대", "2022년 장기미임대 매입임대주택(다가구,원룸) 입주자 수시 모집공고(1차) (2022.1.21.)"),
    ("매입임대", "[인천]26년 7차 신혼·신생아Ⅱ(전세형) 예비입주자 모집공고(인천,부천)"),
    ("매입임대", "2026년 1차 기숙사형 청년주택 입주자모집 공고(2026.06.26.)"),
    ("매입임대", "[전남광주통합특별시] 기존주택 등 매입임대주택 예비입주자 모집 공고"),
    ("매입임대", "2026년 만리동 예술인 협동조합주택(막쿱) 잔여세대 입주자 모집공고(2026. 6. 25.)"),
    ("전세임대", "2026년 신혼·신생아 전세임대Ⅱ 입주자 수시모집 공고"),
    ("영구임대", "동해천곡 고령자복지주택(영구임대) 입주자 모집"),
    ("행복주택", "[정정]2025년 3차 행복주택 입주자 모집공고(2025.12.31.공고)"),
    ("행복주택", "2025년 1차 행복주택 입주자 모집(2025.04.25.공고) 최종 청약 경쟁률 게시"),
    ("재개발임대", "2025년 재개발임대주택 예비4차 당첨자 발표(2025.10.24.공고)"),
    ("매입임대", "[당첨자발표] 2026년 다자녀 매입임대주택 입주자모집공고(2026. 5. 29.) 당첨자 및 예비자 발표"),
    ("국민임대", "2021년 제1차 국민임대주택 입주자모집(2021.9.24.공고) 청약접수 결과안내"),
    ("기타", "2026년 청년 체험형 인턴 서류전형 합격자 발표 및 면접전형 대상자 안내"),
    ("기타", "위례지구 A1-5,12BL 특별공급(신혼부부, 다자녀) 청약접수 결과 게시"),
    ("기타", "2026년 1차 임대상가 재공급 모집공고"),
    ("행복주택", "서울리츠 2차 행복주택 잔여공가 입주자 모집공고_수정게시"),
    ("기타", "고덕강일 공공주택지구 8, 14단지 입주자모집공고"),
)
NAMES = ("신림역 166 tower 청년안심주택(민간)", "상림마을6-1단지(은평1-8,임대)", "e편한세상 한강VIEW 아파트", "미아 헤리츠(하월곡 청년주택, AB)", "[SH] 가·나_다.라 오피스텔")


def values_sql(rows: tuple, names: str) -> str:
    """A list of rows as a relation with their place."""
    cells = (", ".join("'" + str(v).replace("'", "''") + "'" for v in (r if isinstance(r, tuple) else (r,))) for r in rows)
    return f"(VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(cells))}) AS sample(place, {names})"


#: What a title may open with and end in, and the first of its years.
OPENINGS = ("", "", "[정정]", "(수정)", "[수정공고] ", "[2차] ")
ENDINGS = ("", "", "_수정게시", " - 재공고", " (일정 정정)")
FIRST_YEAR, YEARS = 2013, 14


def texts_sql(values: tuple, at: str) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + f"][1 + CAST({at} AS INTEGER)]"


TITLE_SQL = f"""title AS (SELECT o_orderkey AS id, kind, {texts_sql(OPENINGS, 'o_orderkey // 20 % 6')} || regexp_replace(title, '20[0-9][0-9]년', CAST({FIRST_YEAR} + o_orderkey // 600 % {YEARS} AS VARCHAR) || '년')
  || {texts_sql(ENDINGS, 'o_orderkey // 120 % 5')} AS title FROM orders JOIN {values_sql(TITLES, 'kind, title')} ON o_orderkey % {len(TITLES)} = place)"""
NAME_SQL = f"""named AS (SELECT o_orderkey AS id, name || ' ' || CAST(o_orderkey // {len(NAMES)} % 40 + 1 AS VARCHAR) || '단지' || CASE WHEN o_orderkey % 7 = 0 THEN ' (A' || CAST(o_orderkey // 200 % 9 AS VARCHAR) || ')' ELSE '' END AS name
  FROM orders JOIN {values_sql(NAMES, 'name')} ON o_orderkey % {len(NAMES)} = place)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, title: one of TITLES with an opening, a year and an ending, each by another digit of the order's number."""
    k = F.col("o_orderkey")

    def digit(unit: int, base: int) -> Column:
        return (F.floor(k / unit) % base).cast("int")

    sample = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("title")) for kind, t in TITLES])
    rows = read_table(spark, sf_dir, "orders").select(k.alias("id"), k.alias("o_orderkey"), sample[digit(1, len(TITLES))].alias("s"))
    year = F.concat((digit(600, YEARS) + FIRST_YEAR).cast("string"), F.lit("년"))
    opening, ending = (F.array(*map(F.lit, v)) for v in (OPENINGS, ENDINGS))
    title = F.concat(opening[digit(20, len(OPENINGS))], F.regexp_replace("s.title", F.lit("20[0-9][0-9]년"), year), ending[digit(120, len(ENDINGS))])
    return rows.select("id", "s.kind", title.alias("title"))


@query(f"""WITH {TITLE_SQL}, n AS (SELECT id, kind, translate(regexp_replace(title, '[\\s·ㆍ.\\-–—_''"‧]', '', 'g'), 'ⅡⅠ', '21') AS t FROM title),
f AS (SELECT *, kind = '매입임대' AS buy, contains(t, '든든전세') AS safe, contains(t, '매입') OR contains(t, '기숙사형') AS bought,
  kind = '매입임대' AND (contains(t, '장기미임대') OR contains(t, '미임대(원룸)')) AS vacant FROM n)
SELECT id, concat_ws(',', 
  CASE WHEN safe THEN '든든전세' END, CASE WHEN contains(t, '미리내집') THEN '미리내집' END, CASE WHEN vacant THEN '장기미임대' END,
  CASE WHEN buy AND NOT safe AND (contains(t, '신생아') OR (contains(t, '신혼') AND (bought OR contains(t, '미리내집')))) THEN '신혼신생아 매입임대' END,
  CASE WHEN buy AND NOT safe AND contains(t, '청년') AND bought THEN '청년 매입임대' END,
  CASE WHEN buy AND NOT safe AND contains(t, '다자녀') AND bought THEN '다자녀 매입임대' END,
  CASE WHEN buy AND NOT safe AND NOT vacant AND ((contains(regexp_replace(t, '일반(주택형|형|공급)', '', 'g'), '일반') AND bought) OR contains(t, '기존주택등매입') OR contains(t, '다가구')) THEN '일반 매입임대' END,
  CASE WHEN buy AND contains(t, '공공전세') THEN '공공전세주택' END,
  CASE WHEN kind = '전세임대' AND (contains(t, '신혼') OR contains(t, '신생아')) THEN '신혼신생아 전세임대' END,
  CASE WHEN buy AND regexp_matches(t, '{"|".join(titles.SPECIAL_WORDS)}') THEN '특화형 매입임대' END,
  CASE WHEN contains(t, '고령자복지주택') THEN '고령자복지주택' END) AS programs FROM f""")
def title_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = titles.programs(F.col("title"), F.col("kind"))
    return titled(spark, sf_dir).select("id", F.array_join(found, ",").alias("programs"))


TYPE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({{0}}, '{p}') OR regexp_matches(replace({{0}}, ' ', ''), '{p}') THEN '{label}'" for label, p in titles.TYPE_RULES
) + " END"


@query(f"""WITH {TITLE_SQL} SELECT id, {TYPE_SQL.format("title")} AS housing_type FROM title""")
def title_housing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("id", titles.housing_type(F.col("title")).alias("housing_type"))


NOTICE_WORDS = "|".join((*titles.NO_NOTICE, *titles.NO_LEASE))


@query(f"""WITH {TITLE_SQL} SELECT id, (regexp_matches(title, '입주자\\s*모집') OR (contains(title, '모집') AND contains(title, '공고')))
  AND NOT regexp_matches(title, '{NOTICE_WORDS}') AS is_notice FROM title""")
def title_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("id", titles.is_notice(F.col("title")).alias("is_notice"))


@query(f"""WITH {TITLE_SQL}, b AS (SELECT *, regexp_replace(title, '^\\s*\\[[^\\]]*(?:발표|공고|모집)[^\\]]*\\]\\s*', '') AS body,
  {TYPE_SQL.format("title")} AS housing_type, regexp_extract(title, '\\(\\s*(\\d{{4}})[.]\\s*(\\d+)[.]\\s*(\\d+)\\s*[.]?\\s*(?:공고)?\\s*\\)', ['y', 'm', 'd']) AS day FROM title),
k AS (SELECT *, CASE WHEN regexp_matches(body, '{"|".join(titles.RATES)}') THEN 'competition' WHEN regexp_matches(body, '{"|".join(titles.WINNERS)}') THEN 'winner' END AS kind_of FROM b)
SELECT id, kind_of AS kind, CASE WHEN day.y <> '' THEN day.y || '-' || lpad(day.m, 2, '0') || '-' || lpad(day.d, 2, '0') END AS notice_day,
  TRY_CAST(nullif(regexp_extract(title, '예비\\s*(\\d+)\\s*차', 1), '') AS INTEGER) AS reserve_round, housing_type FROM k
WHERE kind_of IS NOT NULL AND NOT regexp_matches(body, '{"|".join(titles.HIRING + titles.NOT_LET)}')
  AND CASE WHEN kind_of = 'winner' THEN NOT regexp_matches(body, '{"|".join(titles.FOLLOW_UPS)}') ELSE housing_type IS NOT NULL END""")
def result_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titled(spark, sf_dir).select("id", titles.result_post(F.col("title")).alias("p")).filter("p IS NOT NULL")
    return rows.select("id", "p.kind", F.col("p.notice_day").cast("string").alias("notice_day"), "p.reserve_round", "p.housing_type")


@query(f"""WITH {TITLE_SQL}, n AS (SELECT id, kind, regexp_replace(title, '\\s+', '', 'g') AS t FROM title) SELECT id,
CASE WHEN contains(t, '청년매입임대') OR contains(t, '청년주택매입') THEN '청년매입임대' WHEN contains(t, '신혼신생아') OR contains(t, '미리내집') THEN '신혼신생아'
WHEN contains(t, '장기미임대') THEN '장기미임대' WHEN contains(t, '다자녀') THEN '다자녀' WHEN contains(t, '자립준비청년') THEN '자립준비청년' WHEN contains(t, '서울리츠') THEN kind || '서울리츠'
WHEN contains(t, '잔여세대') OR contains(t, '잔여공가') THEN kind || '잔여' ELSE kind END AS family FROM n""")
def notice_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("id", titles.notice_family(F.col("title"), F.col("kind")).alias("family"))


@query(f"""WITH {TITLE_SQL}, n AS (SELECT id, kind, replace(replace(replace(replace(regexp_replace(title, '[\\s·.\\-–—_''"]', '', 'g'), 'Ⅱ', '2'), 'II', '2'), 'Ⅰ', '1'), 'I', '1') AS t FROM title),
f AS (SELECT *, contains(t, '신혼') OR contains(t, '신생아') AS newly, contains(t, '전세형') AS lease, regexp_extract(t, '(?:신혼|신생아)(?:부부)?[^0-9,]{{0,8}}([12])', 1) AS num,
  contains(regexp_replace(t, '일반(주택형|형)', '', 'g'), '일반') OR contains(t, '기존주택') AS general FROM n),
g AS (SELECT *, newly AND NOT lease AND num <> '2' AS first, newly AND (lease OR num <> '1') AS second FROM f)
SELECT id, CASE WHEN kind = '매입임대' AND contains(t, '든든전세') THEN 'safe' WHEN kind = '매입임대' THEN concat_ws(',', 
  CASE WHEN contains(t, '장기미임대') THEN 'buy_long' END, CASE WHEN contains(t, '공공전세') THEN 'pub_ls' END, CASE WHEN contains(t, '청년') OR contains(t, '기숙사형') THEN 'buy_youth' END,
  CASE WHEN contains(t, '미리내집') THEN 'buy_new2' END, CASE WHEN first THEN 'buy_new1' END, CASE WHEN second AND NOT contains(t, '미리내집') THEN 'buy_new2' END,
  CASE WHEN general OR contains(t, '다자녀') OR contains(t, '한부모') THEN 'buy_gen' END)
WHEN kind = '전세임대' THEN concat_ws(',', CASE WHEN contains(t, '청년') THEN 'ls_youth' END, CASE WHEN contains(t, '다자녀') THEN 'ls_multi' END,
  CASE WHEN first THEN 'ls_new1' END, CASE WHEN second THEN 'ls_new2' END, CASE WHEN general THEN 'ls_gen' END) ELSE '' END AS codes FROM g""")
def recruited_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("id", F.array_join(titles.recruited_types(F.col("title"), F.col("kind")), ",").alias("codes"))


@query(rf"""WITH {TITLE_SQL}, a AS (SELECT id, trim(title) AS t, regexp_extract(trim(title), '^[(\[（][^)\]）]*[)\]）]') AS m FROM title),
b AS (SELECT id, t AS whole, CASE WHEN regexp_matches(m, '수정|정정|변경|재공고') AND length(trim(substr(t, length(m) + 1))) >= 10 THEN trim(substr(t, length(m) + 1)) ELSE t END AS t FROM a),
c AS (SELECT *, regexp_extract(t, '[(\[（][^)\]）]*[)\]）]$') AS m FROM b),
d AS (SELECT id, whole, CASE WHEN regexp_matches(m, '수정|정정|변경|재공고') AND length(trim(left(t, length(t) - length(m)))) >= 10 THEN trim(left(t, length(t) - length(m))) ELSE t END AS t FROM c),
e AS (SELECT id, whole, CASE WHEN length(trim(regexp_replace(t, '[_-]\s*(수정|정정|변경|재공고)[^\s_-]*$', ''))) >= 10 THEN trim(regexp_replace(t, '[_-]\s*(수정|정정|변경|재공고)[^\s_-]*$', '')) ELSE t END AS t FROM d)
SELECT id, regexp_replace(t, '[\s.·・]', '', 'g') AS title_key, t <> whole AS amended FROM e""")
def amended_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return titled(spark, sf_dir).select("id", titles.title_key(t).alias("title_key"), titles.is_amendment(t).alias("amended"))


@query(rf"""WITH {NAME_SQL}, p AS (SELECT id, name, regexp_replace(name, '\([^)]*\)', '', 'g') AS bare FROM named)
SELECT id, lower(regexp_replace(bare, '[\]\[_.,·・\s-]', '', 'g')) AS key_a, regexp_replace(lower(bare), '[\s\[\]_.,·・-]', '', 'g') AS key_b,
replace(replace(replace(replace(replace(replace(upper(regexp_replace(regexp_replace(bare, '^[가-힣A-Za-z0-9]{{2,10}}역\s+', ''), '[\s\-_\[\]·,]', '', 'g')), 'TOWER', '타워'), '청년안심주택', ''), '청년주택', ''),
 '역세권청년주택', ''), '아파트', ''), '오피스텔', '') AS key_e,
replace(replace(replace(upper(regexp_replace(bare, '[\s\-_\[\]·]', '', 'g')), 'VIEW', '뷰'), '이편한세상', 'E편한세상'), '아파트', '') AS key_f FROM p""")
def name_keys_a_to_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    block = F.when(k % 7 == 0, F.concat(F.lit(" (A"), (F.floor(k / 200) % 9).cast("string"), F.lit(")"))).otherwise("")
    name = F.concat(F.array(*map(F.lit, NAMES))[k % len(NAMES)], F.lit(" "), (F.floor(k / len(NAMES)) % 40 + 1).cast("string"), F.lit("단지"), block)
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"))
    n = F.col("name")
    return rows.select(
        "id", name_key_a(n).alias("key_a"), titles.name_key_b(n).alias("key_b"), titles.name_key_e(n).alias("key_e"), titles.name_key_f(n).alias("key_f")
    )


@query("""WITH c AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 8 AS kind FROM orders)
SELECT id, CAST(CASE kind WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v / 10.0 WHEN 3 THEN v WHEN 4 THEN CASE WHEN v < 1000 THEN v + 0.5 END WHEN 5 THEN v / 100.0 WHEN 7 THEN v END AS DOUBLE) AS amount FROM c""")
def money_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of price tables: with commas, with points typed for them, a comma for a point, a currency's signs, torn groups, nothing."""
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    commas = F.format_number(v, 0)
    forms = [
        commas, F.replace(commas, F.lit(","), F.lit(".")), F.concat(F.floor(v / 10).cast("string"), F.lit(","), (v % 10).cast("string")), F.concat(F.lit("￦ "), commas, F.lit("원")),
        F.concat(commas, F.lit(",5")), F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0")), F.lit("미정"), F.concat(F.lit(" "), v.cast("string")),
    ]
    cell = F.coalesce(*[F.when(k % len(forms) == i, f) for i, f in enumerate(forms)])
    return read_table(spark, sf_dir, "orders").select(k.alias("id"), titles.money_cell(cell).cast("double").alias("amount"))
