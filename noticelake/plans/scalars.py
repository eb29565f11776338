"""Text, date and money functions, classifiers and tallies of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import dates, money, text
from noticelake.functions.titles import let
from noticelake.plans.base import AS_OF, NOTICE_SQL, as_of, notices, shown
from noticelake.registry import query
from noticelake.session import read_table
from noticelake.streaming.page_views import is_robot

NORM_SQL = r"lower(regexp_replace(coalesce({}, ''), '[\s\x{{00A0}}\x{{3000}}]+', '', 'g'))"


@query(f"SELECT doc_id, length({NORM_SQL.format('text')}) AS n, md5({NORM_SQL.format('text')}) AS h FROM documents WHERE {NORM_SQL.format('text')} LIKE '%thea%'")
def search_norm_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = let(text.search_norm(F.col("text")), lambda t: F.when(t.contains("thea"), F.struct(F.length(t).alias("n"), F.md5(t).alias("h"))))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", found.alias("f"))
    return rows.filter("f IS NOT NULL").select("doc_id", "f.n", "f.h")


@query(r"SELECT doc_id FROM documents WHERE text LIKE '%100\%%' ESCAPE '\' OR text LIKE '%a\_b%' ESCAPE '\'")
def like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = [F.col("text").like(f"%{text.like_escape(t)}%") for t in ("100%", "a_b")]
    return read_table(spark, sf_dir, "documents").filter(hit[0] | hit[1]).select("doc_id")


KEY_D_SQL = r"regexp_replace(p_name, '[\s,.()\[\]]', '', 'g')"


@query(rf"""SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '\([^)]*\)', '', 'g'), '[\]\[_.,·・\s-]', '', 'g')) AS key_a,
replace(replace(regexp_replace(p_name, '[\s\x{{00A0}}\x{{3000}}]+', '', 'g'), 'Part', ''), '#', '') AS key_c, {KEY_D_SQL} AS key_d FROM part""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", text.name_key_a(name).alias("key_a"), text.name_key_c(name, ["Part", "#"]).alias("key_c"), text.name_key_d(name).alias("key_d")
    )


@query(f"""WITH {NOTICE_SQL} SELECT id, sha256(agency || '|' || housing_type || '|' || CAST(posted_at AS VARCHAR) || '|' ||
coalesce(CAST(nullif(source_rank, 0) AS VARCHAR), '') || '|' || coalesce(CAST(canonical_id AS VARCHAR), '')) AS fingerprint FROM notice""")
def fingerprint_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.fingerprint(F.col("agency"), F.col("housing_type"), F.col("posted_at"), F.col("source_rank"), F.col("canonical_id").cast("string"))
    return notices(spark, sf_dir).select("id", made.alias("fingerprint"))


@query(r"""SELECT p_partkey, CASE WHEN length(trim(regexp_replace(p_type, '^[A-Z]+ ', ''))) >= 10 THEN trim(regexp_replace(p_type, '^[A-Z]+ ', '')) ELSE p_type END AS base FROM part""")
def amendment_base_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", text.shorten_if_long(F.col("p_type"), "^[A-Z]+ ").alias("base"))


RULES = [("steel", "STEEL"), ("small", "^SMALL"), ("first", "1"), ("any", ".")]


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE 'SMALL%' THEN 'small' WHEN contains(p_type, '1') THEN 'first' ELSE 'any' END AS label FROM part""")
def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(pattern, label) for label, pattern in RULES]
    return read_table(spark, sf_dir, "part").select("p_partkey", text.first_match(F.col("p_type"), rules).alias("label"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_type, 'STEEL') THEN 'steel' END, CASE WHEN contains(p_type, 'PROMO') AND NOT contains(p_type, 'STEEL') THEN 'promo' END,
CASE WHEN contains(p_name, '7') THEN 'seven' END) AS tags FROM part""")
def program_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.tags(F.concat_ws(" ", "p_type", "p_name"), [("steel", "STEEL", None), ("promo", "PROMO", "STEEL"), ("seven", "7", None)])
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("tags"))


HOSTS = [("example.com", "search"), ("example.org", "social"), ("example.net", "portal")]


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), c AS (SELECT page_id, CASE WHEN host = '' THEN 'direct'
 WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'search' WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'social'
 WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'portal' ELSE 'host:' || host END AS channel, host FROM h)
SELECT channel, count(*) AS views, count(DISTINCT host) AS hosts FROM c GROUP BY channel""")
def channel_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(""))
    rows = read_table(spark, sf_dir, "pages").select(host.alias("host")).withColumn("channel", text.channel(F.col("host"), HOSTS))
    return rows.groupBy("channel").agg(F.count("*").alias("views"), F.countDistinct("host").alias("hosts"))


@query("""SELECT page_id, CASE WHEN path LIKE '/en%' THEN 'english' WHEN path LIKE '/de%' THEN 'german' ELSE 'other' END AS kind FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)""")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    return read_table(spark, sf_dir, "pages").select("page_id", text.path_kind(path, [("/en", "english"), ("/de", "german")]).alias("kind"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || '-' || p_type), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_brand"), F.col("p_type")).alias("slug"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read_table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query("SELECT c_custkey, regexp_replace(c_name, '^\\s*\\[[^]]*\\]\\s*|^Customer#', '') AS title FROM customer")
def title_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace("c_name", "^\\s*\\[[^\\]]*\\]\\s*|^Customer#", "").alias("title"))


@query("SELECT p_partkey, nullif(TRY_CAST(regexp_extract(p_name, '([0-9]+)$', 1) AS BIGINT), 0) AS amount, TRY_CAST(p_brand AS BIGINT) AS no_number FROM part")
def null_safe_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", money.amount(F.regexp_extract("p_name", "([0-9]+)$", 1)).alias("amount"), money.amount(F.col("p_brand"), False).alias("no_number")
    )


STATUS_SQL = f"""WITH {NOTICE_SQL} SELECT id,
CASE WHEN apply_end < DATE '{AS_OF}' THEN 'closed' WHEN announce < DATE '{AS_OF}' THEN 'closed' WHEN contains(agency, 'URGENT') THEN 'amended' WHEN posted_at <= DATE '{AS_OF}' THEN 'open' ELSE 'announced' END AS api,
CASE WHEN status = 'F' OR (announce < DATE '{AS_OF}' AND status IS DISTINCT FROM 'O') THEN 'closed' WHEN contains(agency, 'HIGH') THEN 'amended' WHEN status = 'O' THEN 'open' ELSE 'announced' END AS portal,
CASE WHEN posted_at IS NULL OR DATE '{AS_OF}' < posted_at THEN 'announced' WHEN DATE '{AS_OF}' <= coalesce(apply_end, posted_at + 7) THEN 'open' ELSE 'closed' END AS board FROM notice"""


@query(STATUS_SQL)
def status_derive_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir)
    state = F.when(F.col("status") == "F", "ended").when(F.col("status") == "O", "running").otherwise(F.col("status"))
    source = F.when(F.col("agency").contains("URGENT"), "amend").otherwise("")
    return n.select(
        "id",
        dates.status_api(F.col("apply_end"), F.col("announce"), source, F.col("posted_at"), as_of()).alias("api"),
        dates.status_portal(state, F.col("announce"), F.col("agency").contains("HIGH"), F.lit(False), as_of()).alias("portal"),
        dates.status_board(F.col("posted_at"), F.col("apply_end"), as_of()).alias("board"),
    )


@query(f"""WITH {NOTICE_SQL} SELECT id, date_diff('day', DATE '{AS_OF}', apply_end) AS d_day, CASE WHEN apply_end < DATE '{AS_OF}' THEN 'past'
WHEN posted_at > DATE '{AS_OF}' THEN CASE WHEN date_diff('day', DATE '{AS_OF}', posted_at) <= 4 THEN 'soon' ELSE 'before' END
WHEN date_diff('day', DATE '{AS_OF}', apply_end) < 7 THEN 'closing' ELSE 'open' END AS phase FROM notice""")
def dday_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir)
    return n.select(
        "id", F.datediff("apply_end", as_of()).cast("long").alias("d_day"), dates.phase(F.col("posted_at"), F.col("apply_end"), as_of()).alias("phase")
    )


@query("""SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n, strftime(min(ts) + INTERVAL 9 HOUR, '%H:%M') AS first FROM events GROUP BY 1""")
def kst_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.from_utc_timestamp(F.min("ts"), dates.ZONE)
    days = read_table(spark, sf_dir, "events").groupBy(dates.local_day(F.col("ts")).alias("day"))
    return shown(days.agg(F.count("*").alias("n"), F.date_format(local, "HH:mm").alias("first")))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '20241340' ELSE 'x' END AS raw FROM orders)
SELECT o_orderkey, CAST(CASE WHEN regexp_full_match(raw, '[0-9]{8}') THEN CAST(try_strptime(raw, '%Y%m%d') AS DATE) END AS VARCHAR) AS strict,
CAST(CASE WHEN regexp_full_match(regexp_replace(raw, '[-.]', '', 'g'), '[0-9]{8}') THEN CAST(try_strptime(regexp_replace(raw, '[-.]', '', 'g'), '%Y%m%d') AS DATE) END AS VARCHAR) AS loose FROM t""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("o_orderkey") % 4
    raw = (
        F.when(case == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(case == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(case == 2, "20241340").otherwise("x")
    )
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return shown(rows.select("o_orderkey", dates.parse_day(F.col("raw")).alias("strict"), dates.parse_marked_day(F.col("raw")).alias("loose")))


@query(f"""WITH {NOTICE_SQL} SELECT agency, count(*) AS n, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY date_diff('day', posted_at, apply_end) + 1) AS DECIMAL(12,1))::DOUBLE AS open_days,
CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY date_diff('day', apply_end, announce)) FILTER (WHERE announce > apply_end) AS DECIMAL(12,1))::DOUBLE AS to_announce
FROM notice WHERE posted_at >= DATE '{AS_OF}' - 730 AND apply_end >= posted_at GROUP BY agency HAVING count(*) >= 30""")
def schedule_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).filter((F.col("posted_at") >= F.date_sub(as_of(), 730)) & (F.col("apply_end") >= F.col("posted_at")))
    gap = F.when(F.col("announce") > F.col("apply_end"), F.datediff("announce", "apply_end"))
    return n.groupBy("agency").agg(
        F.count("*").alias("n"),
        F.percentile(F.datediff("apply_end", "posted_at") + 1, 0.5).cast("decimal(12,1)").cast("double").alias("open_days"),
        F.percentile(gap, 0.5).cast("decimal(12,1)").cast("double").alias("to_announce"),
    ).filter("n >= 30")


@query(f"""WITH {NOTICE_SQL}, v AS (SELECT id, min_deposit * 1000 AS d, min_rent * 1000 AS r, min_deposit * 1000 + CASE WHEN id % 2 = 0 THEN 3000000 ELSE -50000 END AS nd FROM notice WHERE min_deposit IS NOT NULL AND min_rent IS NOT NULL),
m AS (SELECT *, CAST(floor(abs(nd - d) * CASE WHEN nd >= d THEN 6.0::DOUBLE ELSE 2.5::DOUBLE END / 1200 + 0.5) AS BIGINT) AS monthly FROM v)
SELECT id, greatest(0, CAST(floor(CAST(CASE WHEN nd >= d THEN r - monthly ELSE r + monthly END AS DOUBLE) / 100) * 100 AS BIGINT)) AS rent,
CAST(floor(d * 0.5::DOUBLE + 0.5) AS BIGINT) AS low, d + CAST(floor(r * 0.5::DOUBLE * 1200 / 6.0::DOUBLE + 0.5) AS BIGINT) AS high FROM m""")
def convert_rent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).filter("min_deposit IS NOT NULL AND min_rent IS NOT NULL")
    d, r = F.col("min_deposit") * 1000, F.col("min_rent") * 1000
    new = d + F.when(F.col("id") % 2 == 0, 3_000_000).otherwise(-50_000)
    low, high = money.conversion_range(d, r)
    return n.select("id", money.converted_rent(d, r, new).alias("rent"), low.alias("low"), high.alias("high"))


@query("""SELECT o_orderkey, CAST(floor(p * 0.04::DOUBLE / 12 + 0.5) AS BIGINT) AS bullet, CAST(floor(p * (4.0::DOUBLE / 1200) * power(1 + 4.0::DOUBLE / 1200, 120) / (power(1 + 4.0::DOUBLE / 1200, 120) - 1) + 0.5) AS BIGINT) AS annuity,
CAST(floor(p / 120 + p * 4.0::DOUBLE / 1200 + 0.5) AS BIGINT) AS first FROM (SELECT o_orderkey, floor(o_totalprice) AS p FROM orders)""")
def loan_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.floor("o_totalprice").cast("double")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", money.half_up(money.bullet_interest(p, 4.0)).alias("bullet"), money.half_up(money.annuity(p, 4.0, 120)).alias("annuity"),
        money.half_up(money.equal_principal_first(p, 4.0, 120)).alias("first"),
    )


@query("""SELECT id, CASE WHEN won IS NULL THEN '-' ELSE concat_ws(' ', CASE WHEN won // 100000000 > 0 THEN (won // 100000000) || '억' END,
CASE WHEN (won % 100000000) // 10000 > 0 OR won // 100000000 = 0 THEN ((won % 100000000) // 10000) || '만' END) END AS label
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 700 END AS won FROM orders)""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice") * 700)
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), money.in_words(won).alias("label"))


@query("""WITH f AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), u AS (SELECT o_orderkey, v * unnest([1, 1000, 10000]) AS x FROM f), ok AS (SELECT o_orderkey, count(*) AS n, min(x) AS x FROM u WHERE x BETWEEN 1000000 AND 1500000000 GROUP BY 1)
SELECT f.o_orderkey, CASE WHEN n = 1 THEN x END AS won FROM f LEFT JOIN ok ON f.o_orderkey = ok.o_orderkey""")
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("o_totalprice")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", money.scaled(v, 1_000_000, 1_500_000_000).alias("won"))


VISITS_SQL = """SELECT count(*) AS views, count(DISTINCT user_id) AS visitors, count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 23:55:00' - INTERVAL 7 DAY) AS week,
count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '2024-01-30 23:55:00' - INTERVAL 5 MINUTE) AS online FROM events"""


@query(VISITS_SQL)
def visitor_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30 23:55:00").cast("timestamp")
    ts, user = F.col("ts"), F.col("user_id")
    return read_table(spark, sf_dir, "events").agg(
        F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors"),
        F.countDistinct(F.when(ts >= now - F.expr("INTERVAL 7 DAYS"), user)).alias("week"),
        F.countDistinct(F.when(ts > now - F.expr("INTERVAL 5 MINUTES"), user)).alias("online"),
    )


@query("""SELECT event_type, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1 ORDER BY visitors DESC, views DESC, event_type LIMIT 20""")
def visitor_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("visitors"))
    return per.orderBy(F.col("visitors").desc(), F.col("views").desc(), "event_type").limit(20)


#: Parts of the agents that the pages' visitors are given, by the page's number.
AGENTS = ("Mozilla/5.0 (X11; Linux)", "Mozilla/5.0 (compatible; Googlebot/2.1)", "NAVER(inapp; search; 1000)", "Yeti/1.1", "curl/8.5.0", "okhttp/4.12", "cubot note 20", "HeadlessChrome/120", "short", "Mozilla/5.0 (iPhone) bytespider")
ROBOTS_SQL = r"bot\b|bot/|crawler|crawl(ing)?|spider|slurp|yeti|daumoa|mediapartners|adsbot|facebookexternalhit|embedly|scrapy|curl/|wget|python-requests|python-urllib|go-http-client|okhttp|java/|libwww|headless|phantomjs|puppeteer|playwright|selenium|webdriver|lighthouse|pingdom|uptimerobot|gtmetrix|semrush|ahrefs|mj12|dotbot|petalbot|bytespider|applebot|amazonbot|claudebot|gptbot|ccbot|perplexity"
AGENT_SQL = "[" + ", ".join(f"'{a}'" for a in AGENTS) + "]"


@query(f"""WITH a AS (SELECT page_id, CASE WHEN page_id % 13 <> 0 THEN {AGENT_SQL}[1 + page_id % 10] || CASE WHEN page_id % 10 = 8 THEN '' ELSE ' ' || regexp_extract(url, '^https?://([^/]+)', 1) END END AS agent FROM pages)
SELECT agent, count(*) AS n FROM a WHERE length(trim(coalesce(agent, ''))) >= 10 AND NOT regexp_matches(lower(agent), '{ROBOTS_SQL}') GROUP BY 1""")
def bot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents of people: robots go by the whole list of their names, and by having hardly any."""
    k, host = F.col("page_id"), F.regexp_extract("url", "^https?://([^/]+)", 1)
    tail = F.when(k % 10 == 8, "").otherwise(F.concat(F.lit(" "), host))
    agent = F.when(k % 13 != 0, F.concat(F.array(*map(F.lit, AGENTS))[(k % 10).cast("int")], tail))
    rows = read_table(spark, sf_dir, "pages").select(agent.alias("agent")).filter(~is_robot(F.col("agent")))
    return rows.groupBy("agent").agg(F.count("*").alias("n"))


@query("""SELECT user_id, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') // 60 AS age_minutes, (date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') // 60 > 2 * 1440) AS late,
count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def dashboard_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = dates.minutes_between(F.max("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(
        age.alias("age_minutes"), (age > 2 * 1440).alias("late"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
