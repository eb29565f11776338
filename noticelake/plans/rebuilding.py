"""Tables, numbers, days and names rebuilt from what converters and feeds leave of them; links made again; landed feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.functions import compact_dates, geo
from noticelake.operators import glyphs, linking, matching
from noticelake.plans.base import line_items
from noticelake.registry import query
from noticelake.session import checkpoint_dir, read_table
from noticelake.sources import landed, paged
from noticelake.streaming.page_views import online_visitors

#: Columns of the printed tables: the words of their headers by line, where a cell begins and where the header stands.
PRINTED = [("name", [("na", 30.0), ("me", 30.0)], 10.0), ("place", [("place", 330.0)], 140.0), ("unit size", [("unit", 600.0), ("size", 600.0)], 590.0)]


def glyphs_of(cells: DataFrame, doc: str) -> DataFrame:
    """The glyphs of cells (page, line, x, s), six pixels a letter."""
    each = cells.select("page", "line", "x", F.posexplode(F.split("s", "")).alias("i", "ch")).filter("ch <> ''")
    return each.select(
        F.lit(doc).alias("doc_id"), "page", F.lit(800.0).alias("page_h"), (F.col("x") + 6 * F.col("i")).alias("l"),
        (F.col("line") * 20.0 + 40).alias("t"), F.lit(6.0).alias("w"), F.lit(10.0).alias("h"), "ch",
    )


@query("SELECT p_partkey AS id, p_name AS name, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type AS place, CAST(p_size AS VARCHAR) AS size FROM part")
def gap_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints the parts as pages with headers of two lines over a wide column, and reads the tables back by their empty bands.

    The wide column begins far left of its word and goes on far right of it, so the middles between words would cut it.
    """
    part = read_table(spark, sf_dir, "part")
    line = (F.col("p_partkey") % 20).alias("line")
    page = F.floor(F.col("p_partkey") / 20).cast("int").alias("page")
    texts = [F.col("p_name"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_type"), F.col("p_size").cast("string")]
    body = part.select(page, (line + 3).alias("line"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), t.alias("s")) for (_, _, x), t in zip(PRINTED, texts, strict=True)])).alias("c"))
    heads = [F.struct(F.lit(k).cast("long").alias("line"), F.lit(x).alias("x"), F.lit(w).alias("s")) for _, words, _ in PRINTED for k, (w, x) in enumerate(words)]
    top = part.select(page).distinct().select("page", F.inline(F.array(*heads)))
    cells = body.select("page", "line", "c.x", "c.s").unionByName(top)
    read = glyphs.under_header(glyphs.page_cells(glyphs_of(cells, "parts")), [n for n, _, _ in PRINTED])
    at = read.select("page", "row", F.col("name"), F.col("place"), F.col("unit size").alias("size"))
    return at.select((F.col("page") * 20 + F.col("row") - 2).cast("long").alias("id"), "name", "place", "size")


BLOCK_SQL = """WITH r AS (SELECT l_orderkey AS page, row_number() OVER w AS i, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS y, count(*) OVER (PARTITION BY l_orderkey) AS n
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)),
p AS (SELECT page, list(y ORDER BY i) AS ys, max(y) AS total, n, least(3, n) AS k FROM r GROUP BY page, n),
l AS (SELECT *, [CAST(total * (2 * j - 1) // (2 * k) AS BIGINT) FOR j IN range(1, k + 1)] AS ls FROM p),
cuts AS (SELECT page, ys, n, k, ls, c1, c2 FROM l, unnest(CASE WHEN k = 1 THEN [n] ELSE range(1, n) END) AS a(c1), unnest(CASE WHEN k = 3 THEN range(1, n) ELSE [n] END) AS b(c2) WHERE k < 3 OR c1 < c2),
cost AS (SELECT *, abs((ys[1] + ys[c1]) / 2.0 - ls[1]) + CASE WHEN k >= 2 THEN abs((ys[c1 + 1] + ys[CASE WHEN k = 2 THEN n ELSE c2 END]) / 2.0 - ls[2]) ELSE 0 END
 + CASE WHEN k = 3 THEN abs((ys[c2 + 1] + ys[n]) / 2.0 - ls[3]) ELSE 0 END AS cost FROM cuts),
best AS (SELECT page, c1, c2, k FROM cost QUALIFY row_number() OVER (PARTITION BY page ORDER BY cost, c2, c1) = 1)
SELECT r.page, CAST(r.i AS INTEGER) AS i, r.y, 'block ' || CAST(CASE WHEN r.i <= c1 THEN 1 WHEN k = 2 OR r.i <= c2 THEN 2 ELSE 3 END AS VARCHAR) AS block FROM r JOIN best USING (page)"""


@query(BLOCK_SQL)
def merged_cell_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a page: its lines at heights, and three merged cells drawn beside them; which line belongs to which."""
    rows = line_items(spark, sf_dir).select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    order = Window.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q")
    rows = rows.select("page", F.row_number().over(order).alias("i"), F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    pages = rows.groupBy("page").agg(F.max("y").alias("total"), F.least(F.lit(3), F.count("*").cast("int")).alias("k"))
    labels = pages.select("page", "total", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j"))
    at = F.expr("total * (2 * j - 1) div (2 * k)").alias("at")
    labels = labels.select("page", at, F.concat(F.lit("block "), F.col("j").cast("string")).alias("block"))
    return glyphs.block_labels(rows, labels, ["page"], "y", "at", "block")


@query(r"""WITH r AS (SELECT p_size AS notice, p_partkey AS id, regexp_replace('[신규]' || p_name || ' (' || p_type || ')', '\[신규\]|[\s,·・()\[\]]', '', 'g') AS n FROM part),
s AS (SELECT p_size AS notice, p_partkey AS line, regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || p_brand || p_name || p_type END, '[\s,·・()\[\]]', '', 'g') AS n FROM part WHERE p_partkey % 3 = 0)
SELECT r.notice, r.id, min(s.line) AS line FROM r JOIN s ON r.notice = s.notice AND (r.n = s.n OR (length(s.n) >= 6 AND (contains(r.n, s.n) OR contains(s.n, r.n)))) GROUP BY 1, 2""")
def supply_into_estates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each estate of a notice with the first supply line whose name is the same or, if long enough, within it or around it."""
    part = read_table(spark, sf_dir, "part")
    rows = part.select(F.col("p_size").alias("notice"), F.col("p_partkey").alias("id"), F.concat(F.lit("[신규]"), "p_name", F.lit(" ("), "p_type", F.lit(")")).alias("name"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_type", "p_brand", "p_name", "p_type"))
    lines = part.filter("p_partkey % 3 = 0").select(F.col("p_size").alias("notice"), F.col("p_partkey").alias("line"), name.alias("name"))
    return matching.first_alike(rows, lines, ["notice"], "id", "name", "line").select("notice", "id", "line")


@query()
def parcel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices about the first of their parts, linked to parts as estates by parcel, kind, name and number of homes."""
    part = read_table(spark, sf_dir, "part")
    parcel = F.concat(F.lit("p"), (F.col("p_partkey") % 700).cast("string"))
    estates = part.select(
        F.col("p_partkey").alias("code"), parcel.alias("parcel"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", F.col("p_partkey") % 4).alias("name"), F.col("p_size").cast("long").alias("homes")
    )
    seen = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 800).alias("k"), (F.col("o_totalprice") % 60).cast("long").alias("homes"))
    about = line_items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("p_partkey"))
    notices = seen.join(about, "id").join(part, "p_partkey").select(
        "id", F.concat(F.lit("p"), F.col("k").cast("string")).alias("parcel"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", F.col("p_partkey") % 3).alias("name"), "homes"
    )
    return matching.parcel_links(notices, estates)


@query("""WITH c AS (SELECT c_custkey AS id, c_name || CAST(c_custkey * 1111 AS VARCHAR) || 'z' AS text FROM customer),
g AS (SELECT id, text, unnest(range(1, length(text) + 1)) AS i FROM c), h AS (SELECT id, i, text[i] AS ch FROM g),
r AS (SELECT *, i - row_number() OVER (PARTITION BY id, ch ORDER BY i) AS run FROM h), n AS (SELECT id, i, ch, count(*) OVER (PARTITION BY id, ch, run) AS n, i - min(i) OVER (PARTITION BY id, ch, run) AS place FROM r),
s AS (SELECT id, string_agg(CASE WHEN n >= 2 AND place = n // 2 THEN '_' ELSE ch END, '' ORDER BY i) AS seen FROM n GROUP BY id)
SELECT id, seen, text AS repaired FROM s JOIN c USING (id)""")
def dropped_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a converter shows them that loses a glyph of each run, and as they were."""
    text = F.concat("c_name", (F.col("c_custkey") * 1111).cast("string"), F.lit("z"))
    seen = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), glyphs.rendered(text).alias("seen"))
    return seen.select("id", "seen", glyphs.repaired(F.col("seen")).alias("repaired"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)
SELECT id, CAST(CONCAT('12', w, (w + 1) % 10, (w + 3) % 10, (w + 5) % 10) AS DECIMAL(38,0)) AS number FROM o""")
def numbers_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers printed with separators and lost glyphs, read back by where their digits stand.

    They begin and end with different digits, so that the width of a digit and of a separator can be seen, and nothing is lost at the end.
    """
    whole = F.floor("o_totalprice").cast("long")
    text = F.concat(F.lit("12"), whole.cast("string"), *[((whole + k) % 10).cast("string") for k in (1, 3, 5)])
    shown = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), glyphs.rendered(text).alias("seen"))
    digit = shown.select("id", F.posexplode(F.split("seen", "")).alias("i", "ch"), F.length("seen").alias("n"))
    # a comma before each group of three digits takes half a place
    commas = F.floor((F.col("n") - 1) / 3) - F.floor((F.col("n") - 1 - F.col("i")) / 3)
    x = 6.0 * F.col("i") + 3.0 * commas
    printed = digit.filter("ch <> '' AND ch <> '_'").select("id", x.alias("x"), "ch")
    marks = digit.filter("ch <> '' AND i > 0 AND (n - i) % 3 = 0").select("id", (x - 3.0).alias("x"), F.lit(",").alias("ch"))
    return glyphs.with_holes(printed.unionByName(marks), ["id"]).select("id", glyphs.whole_number(F.col("seen")).alias("number"))


WEEK_SQL = "substr('월화수목금토일', CAST(isodow({}) AS INTEGER), 1)"


def compact_sql(kind: str, day: str) -> str:
    """How a day is printed, by kind."""
    y, m, d = (f"CAST(extract({p} FROM {day}) AS VARCHAR)" for p in ("year", "month", "day"))
    forms = [f"{y} || lpad({m}, 2, '0') || lpad({d}, 2, '0')", f"right({y}, 2) || lpad({m}, 2, '0') || lpad({d}, 2, '0')", f"{y} || {m} || lpad({d}, 2, '0')", f"right({y}, 2) || {m} || {d}", f"lpad({m}, 2, '0') || lpad({d}, 2, '0')", f"{m} || {d}"]
    return "CASE " + " ".join(f"WHEN {kind} = {k} THEN {f}" for k, f in enumerate(forms)) + " END"


DAYS_SQL = f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS kind, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS b FROM orders),
t AS (SELECT *, {compact_sql('kind', 'a')} AS da, {compact_sql('(kind + 3) % 6', 'b')} AS db, {WEEK_SQL.format('a')} AS wa, {WEEK_SQL.format('b')} AS wb FROM o),
cal AS (SELECT CAST(d AS DATE) AS d FROM range(DATE '1990-01-01', DATE '2100-01-01', INTERVAL 1 DAY) AS r(d)),
spell AS (SELECT d, k, {compact_sql('k', 'd')} AS digits FROM cal, range(6) AS k(k)),
ways AS (
  SELECT DISTINCT digits, d, CASE WHEN k = 0 THEN 0 WHEN k = 2 AND length(digits) = 7 THEN length(CAST(extract(month FROM d) AS VARCHAR)) END AS first, NULL AS year FROM spell WHERE (k = 0 AND length(digits) = 8)
  UNION SELECT digits, d, 0, NULL FROM spell WHERE k = 1 AND d BETWEEN DATE '2000-01-01' AND DATE '2099-12-31'
  UNION SELECT CAST(extract(year FROM d) AS VARCHAR) || m || dd, d, length(m), NULL FROM (SELECT d, unnest([CAST(extract(month FROM d) AS VARCHAR), lpad(CAST(extract(month FROM d) AS VARCHAR), 2, '0')]) AS m, CAST(extract(day FROM d) AS VARCHAR) AS dx FROM cal), unnest([dx, lpad(dx, 2, '0')]) AS u(dd) WHERE length(m) + length(dd) = 3
  UNION SELECT right(CAST(extract(year FROM d) AS VARCHAR), 2) || m || dd, d, length(m), NULL FROM (SELECT d, unnest([CAST(extract(month FROM d) AS VARCHAR), lpad(CAST(extract(month FROM d) AS VARCHAR), 2, '0')]) AS m, CAST(extract(day FROM d) AS VARCHAR) AS dx FROM cal WHERE d >= DATE '2000-01-01'), unnest([dx, lpad(dx, 2, '0')]) AS u(dd) WHERE length(m) + length(dd) = 3
  UNION SELECT m || dd, d, length(m), extract(year FROM d) FROM (SELECT d, unnest([CAST(extract(month FROM d) AS VARCHAR), lpad(CAST(extract(month FROM d) AS VARCHAR), 2, '0')]) AS m, CAST(extract(day FROM d) AS VARCHAR) AS dx FROM cal), unnest([dx, lpad(dx, 2, '0')]) AS u(dd) WHERE length(m) + length(dd) IN (2, 3) OR (length(m) = 2 AND length(dd) = 2)),
p1 AS (SELECT id, ways.d, coalesce(ways.first, 0) AS first, (ways.d >= t.a - 20) AS after FROM t JOIN ways ON digits = da AND (ways.year IS NULL OR ways.year = extract(year FROM t.a)) AND (length(da) > 2 OR {WEEK_SQL.format('ways.d')} = wa)),
d1 AS (SELECT id, d AS day1 FROM p1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY after DESC, CASE WHEN after THEN d END, first) = 1),
c AS (SELECT t.*, d1.day1, coalesce(d1.day1, t.a - 20) AS ref, coalesce(extract(year FROM d1.day1), extract(year FROM t.a)) AS y FROM t LEFT JOIN d1 USING (id)),
p2 AS (SELECT id, ways.d, coalesce(ways.first, 0) AS first, (ways.d >= c.ref) AS after FROM c JOIN ways ON digits = db AND (ways.year IS NULL OR ways.year = c.y) AND (length(db) > 2 OR {WEEK_SQL.format('ways.d')} = wb)),
d2 AS (SELECT id, d AS day2 FROM p2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY after DESC, CASE WHEN after THEN d END, first) = 1)
SELECT c.id, da || ' ' || db AS digits, concat_ws(',', CAST(day1 AS VARCHAR), CAST(day2 AS VARCHAR)) AS days FROM c LEFT JOIN d2 USING (id)"""


@query(DAYS_SQL)
def compact_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of each order printed without separators in six ways, and what they are read as."""
    a = F.to_date("o_orderdate")
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 45).cast("int")).alias("b"))

    def printed(day: str, kind: Column) -> Column:
        forms = ["yyyyMMdd", "yyMMdd", "yyyyMdd", "yyMd", "MMdd", "Md"]
        return F.coalesce(*[F.when(kind == k, F.date_format(day, f)) for k, f in enumerate(forms)])

    first, second = printed("a", F.col("id") % 6), printed("b", (F.col("id") % 6 + 3) % 6)
    signs = [compact_dates.weekday_sign(F.col(c)) for c in "ab"]
    rows = o.select("id", "a", first.alias("p"), second.alias("q"), F.concat(F.lit("접수 "), first, F.lit("("), signs[0], F.lit(") ~ "), second, F.lit(" ("), signs[1], F.lit(")")).alias("text"))
    found = compact_dates.days_in(F.col("text"), F.year("a"), F.date_sub("a", 20))
    return rows.select("id", F.concat_ws(" ", "p", "q").alias("digits"), F.array_join(F.transform(found, lambda x: x["day"].cast("string")), ",").alias("days"))


RELINK_SQL = """WITH n AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority AS agency, CAST(o_orderdate AS DATE) < DATE '1999-01-01' AS old FROM orders WHERE o_orderstatus = 'O'),
k AS (SELECT o_custkey, agency, count(*) FILTER (WHERE old) AS n_old, min(id) FILTER (WHERE old) AS lone_old, count(*) AS n_all, min(id) AS lone_all FROM n GROUP BY ALL)
SELECT o_orderkey AS post, CASE WHEN n_old = 1 THEN lone_old WHEN n_all = 1 THEN lone_all END AS notice FROM orders LEFT JOIN k ON k.o_custkey = orders.o_custkey AND k.agency = o_orderpriority WHERE o_orderstatus = 'F'"""


@query(RELINK_SQL)
def relink_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that had no single notice are linked again when notices arrive late; only the keys of those are looked at."""
    o = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "agency")
    keys = ["o_custkey", "agency"]
    notices = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), *keys, F.to_date("o_orderdate").alias("day"))
    old, late = notices.filter("day < DATE '1999-01-01'"), notices.filter("day >= DATE '1999-01-01'")

    def lone(posts: DataFrame, candidates: DataFrame) -> DataFrame:
        return linking.unique_by_key(posts, candidates, keys, "id")

    posts = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("post"), *keys)
    ledger = lone(posts, old).select("post", *keys, F.col("other").alias("notice"))
    return linking.relink(ledger, notices, late, keys, "post", "notice", lone).select("post", "notice")


PAGE_ITEMS = 100


@query(f"SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey < {PAGE_ITEMS} * 40")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the landed pages of an API, read page by page until the total, forty pages at most."""
    folder = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    c = read_table(spark, sf_dir, "customer").select((F.floor(F.col("c_custkey") / PAGE_ITEMS) + 1).cast("int").alias("page"), "c_custkey", "c_name")
    total = c.count()
    items = c.groupBy("page").agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))).alias("item"))
    body = F.struct(F.lit(str(total)).alias("totalCount"), "item")
    envelope = F.to_json(F.struct(F.struct(F.struct(F.lit("00").alias("resultCode")).alias("header"), body.alias("body")).alias("response")))
    items.select("page", envelope.alias("value")).write.partitionBy("page").text(folder)
    found = paged.paged_items(spark, folder, "struct<id: string, name: string>", PAGE_ITEMS, 40)
    return found.select(F.col("id").cast("long").alias("id"), "name")


@query("""WITH u AS (SELECT page_id, url, page_id // 40 AS file FROM pages WHERE url NOT LIKE '%ref=%' AND url NOT LIKE '%&%')
SELECT url, CAST(min(file * 1000 + page_id % 40) AS BIGINT) AS place FROM u GROUP BY 1""")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of all pages as sitemaps under an index, read through the index in order, each once."""
    urls = read_table(spark, sf_dir, "pages").filter(~F.col("url").contains("&")).select(F.floor(F.col("page_id") / 40).alias("file"), (F.col("page_id") % 40).alias("at"), "url")
    line = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>"))
    maps = urls.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("</urlset>"))
    files = maps.select(F.concat(F.lit("https://example.org/map-"), F.col("file").cast("string"), F.lit(".xml")).alias("address"), xml.alias("xml"), "file", "lines")
    names = files.agg(F.array_sort(F.collect_list(F.struct("file", "address"))).alias("names"))  # a name for each file
    index = names.select(
        F.lit("https://example.org/sitemap.xml").alias("address"),
        F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("<sitemap><loc>"), x["address"], F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"),
    )
    found = landed.sitemap_tree(files.select("address", "xml").unionByName(index), "https://example.org/sitemap.xml", F.col("url").contains("ref="))
    # the place in the list names the page again, as no page of a file was left out before
    at = files.select("file", F.posexplode(F.transform("lines", lambda x: x["at"])).alias("line", "at"))
    where = found.select("url", F.col("pos.file").cast("long").alias("file"), F.col("pos.line").alias("line"))
    return where.join(at, ["file", "line"]).select("url", (F.col("file") * 1000 + F.col("at")).alias("place"))


WKB_SQL = "(SELECT string_agg(substr(printf('%016x', CAST(CAST({} AS BIT) AS UBIGINT)), 17 - 2 * i, 2), '' ORDER BY i) FROM range(1, 9) AS b(i))"


@query(f"""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 60 END AS lon, (c_custkey - 700) * CAST(0.0371 AS DOUBLE) AS lat FROM customer)
SELECT id, CASE WHEN lon IS NOT NULL THEN upper('0101000020e6100000' || {WKB_SQL.format('CAST(lon AS DOUBLE)')} || {WKB_SQL.format('CAST(lat AS DOUBLE)')}) END AS wkb,
CASE WHEN lon IS NOT NULL THEN lon END AS x, CASE WHEN lon IS NOT NULL THEN CAST(lat AS DOUBLE) END AS y, CASE WHEN lon IS NOT NULL THEN 4326 END AS srid FROM c""")
def binary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points made from coordinates as well-known binary, and their coordinates taken out again."""
    k = F.col("c_custkey")
    c = read_table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 9 != 0, F.col("c_acctbal") / 60).alias("lon"), ((k - 700) * F.lit(0.0371)).alias("lat"))
    p = c.select("id", geo.point(F.col("lon"), F.col("lat"), 4326).alias("p"))
    return p.select("id", F.hex("p").alias("wkb"), geo.coordinate(F.col("p"), 0).alias("x"), geo.coordinate(F.col("p"), 1).alias("y"), geo.srid(F.col("p")).alias("srid"))


@query("""WITH w AS (SELECT user_id, unnest(range(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS start FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(DISTINCT user_id) AS visitors FROM w GROUP BY 1""")
def stream_online_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitors of sliding windows, read as a stream to its end; the last complete result is what the batch query gives."""
    folder = f"{checkpoint_dir(spark)}/online-{uuid.uuid4().hex}"
    schema = read_table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    views = raw.select(F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("visitor_id"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    started = online_visitors(views, exact=True).writeStream.outputMode("complete").foreachBatch(keep)
    started.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "visitors")
