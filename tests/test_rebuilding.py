"""Tables, numbers, days, links and feeds rebuilt: awkward pages and texts, and plain versions."""

from __future__ import annotations

import datetime as dt
import json
import random
import struct
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from noticelake.functions import compact_dates, geo
from noticelake.operators import glyphs, linking
from noticelake.sources import landed, paged
from noticelake.streaming.page_views import daily_views, online_visitors

CELL = "doc_id string, page int, row int, cell int, x0 double, x1 double, y double, text string"


def cells(spark, rows, page=1):
    return spark.createDataFrame([("d", page, r, k, x0, x1, 10.0 * r, t) for k, (r, x0, x1, t) in enumerate(rows)], CELL)


def test_headers_of_several_lines_and_wide_columns(spark):
    page = [(0, 0.0, 30.0, "단지"), (0, 200.0, 230.0, "공급 "), (0, 400.0, 440.0, "금액"), (1, 5.0, 25.0, "명"), (1, 200.0, 240.0, "유 형"), (1, 600.0, 640.0, "비고"),
            (2, 0.0, 40.0, "가나"), (2, 60.0, 330.0, "아주 긴 유형"), (2, 390.0, 450.0, "100"), (3, 0.0, 40.0, "금액"), (3, 335.0, 350.0, "끝"), (3, 400.0, 420.0, "7")]
    frame = cells(spark, page)
    places = {r.name: (r.x, r.bottom) for r in glyphs.header_places(frame, ["단지명", "공급유형", "금액"]).collect()}
    assert places == {"단지명": (15.0, 1), "공급유형": (220.0, 1), "금액": (420.0, 1)}
    got = glyphs.under_header(frame, ["단지명", "공급유형", "금액"]).orderBy("row").collect()
    assert [(r.단지명, r.공급유형, r.금액) for r in got] == [("가나", "아주 긴 유형", "100"), ("금액", "끝", "7")]
    assert glyphs.under_header(frame, ["단지명", "없음"]).count() == 0
    assert glyphs.under_header(frame.limit(0), ["단지명"]).count() == 0
    assert [r.금액 for r in glyphs.under_header(frame, ["금액"]).orderBy("row").collect()][-1] == "금액 끝 7"


def test_edges_are_the_middles_of_the_widest_bands(spark):
    rng = random.Random(3)
    headers = [("d", p, float(x)) for p in range(6) for x in sorted(rng.sample(range(0, 600), 4))]
    spans = [("d", rng.randrange(6), *sorted((float(rng.randrange(-20, 640)), float(rng.randrange(-20, 640))))) for _ in range(25)]
    spans = [(d, p, a, min(b, a + rng.choice((5, 30, 80)))) for d, p, a, b in spans]
    got = {(r.page, r.place): r.edge for r in glyphs.column_edges(spark.createDataFrame(spans, "doc_id string, page int, x0 double, x1 double"), spark.createDataFrame(headers, "doc_id string, page int, x double")).collect()}
    for page in range(6):
        xs = sorted(x for _, p, x in headers if p == page)
        for place, (a, b) in enumerate(zip(xs, xs[1:], strict=False), 1):
            own = [(l, r) for _, p, l, r in spans if p == page and r > a and l < b]
            points = sorted({a, b, *[x for s in own for x in s if a <= x <= b]})
            free = []
            for lo, hi in combinations(points, 2):
                if hi - lo >= 2.5 and not any(l < hi and r > lo for l, r in own):
                    free.append((-(hi - lo), lo, (lo + hi) / 2))
            assert got[page, place] == (min(free)[2] if free else (a + b) / 2)


def test_merged_cells_say_which_rows_are_theirs(spark):
    rows = spark.createDataFrame([("p", 10.0, "a"), ("p", 20.0, "b"), ("p", 30.0, "c"), ("p", None, "x"), ("q", 1.0, "d"), ("r", 1.0, "e"), ("r", 2.0, "f")], "page string, y double, t string")
    labels = spark.createDataFrame([("p", 12.0, "one"), ("p", 28.0, "two"), ("q", 1.0, "three"), ("q", 2.0, "four"), ("z", 5.0, "five")], "page string, at double, block string")
    got = {r.t: r.block for r in glyphs.block_labels(rows, labels, ["page"], "y", "at", "block").collect()}
    assert got == {"a": "one", "b": "two", "c": "two", "x": None, "d": None, "e": None, "f": None}


def test_what_no_text_shows_is_not_repaired(spark):
    shown = ["88", "8_5", "5_88", "1_1", "11_1", "_1", "1_", "a__b", "88_", "", None, "abc", "12_4", "1_2_"]
    frame = spark.createDataFrame([(s,) for s in shown], "s string")
    got = [r.r for r in frame.select(glyphs.repaired(F.col("s")).alias("r")).collect()]
    assert got == ["88", "885", None, "111", "1111", None, "11", None, None, "", None, "abc", "1224", "1122"]


def test_rendering_and_repair_are_inverse(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("01가 ") for _ in range(rng.randrange(12))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.r for r in frame.select(glyphs.repaired(glyphs.rendered(F.col("t"))).alias("r")).collect()] == texts


def test_numbers_that_cannot_be_read_stay_empty(spark):
    rows = [("a", 0.0, "1"), ("a", 6.0, "2"), ("a", 18.0, "3"), ("b", 0.0, "1"), ("b", 6.0, "-"), ("b", 12.0, "2"), ("c", 0.0, "7"), ("c", 40.0, "7"), ("d", 0.0, "4"), ("d", 6.0, "5"), ("d", 12.0, ","), ("d", 15.0, "6")]
    seen = glyphs.with_holes(spark.createDataFrame(rows, "k string, x double, ch string"), ["k"])
    got = {r.k: (r.seen, r.n) for r in seen.select("k", "seen", glyphs.whole_number(F.col("seen")).alias("n")).collect()}
    assert got == {"a": ("12_3", 1223), "b": ("1-2", None), "c": ("77", 77), "d": ("456", 456)}


@pytest.mark.parametrize(("text", "year", "before", "want"), [
    ("’26 9 9(수) ~ 9 14(월)", None, None, [(2026, 9, 9), (2026, 9, 14)]),
    ("2026. 8. 28(금)", None, None, [(2026, 8, 28)]), ("09.15 (화)", 2026, None, [(2026, 9, 15)]),
    ("260914(월) ~ 0916(수)", None, None, [(2026, 9, 14), (2026, 9, 16)]), ("20260914(월)", None, None, [(2026, 9, 14)]),
    ("2026928(월)", None, None, [(2026, 9, 28)]), ("2026111(일)", None, (2026, 10, 1), [(2026, 11, 1)]), ("2026111(일)", None, None, [(2026, 1, 11)]),
    ("26111(일)", None, (2026, 2, 1), [(2026, 11, 1)]), ("928(월)", 2026, (2026, 9, 9), [(2026, 9, 28)]), ("69(화)", 2026, None, [(2026, 6, 9)]), ("69(수)", 2026, None, []),
    ("27330", None, None, [(2027, 3, 30)]), ("모집세대의 200% 27330", None, None, []), ("0915(화)", None, None, []), ("991399(화)", None, None, []), ("", 2026, None, []),
])
def test_compact_days(spark, text, year, before, want):
    frame = spark.createDataFrame([(text, year, dt.date(*before) if before else None)], "t string, y int, b date")
    got = frame.select(compact_dates.days_in(F.col("t"), F.col("y"), F.col("b")).alias("d")).first().d
    assert [x.day for x in got] == [dt.date(*w) for w in want]
    assert spark.createDataFrame([(None,)], "t string").select(compact_dates.days_in(F.col("t"), F.lit(2026), F.lit(None).cast("date")).alias("d")).first().d is None


def test_relinking_equals_a_full_run(spark):
    rng = random.Random(5)
    posts = spark.createDataFrame([(i, rng.choice("abcdefgh")) for i in range(40)] + [(99, None)], "post long, k string")
    old = spark.createDataFrame([(i, rng.choice("abcdef")) for i in range(5)], "id long, k string")
    late = spark.createDataFrame([(100, "g"), (101, "h"), (102, "a"), (103, "h"), (200, None)], "id long, k string")

    def rule(rows, candidates):
        return linking.unique_by_key(rows, candidates, ["k"], "id")

    ledger = rule(posts, old).select("post", "k", F.col("other").alias("link"))
    got = {r.post: r.link for r in linking.relink(ledger, old.union(late), late, ["k"], "post", "link", rule).collect()}
    before = {r.post: r.link for r in ledger.collect()}
    full = {r.post: r.other for r in rule(posts, old.union(late)).collect()}
    assert got == {p: before[p] if before[p] is not None else full[p] for p in full} and any(before[p] != got[p] for p in got)


def land(folder, page, items, total):
    (folder / f"page={page}").mkdir(parents=True)
    body = {"response": {"header": {"resultCode": "00"}, "body": {"totalCount": str(total), "item": items}}}
    (folder / f"page={page}" / "part-0.json").write_text(json.dumps(body))


def test_pages_are_read_until_the_answer_ends(spark, tmp_path):
    for name, pages, total in (("whole", [2, 2, 1], 5), ("beyond", [2, 2, 1, 2], 5), ("empty", [2, 0, 2], 6), ("gap", [2, None, 2], 6), ("none", [], 0)):
        n = 0
        (tmp_path / name).mkdir()
        for k, size in enumerate(pages, 1):
            if size is not None:
                land(tmp_path / name, k, [{"a": str(n + i)} for i in range(size)], total)
            n += size or 0

    def read(name, most=None):
        return sorted(int(r.a) for r in paged.paged_items(spark, str(tmp_path / name), "struct<a: string>", 2, most).collect())

    assert read("whole") == [0, 1, 2, 3, 4] and read("beyond") == [0, 1, 2, 3, 4] and read("whole", 2) == [0, 1, 2, 3]
    assert read("empty") == [0, 1] and read("gap") == [0, 1] and read("none") == []


def test_sitemaps_are_followed_one_level_in_order(spark):
    index = "<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc> a </loc></sitemap><sitemap><loc>lost</loc></sitemap><sitemap><loc>deeper</loc></sitemap></sitemapindex>"
    files = [("root", index), ("a", "<urlset><loc>u1</loc><loc>u2</loc></urlset>"), ("b", "<urlset><loc>u2</loc><loc>u3</loc><loc>x</loc></urlset>"), ("deeper", "<sitemapindex><loc>c</loc></sitemapindex>"), ("c", "<loc>u9</loc>")]
    frame = spark.createDataFrame(files, "address string, xml string")
    got = landed.sitemap_tree(frame, "root", F.col("url") == "x").orderBy("pos").collect()
    assert [(r.url, tuple(r.pos)) for r in got] == [("u2", (0, 0)), ("u3", (0, 1)), ("u1", (1, 0))]
    assert [r.url for r in landed.sitemap_tree(frame, "a").orderBy("pos").collect()] == ["u1", "u2"] and landed.sitemap_tree(frame, "zz").count() == 0


def test_points_are_the_bytes_of_their_coordinates(spark):
    rng = random.Random(6)
    numbers = [0.0, 1.0, -1.0, 2.0**-40, 2.0**52, 1 - 2.0**-53, 1 + 2.0**-52, 0.1, -127.5, 37.566, 1e300, *[rng.uniform(-180, 180) for _ in range(200)]]
    pairs = list(zip(numbers, reversed(numbers), strict=True))
    frame = spark.createDataFrame([*pairs, (None, 1.0), (1.0, None)], "x double, y double")
    got = frame.select(geo.point(F.col("x"), F.col("y")).alias("p"), geo.point(F.col("x"), F.col("y"), 4326).alias("q"))
    rows = got.select("p", "q", geo.coordinate(F.col("q"), 0).alias("x"), geo.coordinate(F.col("p"), 1).alias("y"), geo.srid(F.col("p")).alias("s")).collect()
    for (x, y), r in zip(pairs, rows, strict=False):
        assert bytes(r.p) == struct.pack("<BIdd", 1, 1, x, y) and bytes(r.q) == struct.pack("<BIIdd", 1, 0x20000001, 4326, x, y)
        assert (r.x, r.y, r.s) == (x, y, 0)
    assert all(r.p is None and r.x is None for r in rows[-2:])
    odd = spark.createDataFrame([(b"abc",), (None,), (struct.pack("<BIdd", 1, 1, 2.0, 3.0) + b"x",)], "p binary")
    assert {r.x for r in odd.select(geo.coordinate(F.col("p"), 0).alias("x")).collect()} == {None}


def test_a_zero_keeps_its_sign(spark):
    frame = spark.createDataFrame([(-0.0, 0.0), (0.0, -0.0)], "x double, y double")
    points = frame.select(geo.point(F.col("x"), F.col("y"), 4326).alias("p"))
    for (x, y), r in zip([(-0.0, 0.0), (0.0, -0.0)], points.select("p", geo.coordinate(F.col("p"), 0).alias("x"), geo.coordinate(F.col("p"), 1).alias("y")).collect(), strict=True):
        assert bytes(r.p) == struct.pack("<BIIdd", 1, 0x20000001, 4326, x, y)
        assert (str(r.x), str(r.y)) == (str(x), str(y))


def batches(spark, tmp_path, build, files, mode):
    """Each of ``files`` is read as a batch of its own; returns what the sink got in each batch."""
    seen, schema = [], "visitor_id string, path string, created_at timestamp"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: seen.append((k, df.collect())))  # noqa: B023
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_rows_behind_the_watermark_are_dropped_and_state_outlives_a_run(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 20)
    files = [[("a", "/x", t), ("b", "/x", t)], [("c", "/x", t + dt.timedelta(hours=2))], [("d", "/x", t + dt.timedelta(days=5))], [("late", "/x", t), ("e", "/x", t + dt.timedelta(days=5))]]
    seen = batches(spark, tmp_path, daily_views, files, "update")
    last = {}
    for _, rows in seen:
        last |= {(r.day, r.path): r.views for r in rows}
    assert last == {(dt.date(2024, 1, 2), "/x"): 3, (dt.date(2024, 1, 7), "/x"): 2}  # the late row counts nowhere


def test_sliding_windows_count_a_visitor_once_in_each(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 20)
    rows = [("a", "/x", t), ("a", "/y", t + dt.timedelta(seconds=30)), ("b", "/x", t + dt.timedelta(minutes=3))]
    [(_, got)] = [x for x in batches(spark, tmp_path, lambda v: online_visitors(v, exact=True), [rows], "complete") if x[1]][-1:]
    assert {(r.start - t).total_seconds() / 60: r.visitors for r in got} == {-4: 1, -3: 1, -2: 1, -1: 2, 0: 2, 1: 1, 2: 1, 3: 1}
    close = online_visitors(spark.createDataFrame(rows, "visitor_id string, path string, created_at timestamp"))
    assert sorted(map(tuple, close.collect())) == sorted(map(tuple, got))


def test_pages_are_read_many_at_a_time_and_once(spark, monkeypatch):
    cells = spark.range(200).selectExpr("'d' AS doc_id", "CAST(id AS INT) AS page", "10.0D AS l", "CAST(id AS DOUBLE) AS t", "6.0D AS w", "10.0D AS h", "800.0D AS page_h", "'x' AS ch")
    rows = spark.range(200).selectExpr("id AS page", "1 AS y", "id AS note")
    labels = spark.range(200).selectExpr("id AS page", "1 AS at", "concat('b', id) AS label")
    blocks = glyphs.block_labels(rows, labels, ["page"], "y", "at", "label")
    assert all(r.label == f"b{r.note}" for r in blocks.collect())
    read = glyphs.page_cells(cells)
    for df in (blocks, read):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMap" not in plan and "MapGroups" not in plan  # a call for each page took longer than the page
    kept, saved = [], glyphs.saved
    monkeypatch.setattr(glyphs, "saved", lambda df: kept.append(df) or saved(df))
    assert glyphs.under_header(read, ["x"]).count() == 0 and len(kept) == 1


def test_cells_are_not_sent_through_the_driver(spark):
    frame = cells(spark, [(r, 10.0, 40.0, t) for r, t in enumerate(("name", "a", "b"))] + [(r, 100.0, 140.0, t) for r, t in enumerate(("size", "1", "2"))])
    got = glyphs.under_header(frame, ["name", "size"])
    assert sorted((r.name, r.size) for r in got.select("name", F.col("size").alias("size")).collect()) == [("a", "1"), ("b", "2")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_read_together_are_those_read_one_by_one(spark):
    rng, rows, want = random.Random(5), [], []
    for page in range(60):
        own = []
        for _ in range(rng.choice((1, 5, 40, 120))):
            w, h = rng.choice(((12.0, 6.0), (12.0, 6.0), (0.0, 5.0)) if page % 4 == 1 else ((6.0, 10.0), (0.0, 10.0), (6.0, 9.0), (5.5, 0.0), (-3.0 if page % 4 == 2 else 6.0, 10.0)))
            left, top = rng.choice((6.0 * rng.randrange(50), rng.uniform(0, 300))), rng.choice((20.0 * rng.randrange(10), rng.uniform(0, 200)))
            own.append((top, left, w, h, rng.choice((800.0, 801.0)) if page % 4 == 3 else 800.0, rng.choice(("a", "b", " ", "가", "　", "fi", ""))))
        own.sort(key=lambda g: (*g[:5], g[5].encode()))
        t, left, w, h, page_h, ch = map(list, zip(*own, strict=True))
        want += [("d", page, *cell) for cell in glyphs.cells_on(page_h[0], left, t, w, h, ch)]
        rows += [("d", page, page_h[i], left[i], t[i], w[i], h[i], ch[i]) for i in range(len(own))]
    rng.shuffle(rows)
    read = glyphs.page_cells(spark.createDataFrame(rows, "doc_id string, page int, page_h double, l double, t double, w double, h double, ch string"))
    assert sorted(map(tuple, read.collect())) == sorted(want) and len(want) > 500
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # merged by their bytes, few tasks had all the work
