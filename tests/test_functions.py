from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticelake.functions import dates, money, text
from noticelake.operators import glyphs, linking, merge, quality, rules
from noticelake.sources import landed


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"), [("20240229", dt.date(2024, 2, 29)), ("20230229", None), ("2024022", None), ("x", None), (None, None)]
)
def test_parse_day(spark, raw, want):
    assert one(spark, dates.parse_day(F.lit(raw))) == want


def test_search_norm_strips_all_blanks(spark):
    assert one(spark, text.search_norm(F.lit(" A　b C\n"))) == "abc"
    assert one(spark, text.search_norm(F.lit(None).cast("string"))) == ""
    assert text.search_term("a") is None and text.search_term("A b") == "ab"


def test_like_escape(spark):
    assert one(spark, F.lit("50%_x").like(f"%{text.like_escape('%_')}%")) is True
    assert one(spark, F.lit("50 x").like(f"%{text.like_escape('%')}%")) is False


def test_channel_takes_the_first_parent_domain(spark):
    table = [("google.com", "google"), ("com", "any")]
    for host, want in [("google.com", "google"), ("m.google.com", "google"), ("notgoogle.com", "any"), ("a.kr", "host:a.kr"), (None, "direct")]:
        assert one(spark, text.channel(F.lit(host).cast("string"), table)) == want


def test_conversion_rounds_down_to_hundreds(spark):
    # 10 million more at 6 % is 50,000 a month
    assert one(spark, money.converted_rent(F.lit(20_000_000), F.lit(300_050), F.lit(30_000_000))) == 250_000
    assert one(spark, money.converted_rent(F.lit(20_000_000), F.lit(100), F.lit(90_000_000))) == 0


@pytest.mark.parametrize(("won", "want"), [(None, "-"), (0, "0만"), (150_000_000, "1억 5000만"), (200_000_000, "2억"), (9_990_000, "999만")])
def test_money_in_words(spark, won, want):
    assert one(spark, money.in_words(F.lit(won).cast("long"))) == want


def test_scale_needs_exactly_one_fit(spark):
    assert one(spark, money.scaled(F.lit(5000), 1_000_000, 60_000_000)) is None  # both 1000 and 10000 fit
    assert one(spark, money.scaled(F.lit(5000), 6_000_000, 60_000_000)) == 50_000_000


def test_status_board_without_end(spark):
    as_of = F.lit("2024-05-08").cast("date")
    start = F.lit("2024-05-01").cast("date")
    none = F.lit(None).cast("date")
    assert one(spark, dates.status_board(start, none, as_of)) == "open"
    assert one(spark, dates.status_board(start, none, F.date_add(as_of, 1))) == "closed"
    assert one(spark, dates.status_board(none, none, as_of)) == "announced"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6), (None, "n", 7)], "k int, name string, x int")
    new = spark.createDataFrame([(1, None, 5), (3, "c", 8), (None, "m", 7)], "k int, name string, x int")
    once = merge.upsert(old, new, ["k"], keep_if_null=["name"])
    flags = {r.k: (r.name, r.inserted, r.changed) for r in once.collect()}
    assert flags == {1: ("a", False, False), 2: (None, False, False), 3: ("c", True, False), None: ("m", False, True)}
    again = merge.upsert(once.select("k", "name", "x"), new, ["k"], keep_if_null=["name"])
    assert again.filter("inserted OR changed").count() == 0


def test_clusters_are_the_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "n long")
    edges = spark.createDataFrame([(i + 1, i) for i in range(7)] + [(9, 8)], "a long, b long")
    got = {r.n: r.cluster for r in linking.clusters(nodes, edges, "n").collect()}
    assert got == {**{i: 0 for i in range(8)}, 8: 8, 9: 8, 10: 10, 11: 11}


def test_clusters_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    order = [(i * 37) % 101 for i in range(101)]
    nodes = spark.createDataFrame([(i,) for i in order], "n long")
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    rounds, saved = [], linking.saved
    monkeypatch.setattr(linking, "saved", lambda df: rounds.append(saved(df)) or rounds[-1])
    got = linking.clusters(nodes, edges, "n")
    assert {r.n: r.cluster for r in got.collect()} == dict.fromkeys(range(101), 0)
    assert len(rounds) < 12
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in rounds]
    assert max(sizes) < 10**9  # a product over the joins of all rounds had a number of digits that tripled each time


def test_quarantine_names_the_reasons(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    good, bad = quality.quarantine(df, {"zero": F.col("x") == 0})
    assert sorted(str(r.x) for r in good.collect()) == ["1", "None"]
    assert bad.first().reasons == ["zero"]


def test_assign_blocks_is_the_best_division():
    from itertools import combinations

    ys, labels = [0.0, 10, 20, 30, 40, 50], [5.0, 22, 45]

    def cost(cuts):
        edges = [0, *cuts, len(ys)]
        return sum(abs((ys[a] + ys[b - 1]) / 2 - labels[i]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))

    got = glyphs.assign_blocks(ys, labels)
    best = min(cost(c) for c in combinations(range(1, 6), 2))
    assert got == sorted(got) and cost([got.index(1), got.index(2)]) == best


def test_reconciled_and_repaired(spark):
    def check(units, online, visit, total, ratio):
        cols = [F.lit(v).cast("double") for v in (units, online, visit, total, ratio)]
        return tuple(one(spark, c) for c in glyphs.reconciled(*cols))

    assert check(10, 20, 5, 25, 2.5) == (True, False)
    assert check(10, 20, None, 25, 2.5) == (True, True)
    assert check(10, 20, 5, 26, 2.6) == (False, False)
    assert check(10, None, None, 25, 2.5) == (False, False)


def test_cut_parts(spark):
    assert one(spark, F.struct(*glyphs.cut_parts(F.lit("2순위 5점")))) == (2, 5.0)
    assert one(spark, F.struct(*glyphs.cut_parts(F.lit("추첨")))) == (None, None)


def test_standing(spark):
    def of(*v):
        return one(spark, rules.standing(*[F.lit(x).cast("int") for x in v]))

    assert [of(1, 5, 2, 9), of(2, 9, 2, 9), of(2, 8, 2, 9), of(2, 1, 2, None), of(3, 9, 2, 1), of(1, None, 2, 1)] == ["win", "tie", "below", "win", "below", None]


def test_api_envelopes(spark):
    raw = spark.createDataFrame([
        ('{"response":{"header":{"resultCode":"00"},"body":{"item":[{"a":"1"},{"a":"2"}]}}}',),
        ('{"response":{"header":{"resultCode":"00"},"body":{"item":{"a":"3"}}}}',),
        ('{"response":{"header":{"resultCode":"03"},"body":{}}}',),
    ], "value string")
    assert sorted(r.a for r in landed.api_items(raw, "struct<a: string>").collect()) == ["1", "2", "3"]
    bad = spark.createDataFrame([('{"response":{"header":{"resultCode":"99"}}}',)], "value string")
    with pytest.raises(Exception, match="answered 99"):
        landed.api_items(bad, "struct<a: string>").collect()


def test_delimited_rows_and_load_log(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("가|나|1\nx|y\n\"q|r|2\n".encode("cp949"))
    rows = landed.delimited(spark, [str(tmp_path / "a.txt")], ["p", "q", "n"])
    assert sorted((r.p, r.n, r.file) for r in rows.collect()) == [('"q', "2", "a.txt"), ("가", "1", "a.txt")]
    log = spark.createDataFrame([("a.txt",)], "file string")
    assert landed.not_loaded(rows, log).count() == 0


def test_glyph_xml(spark):
    xml = '<document><page w="10" h="20"><text l="1" t="2" w="3" h="4">&lt;</text><text l="-1.5" t="2" w="0" h="4">가</text></page></document>'
    pages = spark.createDataFrame([("d", 1, xml)], "doc_id string, page int, xml string")
    got = landed.glyphs(pages).orderBy("pos").collect()
    assert [(r.l, r.ch, r.page_h) for r in got] == [(1.0, "<", 20.0), (-1.5, "가", 20.0)]


def test_rotated_page_reads_like_an_upright_one(spark):
    rows = [("u", 1, 100.0, 10.0 + 6 * i, 20.0, 6.0, 10.0, c) for i, c in enumerate("abcdefghijklmnopqrstuvwxy")]
    # the same line standing on its side: a glyph's width is its height
    rows += [("r", 1, 300.0, 20.0, 300.0 - 10 - 6 * i - 6, 9.0, 6.0, c) for i, c in enumerate("abcdefghijklmnopqrstuvwxy"[::-1])]
    df = spark.createDataFrame(rows, "doc_id string, page int, page_h double, l double, t double, w double, h double, ch string")
    got = {r.doc_id: r.text for r in glyphs.page_cells(df).collect()}
    assert got["u"] == "abcdefghijklmnopqrstuvwxy" and len(got["r"]) == 25


def test_labelled_lines_first_wins(spark):
    html = "<p>■ A : 1</p><div>■A: 2<br>■ B&amp;C : x:y</div>plain : z"
    assert one(spark, landed.labelled_lines(F.lit(html))) == {"A": "1", "B&C": "x:y"}


def test_sitemap_keeps_first_positions(spark):
    pages = spark.createDataFrame([(0, "<loc>u1</loc><loc>u2</loc>"), (1, "<loc> u1 </loc><loc>u3</loc>")], "page int, xml string")
    got = {r.url: tuple(r.pos) for r in landed.sitemap_urls(pages).collect()}
    assert got == {"u1": (0, 0), "u2": (0, 1), "u3": (1, 1)}


def test_posts_read_again_are_dealt_by_their_number(spark, monkeypatch):
    children = spark.createDataFrame([(p, 1, 5) for p in range(60)], "post long, row_no int, units int")
    batch = spark.createDataFrame([(p, r % 2, p + r, r) for p in range(0, 60, 2) for r in range(4)], "post long, row_no int, units int, place int")
    posts = spark.createDataFrame([(p,) for p in range(0, 60, 3)], "post long")
    ledger = posts.selectExpr("post", "-1L AS row_count", "CAST(NULL AS DATE) AS parsed_at", "'old' AS note")
    monkeypatch.setattr(merge, "tasks_for", lambda *frames: 6)
    plain = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        after, _ = merge.replace_by_post(children, ledger, batch, posts, ["post", "row_no"], "place", F.lit("2026-01-01").cast("date"), "none")
        tasks = after.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(p, 1, 5) for p in range(60) if p % 3] + [(p, r, p + r) for p in range(0, 60, 6) for r in (0, 1)]
    assert sorted((r.post, r.row_no, r.units) for r in tasks) == sorted(want)
    assert len({r.task for r in tasks if r.post % 3 == 0}) > 1 and len({r.task for r in tasks if r.post % 3}) > 1
