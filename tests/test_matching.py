"""Names matched to names, links by parcel and what lies near, against plain versions over all pairs."""

from __future__ import annotations

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from noticelake.operators import linking, matching
from noticelake.plans.deciding import fuzzy_best_match


def similar(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def brute_best(left, right, least, margin):
    out = []
    for key, i, a in left:
        ranked = sorted(((-similar(a, b), j) for k, j, b in right if k == key and key is not None and a is not None and b is not None))
        if ranked and -ranked[0][0] >= least and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= margin):
            out.append((i, ranked[0][1], -ranked[0][0]))
    return sorted(out)


def names(n, seed, alphabet="가나다라마바 12"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 3, 5, 8, 13, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("least", "margin", "tile"), [(0.72, 0.0, 512), (0.55, 0.15, 4), (0.4, 0.0, 7)])
def test_best_match_is_that_of_all_pairs(spark, least, margin, tile):
    left = [(k % 3, k, x) for k, x in enumerate(names(60, 1))] + [(None, 100, "가나"), (1, 101, None), (1, 102, "가나다")]
    right = [(k % 3, k, x) for k, x in enumerate(names(80, 2))] + [(1, 200, "가나다"), (1, 201, "가나다"), (1, 202, None), (None, 203, "가나")]
    frames = [spark.createDataFrame(x, f"k int, {i} long, {n} string") for x, i, n in ((left, "a", "an"), (right, "b", "bn"))]
    got = matching.best_match(*frames, ["k"], ("a", "an"), ("b", "bn"), least, margin, tile)
    assert sorted(map(tuple, got.collect())) == brute_best(left, right, least, margin)


def test_best_match_of_customers_and_suppliers(spark):
    sf = "/root/testdata/sf0.01"
    c, s = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("customer", "supplier"))
    want = brute_best([(r.c_nationkey, r.c_custkey, r.c_name) for r in c], [(r.s_nationkey, r.s_suppkey, r.s_name) for r in s], 0.55, 0)
    got = sorted((r.c_custkey, r.s_suppkey, r.score) for r in fuzzy_best_match(spark, sf).collect())
    assert got == want and len(got) > 1400


def test_bounds_are_never_below_the_ratio():
    some, others = names(40, 3), names(40, 4)
    for a, row in zip(some, matching.bounds(some, others), strict=True):
        assert all(bound >= similar(a, b) for b, bound in zip(others, row, strict=True))


def test_contained_equals_all_pairs(spark):
    needles = [(k % 2, x) for k, x in enumerate(names(60, 5, "가나다1"))] + [(0, None), (None, "가")]
    hays = [(k % 2, x) for k, x in enumerate(names(60, 6, "가나다1"))] + [(1, None)]
    got = matching.contained(spark.createDataFrame(needles, "k int, n string"), spark.createDataFrame(hays, "k int, h string"), ["k"], "n", "h")
    want = {(k, n, h) for k, n in needles for j, h in hays if k == j and k is not None and n and h and n in h}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_the_first_line_alike_names_an_estate(spark):
    rows = [(1, 1, "[신규] 시그니처 힐스"), (1, 2, "은평뉴타운 상림마을(6-1)"), (1, 3, "마을"), (1, 4, "없는 이름"), (1, 5, None), (2, 6, "시그니처힐스")]
    lines = [(1, 10, "힐스"), (1, 11, "시그니처힐스"), (1, 12, "시그니처힐스 2차"), (1, 13, "상림마을6-1"), (1, 14, "뉴타운상림마을"), (1, 15, "시그니처 힐스"), (1, 16, "")]
    got = matching.first_alike(spark.createDataFrame(rows, "n int, id long, name string"), spark.createDataFrame(lines, "n int, at int, name string"), ["n"], "id", "name", "at")
    # 마을 is in 상림마을6-1; 힐스 is too short to be looked for in others
    assert sorted((r.id, r["at"]) for r in got.collect()) == [(1, 11), (2, 13), (3, 13)]


def test_pieces_of_names_are_not_sent_through_the_driver(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rows = part.selectExpr("p_size AS n", "p_partkey AS id", "p_name AS name")
    lines = part.selectExpr("p_size AS n", "p_partkey AS at", "concat(p_type, p_name) AS name")
    got = matching.first_alike(rows, lines, ["n"], "id", "name", "at")
    every = part.selectExpr("p_size AS n", "p_partkey AS id", "replace(p_name, ' ', '') AS name", "concat(p_type, replace(p_name, ' ', '')) AS line").collect()
    want = {r.id: min(s.id for s in every if s.n == r.n and r.name in s.line) for r in every}
    assert {r.id: r["at"] for r in got.collect()} == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def brute_parcels(notices, estates):
    by_parcel = defaultdict(lambda: defaultdict(list))
    for code, parcel, kind, name, homes in estates:
        if parcel is not None:
            by_parcel[parcel][code].append((kind, name, homes))
    out = []
    for i, parcel, kind, name, homes in notices:
        pool = by_parcel.get(parcel)
        if not pool:
            out.append((i, None, "none"))
            continue
        typed = {c: rows for c, rows in pool.items() if any(r[0] == kind for r in rows)}
        left = typed or pool
        if len(left) > 1:
            ranked = sorted(((-similar(name, min(r[1] for r in rows)), c) for c, rows in left.items())) if name else []
            if not ranked or -ranked[0][0] < 0.55 or ranked[1][0] - ranked[0][0] < 0.15:
                out.append((i, None, "several"))
                continue
            best = ranked[0][1]
            most = max((r[2] or 0 for r in left[best]), default=0)
            if homes and most and max(homes, most) > 3 * min(homes, most):
                out.append((i, None, "homes"))
                continue
            left = {best: left[best]}
        out.append((i, next(iter(left)), "linked" if typed else "linked_other_kind"))
    return sorted(out)


def test_parcel_links_equal_the_rules(spark):
    rng = random.Random(7)
    some = ["청주산남", "청주산남2", "원주흥업", "담양백동", "익산부송", "익산부송증축", ""]
    estates = []
    for code in range(120):
        parcel, name = rng.choice(["p1", "p2", "p3", "p4", f"q{code}", None]), rng.choice(some)
        for kind in rng.sample(["영구", "국민", "행복"], rng.choice((1, 2))):
            estates.append((f"c{code:03}", parcel, kind, f"{name}{code % 7}", rng.choice((None, 0, 100, 400, 2000))))
    notices = [(i, rng.choice(["p1", "p2", "p3", "p4", "zz", None, *[f"q{k}" for k in range(120)]]), rng.choice(["영구", "국민", "행복", "매입"]),
                rng.choice([*some, None]) and rng.choice(some) + str(rng.randrange(7)), rng.choice((None, 90, 700, 3000))) for i in range(200)]
    got = matching.parcel_links(
        spark.createDataFrame(notices, "id long, parcel string, kind string, name string, homes long"),
        spark.createDataFrame(estates, "code string, parcel string, kind string, name string, homes long"),
    )
    want = brute_parcels(notices, estates)
    assert sorted(map(tuple, got.collect())) == want and len({r[2] for r in want}) >= 4


def test_lone_near_counts_what_is_within_reach(spark):
    rng = random.Random(8)
    left = [(rng.choice("ab"), i, rng.choice((None, round(rng.uniform(-50, 900), 2)))) for i in range(200)]
    right = [(rng.choice("ab"), 1000 + i, round(rng.uniform(-50, 900), 2)) for i in range(150)] + [("a", 5000, None), (None, 5001, 1.0)]
    frames = [spark.createDataFrame(x, f"k string, {i} long, at double") for x, i in ((left, "l"), (right, "r"))]
    for reach in (0.5, 7):
        got = {r.l: (r.n, r.other) for r in linking.lone_near(*frames, ["k"], "l", "r", "at", reach).collect()}
        for k, i, at in left:
            near = [j for g, j, x in right if at is not None and g == k and x is not None and round(abs(at - x), 6) < reach]
            assert got.get(i, (0, None)) == (len(near), near[0] if len(near) == 1 else None)


def test_children_are_kept_whole_where_none_passes(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False), (2, 4, None), (None, 5, False)], "p int, c int, good boolean")
    assert sorted(r.c for r in linking.keep_all_if_none(rows, "p", F.col("good")).collect()) == [1, 3, 4, 5]


def test_only_small_tables_are_sent_to_every_task(spark):
    from noticelake.operators.relational import small

    assert small(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="more than 5 rows"):
        small(spark.range(6), 5)


def test_rows_without_a_link_stay_out_of_the_join(spark, monkeypatch):
    from noticelake.plans.joining import canonical_self_join

    frame, asked = type(spark.range(0)), []
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **b: asked.append(self) or join(self, *a, **b))
    rows = canonical_self_join(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert all(df.filter("canonical_id IS NULL").isEmpty() for df in asked)


def test_equal_names_are_compared_once(spark, monkeypatch):
    left = spark.createDataFrame([(1, i, ("가나다", "라마바")[i % 2]) for i in range(40)], "k int, a long, an string")
    right = spark.createDataFrame([(1, i, ("가나라", "라마가")[i % 2]) for i in range(60)], "k int, b long, bn string")
    frame, seen = type(left), []
    union = frame.unionByName
    monkeypatch.setattr(frame, "unionByName", lambda self, *a, **b: seen.append(union(self, *a, **b)) or seen[-1])
    got = matching.ranked_matches(left, right, ["k"], ("a", "an"), ("b", "bn"), 0.4).collect()
    assert sorted((r.a, [(x.b, round(x.score, 3)) for x in r.best]) for r in got) == [(i, [(i % 2, 0.667), (i % 2 + 2, 0.667)]) for i in range(40)]
    assert seen[0].count() <= 4 * 7


def test_letters_in_order_leave_few_names_to_compare(spark, monkeypatch):
    left, right = [f"Customer#{i * 7919 % 900000:09d}" for i in range(200)], [f"Supplier#{i * 104729 % 60000:09d}" for i in range(600)]
    bound, asked, ratio = matching.bounds(left, right), [], matching.ratio
    monkeypatch.setattr(matching, "ratio", lambda a, b: asked.append(b) or ratio(a, b))
    got = [matching.nearest(a, right, list(range(600)), row, 0.55, 1) for a, row in zip(left, bound, strict=True)]
    want = [min((-similar(a, b), i) for i, b in enumerate(right)) for a in left]
    assert got == [[(-score, i)] if -score >= 0.55 else [] for score, i in want]
    assert len(asked) <= 10 * len(left)  # by letters in any order about a hundred each were left


def test_long_names_and_blocks_are_those_of_difflib():
    some, others = names(40, 9) + ["가나" * 40, "", "나" * 64], names(40, 10) + ["다가나" * 30, ""]
    for a, row in zip(some, matching.bounds(some, others), strict=True):
        assert [matching.ratio(a, b) for b in others] == [similar(a, b) for b in others]
        assert all(bound >= similar(a, b) for b, bound in zip(others, row, strict=True))
