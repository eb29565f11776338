"""Fit engines, rule sheets, forms and printed tables on cases whose answers are known."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noticelake.functions import money
from noticelake.operators import fitting, glyphs, merge, profiles, quality, rulebooks
from noticelake.plans.fitting import ASSET_KIND, LONG_KIND, PURCHASE_KIND

PERSON = {"id": 1, "notice": 0, "household": 3, "income": 2400, "income_self": 900, "assets": 100, "car": 0, "age": 30, "dual": False, "newborns": 0, "older_minor": False, "deposits": 24, "years": 3,
          "gu": "강남구", "special": False, "group": "건설형", "area": "59", "class": "청년", "estate_gu": "강남구", "applicant": "청년", "priority_class": None, "parents_homeless": False,
          "disabled_self": False, "disabled_family": False, "homeless": True}
KINDS = "id long, notice int, household int, income long, income_self long, assets long, car long, age int, dual boolean, newborns int, older_minor boolean, deposits int, years int, gu string, special boolean, " \
        "group string, area string, class string, estate_gu string, applicant string, priority_class string, parents_homeless boolean, disabled_self boolean, disabled_family boolean, homeless boolean"
SEED = [(1, 1000), (2, 1800), (3, 2500), (7, 3600)]


def people(spark, *changes):
    return spark.createDataFrame([tuple((PERSON | {"id": k} | c).values()) for k, c in enumerate(changes, 1)], KINDS)


def incomes(spark, stated=()):
    return spark.createDataFrame(list(stated), "notice int, pct int, household int, won long, per_person long"), spark.createDataFrame(SEED, "household int, amount long")


def test_long_leases_take_the_first_rank_that_fits(spark):
    ranks = spark.createDataFrame([(0, 1, "건설형", 1, 1, "59", 100, 120, "24회 이상"), (0, 1, "건설형", 2, 2, "59", 120, None, None), (0, 2, "매입형", 3, 1, "59", 100, None, "단지가 위치한 자치구 거주"),
                                   (0, 2, "매입형", 4, 2, "59", 100, None, "그 외 서울시 자치구 거주")], LONG_KIND)
    assets = spark.createDataFrame([(0, 1, "총자산", False, 3, [1000, 1100, 1200]), (0, 2, "자동차", True, 3, [300, None, None])], ASSET_KIND)
    who = people(
        spark, {}, {"deposits": 3}, {"income": 3000}, {"income": 3001}, {"income": 3000, "dual": True}, {"assets": 1001}, {"assets": 1150, "newborns": 2}, {"car": 301, "newborns": 1},
        {"group": "매입형"}, {"group": "매입형", "estate_gu": "강서구"}, {"group": "매입형", "estate_gu": "강서구", "gu": "연접"}, {"group": "없음"}, {"area": "84"}, {"notice": 9}, {"household": 9, "income": 3600},
        {"household": 5, "income": 10**6},
    )
    got = {r.id: (r.ok, r.rank, r.pct, r.won) for r in fitting.long_lease_fit(who, ranks, assets, *incomes(spark)).collect()}
    assert got == {
        1: (True, 1, 100, 2500), 2: (True, 2, 120, 3000), 3: (True, 2, 120, 3000), 4: (False, None, None, None), 5: (True, 1, 120, 3000), 6: (False, 1, 100, 2500), 7: (True, 1, 120, 3000),
        8: (False, 1, 110, 2750), 9: (True, 1, 100, 2500), 10: (True, 2, 100, 2500), 11: (False, None, None, None), 12: (True, 1, 100, 2500), 13: (None, None, None, None), 14: (None, None, None, None),
        15: (True, 1, 100, 3600), 16: (True, 1, 100, None),  # a limit that nobody knows rules nobody out
    }


def test_stated_limits_come_first_and_go_on_by_person(spark):
    rows = people(spark, {"household": 2}, {"household": 7}, {"household": 1}, {"notice": 1, "household": 2}).withColumn("pct", F.lit(70))
    stated = [(0, 70, 2, 1500, 200), (0, 70, 3, 1900, 200)]
    got = {r.id: r.limit for r in fitting.with_limit(rows, *incomes(spark, stated), F.col("pct"), F.col("household"), "limit", True).collect()}
    assert got == {1: 1500, 2: 2700, 3: 900, 4: 1440}


def test_youths_of_a_first_class_and_by_their_own_income(spark):
    ranks = spark.createDataFrame([(0, 1, 1, 2, 100, 3000, 500), (0, 1, 2, 3, 100, 2500, 400)], PURCHASE_KIND)
    who = people(spark, {"priority_class": "수급자", "income": 10**6}, {}, {"income": 2501, "parents_homeless": True}, {"income": 2501, "income_self": 1201}, {"age": 45}, {"applicant": "취업준비생", "age": 45, "income": 1250})
    got = {r.id: (r.ok, r.rank, r.points) for r in fitting.youth_lease_fit(who, ranks, *incomes(spark)).collect()}
    assert got == {1: (True, 1, 6), 2: (True, 2, 3), 3: (True, 3, 5), 4: (False, None, None), 5: (False, 2, 3), 6: (True, 2, 6)}


def test_private_leases_have_two_tracks(spark):
    limits, income = spark.createDataFrame([("청년", 2000, 300)], "class string, asset int, car_limit int"), spark.createDataFrame([(3, 100, 2000), (3, 110, 2200), (3, 120, 2400)], "household int, pct int, won long")
    who = people(spark, {}, {"income": 2401}, {"assets": 2001}, {"car": 301}, {"age": 40}, {"homeless": False}, {"gu": "기타"}, {"gu": ""}, {"class": "신혼부부", "assets": 10**6})
    got = {r.id: (r.special, r.general, r.rank, r.region) for r in fitting.private_lease_fit(who, limits, income).collect()}
    assert got == {1: (True, True, 3, 1), 2: (False, True, None, 1), 3: (False, True, None, 1), 4: (False, False, None, 1), 5: (False, False, None, 1), 6: (False, False, None, 1), 7: (True, True, 3, 3), 8: (True, True, 3, None), 9: (True, True, 3, 1)}


@pytest.mark.parametrize(("row", "want"), [
    ((10, 20, 5, 25, 2.5), (25, 2.5, True, False)), ((10, 20, 5, 25, 25.0), (25, 2.5, True, True)), ((10, 20, 5, 26, 26.0), (26, 26.0, True, False)), ((10, 20, None, 63, 6.3), (63, 6.3, True, False)),
    ((10, 20, 5, None, 2.4), (24, 2.4, True, True)), ((10, 20, 5, 27, 9.0), (27, 9.0, False, False)), ((0, 1, 1, 2, None), (2, None, True, False)), ((None, None, None, None, None), (None, None, False, False)),
    ((4, 20, 19, 41, 102.0), (41, 102.0, False, False)), ((10, 200, 47, 247, 247.0), (247, 24.7, True, True)),
])
def test_competition_rows(spark, row, want):
    frame = spark.createDataFrame([row], "units long, online long, visit long, total long, ratio double")
    got = frame.select(glyphs.competition(*[F.col(c) for c in frame.columns]).alias("r")).first().r
    assert (got.total, got.ratio, got.ok, got.repaired) == want


def test_rules_are_read_from_text_cells(spark):
    cells = [(1, {"ID": " a ", "최소나이": "19.0", "최대나이": "", "소득기준%": "999", "자산만원": "0", "나이면제조건": "가| |나", "출산자녀가산": "y"}), (2, {"ID": ""}), (3, {"ID": "b"})]
    scores = [(1, {"ID": "a", "우선1순위조건": "x", "우선2순위조건": " ", "선정방식": "추첨", "배점": " 3 ", "빈칸": " "}), (2, {"ID": "a", "우선1순위조건": "y", "선정방식": "배점"})]
    frames = [spark.createDataFrame(x, "seq int, cells map<string,string>") for x in (cells, scores[:1])]
    got = {r.code: r for r in rulebooks.supply_types(*frames, {"b": "c"}).collect()}
    a = got.pop("a")
    assert (a.age_min, a.age_max, a.income_pct, a.asset_limit, a.age_exempt, a.birth_bonus, a.ranks, a.ranking_method, a.score) == (19, 999, None, 0, ["가", "나"], True, ["x"], "추첨", {"배점": "3"})
    assert set(got) == {"b"} and got["b"].marital == "무관" and got["b"].score == {} and got["b"].ranks == []
    last = rulebooks.supply_types(frames[0], spark.createDataFrame(scores, "seq int, cells map<string,string>")).filter("code = 'a'").first()
    assert last.ranking_method == "배점" and last.ranks == ["y"]
    sheet = spark.createDataFrame([(1, {"가구원수": "3", "70%": "100.0", "메모": "x", "100%": ""}), (2, {"가구원수": "이상", "70%": "5"})], "seq int, cells map<string,string>")
    assert [tuple(r) for r in rulebooks.income_standard(sheet, 2026).collect()] == [(2026, 3, 70, 100)]


def test_forms_do_not_overwrite_what_they_cannot_say(spark):
    tiers = spark.createDataFrame([("강남구", "sigungu", "서울"), ("인천", "sido", "연접")], "name string, kind string, tier string")
    kinds = "id int, region string, gu string, household int, age int, classes array<string>, marital string, homeless boolean, homeless_self boolean, income_home long, asset_home long, car long"
    rows = [(1, "인천", "", 1, 30, ["고령자", "신혼부부"], "기혼", True, False, 1, 1, 0), (2, "", "연접", 1, 30, [], "미혼", True, True, 1, 1, 0), (3, "강남구", "강남구", 1, 30, [], "기혼", True, True, 1, 1, 0)]
    full = profiles.reconciled(spark.createDataFrame(rows, kinds), tiers)
    assert {r.id: (r.region, r.gu, r.changed) for r in full.collect()} == {1: ("인천", "연접", True), 2: ("", "연접", False), 3: ("강남구", "강남구", False)}
    form = profiles.to_private(full)
    assert {r.id: (r["class"], r.household, r.gu) for r in form.collect()} == {1: ("신혼부부", 2, "기타"), 2: ("청년", 1, "기타"), 3: ("신혼부부", 2, "강남구")}
    back = {r.id: r for r in profiles.from_private(full.drop("changed"), form.filter("id < 3").withColumn("homeless", F.lit(False)), tiers).collect()}
    assert (back[1].gu, back[1].classes, back[1].homeless, back[1].homeless_self, back[1].household) == ("연접", ["고령자", "신혼부부"], False, False, 2)
    assert back[3].homeless and back[3].classes == []


def test_digit_errors_of_small_and_mixed_tables(spark):
    rows = [("t", 1, 1000, 10, 100), ("t", 2, 2000, 20, 100), ("t", 3, 30000, 30, None), ("t", 4, 400, 40, 100), ("t", 5, 20000, 50, 100), ("t", 6, None, 50, 100), ("t", 7, 10**7, None, 100), ("t", 8, 1500, 15, 100), ("s", 9, 1, 10, 100), ("s", 10, 10**6, 10, 100)]
    frame = spark.createDataFrame(rows, "k string, i int, deposit long, area int, ratio int")
    got = {r.i: (r.deposit, r.error) for r in quality.without_digit_errors(frame, ["k"], "deposit", "area", "ratio").collect()}
    assert got == {1: (1000, None), 2: (2000, None), 3: (3000, "fixed"), 4: (4000, "fixed"), 5: (20000, None), 6: (None, None), 7: (10**7, None), 8: (1500, None), 9: (1, None), 10: (10**6, None)}


def test_price_rows_and_areas(spark):
    def rows(*values):
        frame = spark.createDataFrame([values], "d long, r long, md long, mr long, down long, interim long, balance long")
        return [tuple(x) for x in frame.select(money.price_rows(*[F.col(c) for c in frame.columns]).alias("p")).first().p]

    assert rows(1005, None, None, None, 0, None, 0) == [("base", 1005, None), ("down-est", 101, None), ("balance-est", 905, None)]
    assert rows(1000, 0, 1000, 0, None, None, None) == [("base", 1000, 0)]
    assert rows(1000, None, 2000, None, 100, 0, 900) == [("base", 1000, None), ("down", 100, None), ("balance", 900, None), ("max", 2000, None)]
    frame = spark.createDataFrame([(1.005, None), (None, None), (2.0, 1.234)], "a double, b double")
    assert [r.x for r in frame.select(money.common_area(F.col("a"), F.col("b")).alias("x")).collect()] == [1.01, None, 3.23]


def test_posts_read_again_and_matches_by_address(spark):
    children = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "post string, row_no int, v int")
    ledger = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "x", "n"), ("c", 0, "x", "n")], "post string, row_count long, parsed_at string, note string")
    batch = spark.createDataFrame([("a", 1, 7, 2), ("a", 1, 8, 1), ("z", 1, 9, 1)], "post string, row_no int, v int, at int")
    after, log = merge.replace_by_post(children, ledger, batch, spark.createDataFrame([("a",), ("c",)], "post string"), ["post", "row_no"], "at", F.lit("now"), "empty")
    assert sorted(map(tuple, after.collect())) == [("a", 1, 8), ("b", 1, 2)]
    assert {r.post: (r.row_count, r.parsed_at, r.note) for r in log.collect()} == {"a": (2, "now", None), "b": (1, "x", "n"), "c": (0, "now", "empty")}
    places = spark.createDataFrame([(1, None, None, None), (2, 5.0, 5.0, "road"), (3, None, None, None)], "place int, lon double, lat double, precision string")
    found = spark.createDataFrame([(1, "x", 1.0, 2.0, "road"), (3, "x", 1.0, 2.0, "road")], "place int, address string, lon double, lat double, precision string")
    cache = spark.createDataFrame([("x", 9.0, 9.0, "dong"), ("y", 3.0, 3.0, "road")], "address string, lon double, lat double, precision string")
    now, kept = merge.write_matches(places, cache, found)
    assert {r.place: r.lon for r in now.collect()} == {1: 1.0, 2: 5.0, 3: 1.0} and {r.address: (r.lon, r.precision) for r in kept.collect()} == {"x": (1.0, "road"), "y": (3.0, "road")}


def test_earlier_results_are_summed_before_profiles_meet_them(spark, monkeypatch):
    results = spark.createDataFrame([(1, "e", ("소계", "1순위")[i % 2], None, 2, i) for i in range(400)], "notice int, estate string, bracket string, tenant_class string, units long, applicants long")
    asked = spark.createDataFrame([(i, 1, "e", "youth", None, 1, False) for i in range(300)], "id long, notice int, estate string, kind string, class string, rank long, priority boolean")
    frame, joins = type(asked), []
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **b: joins.append(join(self, *a, **b)) or joins[-1])
    rows = fitting.prior_for_estate(results, asked, "estate").collect()
    assert len(rows) == 300 and {tuple(r)[1:] for r in rows} == {(400, 40000, 400, 39800, 100.0, 99.5)}
    assert max(j.count() for j in joins) <= 300
