"""Checks of profiles against rules, one at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noticelake.operators import eligibility as el

RULE = {"code": "x", "age_min": 0, "age_max": 999, "age_exempt": [], "marital": "무관", "marital_max_yr": None, "newborn_exempt": False, "required_class": [],
        "homeless_scope": "세대원", "income_pct": 100, "income_pct_dual": None, "income_small_bonus": False, "income_scope": "세대", "asset_limit": None,
        "asset_scope": "세대", "car_limit": None, "region_limit": None}
PROFILE = "age int, marital_state string, married_years int, classes array<string>, homeless boolean, homeless_self boolean, household int, income_self long, " \
          "income_home long, asset_self long, asset_home long, car long, has_newborn boolean, dual boolean, residence string"
PERSON = (30, "기혼", 3, ["청년"], True, True, 3, 900, 2400, 100, 200, 0, False, False, "강남구")
TIERS = [("강남구", "sigungu", "서울"), ("서울특별시", "sido", "서울"), ("인천광역시", "sido", "연접")]
STANDARD = [(1, 100, 1000), (2, 100, 1800), (3, 100, 2500), (4, 100, 3000), (7, 100, 3600), (3, 80, 1990)]


def verdict(spark, rule=None, **person):
    names = [x.split()[0] for x in PROFILE.split(", ")]
    row = tuple({**dict(zip(names, PERSON, strict=True)), **person}[n] for n in names)
    people = spark.createDataFrame([row], PROFILE).withColumn("tier", el.tier_of(F.col("residence"), TIERS))
    rules = spark.createDataFrame([tuple({**RULE, **(rule or {})}.values())], el.RULE)
    known = el.with_income_limits(people.join(rules), spark.createDataFrame(STANDARD, "household int, pct int, amount long"))
    ok, unsure, failed = el.diagnose(known)
    r = known.select(ok.alias("ok"), unsure.alias("u"), failed.alias("f"), "limit_home", "limit_self").first()
    return (r.ok, r.u, r.f), r


@pytest.mark.parametrize(("rule", "person", "want"), [
    ({}, {}, (True, False, [])),
    ({"age_min": 19, "age_max": 29}, {}, (False, False, [1])),
    ({"age_min": 19, "age_max": 29, "age_exempt": ["청년"]}, {}, (True, False, [])),
    ({"marital": "미혼"}, {}, (False, False, [2])),
    ({"marital": "혼인", "marital_max_yr": 2}, {}, (False, False, [2])),
    ({"marital": "혼인", "marital_max_yr": 2, "newborn_exempt": True}, {}, (True, True, [])),
    ({"marital": "혼인", "marital_max_yr": 2, "newborn_exempt": True}, {"has_newborn": True}, (True, False, [])),
    ({"marital": "혼인", "marital_max_yr": 2}, {"classes": ["한부모"], "marital_state": "미혼"}, (True, False, [])),
    ({"marital": "혼인"}, {"marital_state": "예비신혼부부"}, (True, False, [])),
    ({"marital": "무관", "marital_max_yr": 2}, {}, (False, False, [2])),
    ({"required_class": ["고령자"]}, {}, (False, False, [3])),
    ({"homeless_scope": "본인"}, {"homeless": False}, (True, False, [])),
    ({}, {"homeless": False}, (False, False, [4])),
    ({}, {"income_home": 2501}, (False, False, [5])),
    ({"income_scope": "세대주분기"}, {"income_self": 1001}, (True, True, [])),
    ({"income_scope": "세대주분기"}, {"income_self": 1001, "income_home": 2501}, (False, False, [5])),
    ({"income_scope": "본인+부모"}, {}, (True, True, [])),
    ({"income_pct": None}, {"income_home": 10**9}, (True, False, [])),
    ({"asset_limit": 150}, {}, (False, False, [6])),
    ({"asset_limit": 150, "asset_scope": "세대주분기"}, {}, (True, True, [])),
    ({"car_limit": 0}, {"car": 1}, (False, False, [7])),
    ({"region_limit": "서울"}, {"residence": "인천광역시 서구"}, (False, False, [8])),
    ({"region_limit": "서울"}, {"residence": ""}, (True, True, [])),
    ({"region_limit": "모집지역"}, {"residence": "수원시"}, (True, False, [])),
])
def test_checks(spark, rule, person, want):
    assert verdict(spark, rule, **person)[0] == want


def test_income_limits(spark):
    assert verdict(spark, {"income_pct": 80})[1].limit_home == 1990  # as stated
    assert verdict(spark, {"income_pct": 70})[1].limit_home == 1750  # of the base
    r = verdict(spark, {"income_pct": 100, "income_pct_dual": 120, "income_small_bonus": True}, household=2, dual=True)[1]
    assert (r.limit_home, r.limit_self) == (2340, 1400)  # 130 and 140 points
    assert verdict(spark, {"income_pct": 100}, household=9)[1].limit_home == 3600
