"""Queries that no SQL can check: their rows against what is known."""

from __future__ import annotations

import pytest

from noticelake import plans
from tests.test_geo import to_grid

SF = "/root/testdata/sf0.001"


def test_korean_readers_find_numbers_then_hangul_then_latin(spark):
    place = {n: i for i, n in enumerate(("1단지", "가람", "나무", "하늘", "apple", "Banana"))}
    rows = plans.queries()["korean_order"](spark, SF).collect()
    keys = [(place[r.name], r.p_partkey) for r in rows]
    assert keys == sorted(keys) and len(rows) == 100
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert len({k for k, _ in keys}) >= min(3, parts // 40)


def test_grid_points_lead_back_to_the_grid(spark):
    rows = plans.queries()["grid_points"](spark, SF).limit(200).collect()
    assert rows
    for r in rows:
        k = r.c_custkey
        assert to_grid(r.lon, r.lat) == pytest.approx((950_000 + k % 1000 * 100, 1_900_000 + k % 777 * 200), abs=0.01)


def test_parcel_links_name_one_estate_or_say_why(spark):
    rows = plans.queries()["parcel_links"](spark, SF).collect()
    linked = {"linked", "linked_other_kind"}
    assert len(rows) == len({r.id for r in rows}) == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert all((r.code is not None) == (r.reason in linked) for r in rows) and {r.reason for r in rows} <= linked | {"none", "several", "homes"}
