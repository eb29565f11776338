from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticelake.functions.addresses import province, road_address
from noticelake.functions.periods import application_window, is_subsequence, period


@pytest.mark.parametrize(("text", "want"), [
    ("'26. 09. 10.(목) 17:00 ~ 09. 14.", (dt.date(2026, 9, 10), dt.date(2026, 9, 14), "17:00", None)),
    ("2025.12.30 10:00 ~ 01.05 24:00", (dt.date(2025, 12, 30), dt.date(2026, 1, 5), "10:00", "00:00")),
    ("2026. 3. 2. ~ 5.", (dt.date(2026, 3, 2), dt.date(2026, 3, 5), None, None)),
    ("‘26. 09. 10. (목) 17:00 ~ 09. 14. (월) 23:00", (dt.date(2026, 9, 10), dt.date(2026, 9, 14), "17:00", "23:00")),
    ("'26. 09. 10. (월) 10:00 ~ 17:00", (dt.date(2026, 9, 10), dt.date(2026, 9, 10), "10:00", "17:00")),
    ("2022.11.21.(월)~2022.11.23.(수) [3일간]", (dt.date(2022, 11, 21), dt.date(2022, 11, 23), None, None)),
    ("‘25. 07. 25. (금) 10시 ~ 07. 30. (수) 17시", (dt.date(2025, 7, 25), dt.date(2025, 7, 30), "10:00", "17:00")),
    ("2025년 1월 16일(목) 9시 ~ 17일(금) 18시", (dt.date(2025, 1, 16), dt.date(2025, 1, 17), "09:00", "18:00")),
    ("‘25. 12. 30. (화) 10:00 ~ 01. 02. (금) 17:00", (dt.date(2025, 12, 30), dt.date(2026, 1, 2), "10:00", "17:00")),
    ("2022. 11. 21.(월) - 11. 25.(금)", (dt.date(2022, 11, 21), dt.date(2022, 11, 25), None, None)),
    ("'24. 03. 01 ~ 02. 29", (dt.date(2024, 3, 1), dt.date(2024, 3, 1), None, None)),
    ("2024.03.01 ~ 별도 안내", (dt.date(2024, 3, 1), dt.date(2024, 3, 1), None, None)), ("추후 개별 연락", None),
    ("2026-02-30", None), ("미정", None), ("", None), (None, None),
])
def test_periods(text, want):
    assert application_window(text) == want


def test_periods_in_batches(spark):
    rows = spark.createDataFrame([("2026.03.02 ~ 03.05",), (None,)], "t string").select(period("t").alias("p")).collect()
    assert rows[0].p.end == dt.date(2026, 3, 5) and rows[1].p.start is None


@pytest.mark.parametrize(("text", "want"), [
    ("서울 강남구 테헤란로 123-4 (역삼동)", ("서울특별시", "강남구", "테헤란로", False, 123, 4)),
    ("경기도 수원시 영통구 광교로42번길 7", ("경기도", "수원시 영통구", "광교로42번길", False, 7, 0)),
    ("서울특별시 중구 을지로지하 12", ("서울특별시", "중구", "을지로", True, 12, 0)),
    ("강남대로123", (None, None, "강남대로", False, 123, 0)), ("번지 없음", None), (None, None),
])
def test_road_addresses(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(road_address(F.col("t")).alias("a")).first().a
    assert (tuple(row) if row else None) == want


def test_province_given_from_outside(spark):
    df = spark.createDataFrame([("중앙로 5", "부산"), ("서울 중앙로 5", "부산")], "t string, p string")
    assert [r.s for r in df.select(road_address(F.col("t"), F.col("p"))["sido"].alias("s")).collect()] == ["부산광역시", "서울특별시"]
    assert df.select(province(F.lit("없음")).alias("x")).first().x is None


def test_subsequence():
    assert is_subsequence("135", "12345") and not is_subsequence("531", "12345") and is_subsequence("", "")
