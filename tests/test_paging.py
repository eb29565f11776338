from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noticelake.operators.relational import all_of, cursor_values, from_cursor, to_cursor
from noticelake.plans.base import notices
from noticelake.plans.listing import Filters, order_of, page

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sort", ["posted", "rent", "deadline"])
def test_pages_concatenate_to_the_whole_list(spark, sort):
    rows = notices(spark, SF).filter("o_custkey % 10 = 1").cache()
    filters = Filters(include_closed=True)
    whole = [r.id for r in rows.filter(all_of(filters.predicates())).orderBy(*[k.order() for k in order_of(sort)]).collect()]
    got, cursor = [], None
    for _ in range(len(whole) // 40 + 2):
        found = page(rows, filters, sort, cursor, 40).withColumn("keys", cursor_values(order_of(sort))).collect()
        got += [r.id for r in found[:40]]
        if len(found) <= 40:
            break
        cursor = to_cursor(found[39]['keys'])
    assert got == whole


@pytest.mark.parametrize("cursor", [None, "", "x", "1_2", to_cursor(["1"]), to_cursor(["1", "2", "3", "4"]), "1998-01-01_1_2; drop"])
def test_invalid_cursor_is_the_first_page(spark, cursor):
    assert from_cursor(order_of("posted"), cursor) is None


def test_closed_notices_never_lead_the_deadlines(spark):
    """A day far ahead counts for nothing once a notice is closed by its status or its announcement."""
    rows = spark.createDataFrame(
        [(1, "F", "1999-01-01", None), (2, "O", "1999-01-01", "1998-01-01"), (3, "O", "1999-06-01", None), (4, "O", None, None), (5, "O", "1998-01-01", None)],
        "id long, status string, apply_end string, announce string",
    ).selectExpr("id", "status", "date(apply_end) AS apply_end", "date(announce) AS announce", "date'1998-01-01' AS posted_at", "1L AS source_rank")
    assert [r.id for r in rows.orderBy(*[k.order() for k in order_of("deadline")]).collect()] == [3, 2, 1, 5, 4]


def test_filters_drop_null_money(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 5, 5)], "id long, min_rent long, min_deposit long")
    assert [r.id for r in rows.filter(F.col("min_rent") <= 9).collect()] == [2]
