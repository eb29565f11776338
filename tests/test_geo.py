from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from noticelake.functions import geo


def to_grid(lon: float, lat: float) -> tuple[float, float]:
    """The forward projection, by its own series."""
    phi = math.radians(lat)
    n = geo.AXIS / math.sqrt(1 - geo.E2 * math.sin(phi) ** 2)
    t, c = math.tan(phi) ** 2, geo.SECOND_E2 * math.cos(phi) ** 2
    a = math.radians(lon - geo.ORIGIN_LON) * math.cos(phi)
    x = n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * geo.SECOND_E2) * a**5 / 120)
    rise = n * math.tan(phi) * (
        a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * geo.SECOND_E2) * a**6 / 720
    )
    y = geo.meridian(phi) - geo.meridian(math.radians(geo.ORIGIN_LAT)) + rise
    return geo.FALSE_EAST + geo.SCALE * x, geo.FALSE_NORTH + geo.SCALE * y


def test_the_equator_and_a_quarter_of_the_meridian():
    assert geo.meridian(0.0) == 0.0
    assert geo.meridian(math.pi / 2) == pytest.approx(10_001_965.729, abs=0.01)  # known length on GRS 80


def test_points_there_and_back(spark):
    points = [(127.5, 38.0), (126.978, 37.5665), (129.0756, 35.1796), (126.5312, 33.4996), (130.9, 37.24)]
    rows = [(i, *to_grid(*p)) for i, p in enumerate(points)] + [(9, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double").select("i", geo.to_degrees(F.col("x"), F.col("y")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert got.pop(9) is None
    for i, p in got.items():
        assert (p.lon, p.lat) == pytest.approx(points[i], abs=1e-7)
