from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from noticelake.streaming.page_views import VIEW, daily_views, daily_visitors, read_views, upsert_batches, valid_views

A, B = "0b2b3c4d-1111-4abc-8def-000000000001", "0b2b3c4d-1111-4abc-8def-000000000002"
AGENT = "Mozilla/5.0 (X11)"


def views(spark):
    t = dt.datetime(2024, 1, 1, 14, 59, tzinfo=dt.UTC)  # a minute before midnight in Korea
    rows = [
        (1, A, "/x?q=1", None, AGENT, t), (2, A, "/x", "h", AGENT, t + dt.timedelta(minutes=2)), (3, B, "/x#f", "h", AGENT, t),
        (4, B, "/admin/a", None, AGENT, t), (5, "bad", "/x", None, AGENT, t), (6, A, "/x", None, "Googlebot/2.1 long", t), (7, A, "x", None, AGENT, t),
        (8, A, "/y", None, "short", t), (9, A, "/x", None, AGENT, t + dt.timedelta(minutes=3)),
    ]
    return spark.createDataFrame(rows, VIEW)


def test_validation(spark):
    assert sorted((r.id, r.path) for r in valid_views(views(spark)).collect()) == [(1, "/x"), (2, "/x"), (3, "/x"), (9, "/x")]


def test_robots_ids_and_referrers(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    agents = [AGENT, "NAVER(inapp; search; 1000; 12.7.0)", "cubot note 20 browser", "curl/8.5.0 (x86)", "okhttp/4.12.0", "Yeti/1.1 (search)", "  short   ", None]
    rows = [(i, "0B2B3C4D-1111-0ABC-0DEF-00000000000F", "/x", h, a, t) for i, (a, h) in enumerate(zip(agents, [" WWW.Example.org ", "a/b", "a b", None, None, None, None, None], strict=True))]
    got = sorted(map(tuple, valid_views(spark.createDataFrame(rows, VIEW)).select("id", "referrer_host").collect()))
    assert got == [(0, "www.example.org"), (1, None)]


def run(spark, tmp_path, build, mode):
    folder = tmp_path / "in"
    views(spark).repartition(3).write.mode("overwrite").parquet(str(folder))
    name = f"t{abs(hash(str(tmp_path)))}"
    df = build(valid_views(read_views(spark, str(folder))))
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_daily_views_equal_batch(spark, tmp_path):
    got = run(spark, tmp_path, daily_views, "complete")
    want = daily_views(valid_views(views(spark)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [
        (dt.date(2024, 1, 1), "/x", 2), (dt.date(2024, 1, 2), "/x", 2)]


def test_daily_visitors_count_each_once(spark):
    got = {r.day: r.visitors for r in daily_visitors(valid_views(views(spark))).collect()}
    assert got == {dt.date(2024, 1, 1): 2, dt.date(2024, 1, 2): 1}


def test_upsert_batches_can_be_run_again(spark, tmp_path):
    write = upsert_batches(str(tmp_path / "t"), lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("v").alias("v")))
    write(spark.createDataFrame([(1, 1)], "k int, v int"), 0)
    for _ in range(2):
        write(spark.createDataFrame([(1, 2), (2, 1)], "k int, v int"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v=1")).select("k", "v").collect())) == [(1, 2), (2, 1)]
