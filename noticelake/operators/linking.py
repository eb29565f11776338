"""Linking and deduplication of records: connected components, unique candidates, tiers and ladders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.operators.relational import distinct_on
from noticelake.session import checkpoint_dir


def shared_key_edges(df: DataFrame, node: str, key: Column) -> DataFrame:
    """Edges a, b from each row to the smallest of its key: a star for each key, not all pairs."""
    keyed = df.select(F.col(node).alias("a"), key.alias("k")).filter("k IS NOT NULL")
    least = keyed.groupBy("k").agg(F.min("a").alias("b"))
    return keyed.join(least, "k").filter("a <> b").select("a", "b")


def clusters(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """node and cluster, the smallest node reached; isolated nodes are their own cluster.

    Large and small stars in turn, written down after each round, until no edge changes: first every larger neighbour of a node, then
    the node and its smaller ones, are linked to the smallest of them. Long chains shrink to stars in few rounds.
    """
    known = edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked, before = saved(known.distinct()), None
    while True:
        now = linked.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = linked.union(linked.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select("m", F.explode(F.array("a", "b")).alias("a")).select("a", F.col("m").alias("b"))
        linked = saved(small.filter("a <> b").distinct())
    roots = linked.groupBy(F.col("a").alias(node)).agg(F.min("b").alias("cluster"))
    return nodes.select(node).join(roots.hint("merge"), node, "left").withColumn("cluster", F.coalesce("cluster", node))


def saved(df: DataFrame) -> DataFrame:
    """Written to and read from the folder of spark.checkpoint.dir, or a local one where Spark runs locally and that is unset.

    A checkpoint keeps the estimated size of its plan, a product over all joins, whose number of digits triples with each round until the
    driver can't hold it; files have their own size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def canonical_pick(df: DataFrame, cluster: str, order: Sequence[Column], node: str) -> DataFrame:
    """Rows with canonical: the first of their cluster in the given order, null for that row itself."""
    first = distinct_on(df, [cluster], order).select(cluster, F.col(node).alias("canonical"))
    return df.join(first, cluster).withColumn("canonical", F.when(F.col(node) != F.col("canonical"), F.col("canonical")))


def unique_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """``left`` with n, how many rows of ``right`` have its keys, and other, their ``node`` if there is one alone.

    Candidates are counted before the join, so each row of ``left`` meets one row at most.
    """
    counted = right.groupBy(*keys).agg(F.count("*").alias("n"), F.min(node).alias("other"))
    return left.join(counted, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("other", F.when(F.col("n") == 1, F.col("other")))


def lone_other(rows: DataFrame, node: str, keys: Sequence[str], day: str | None = None, reach: int = 0) -> DataFrame:
    """node, n and other: how many other rows have the same keys, within ``reach`` days if a day is given, and the one if it is alone.

    Rows are summed up by key and day; the one other is what the sum of the nodes leaves beside one's own. Null keys and days
    have no others.
    """
    known = rows.dropna(subset=[*keys, *([day] if day else [])])
    sums = known.groupBy(*keys, *([day] if day else [])).agg(F.count("*").alias("n"), F.sum(F.col(node).cast("decimal(38,0)")).alias("ids"))
    if day:
        near = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-reach, reach)
        sums = sums.select(*keys, day, F.sum("n").over(near).alias("n"), F.sum("ids").over(near).alias("ids"))
    joined = known.join(sums, [*keys, *([day] if day else [])]).withColumn("n", F.col("n") - 1)
    return joined.select(node, "n", F.when(F.col("n") == 1, (F.col("ids") - F.col(node)).cast("long")).alias("other"))


def first_tier(tiers: Sequence[DataFrame], node: str) -> DataFrame:
    """node, other, tier: of frames of node, n and other the first with any candidate; several candidates link nothing."""
    found = [t.filter("n > 0").select(node, F.struct(F.lit(i).alias("tier"), "other").alias("best")) for i, t in enumerate(tiers)]
    best = reduce(lambda a, b: a.unionByName(b), found).groupBy(node).agg(F.min("best").alias("best"))
    return best.filter("best.other IS NOT NULL").select(node, "best.other", "best.tier")


def lone_near(left: DataFrame, right: DataFrame, keys: Sequence[str], node: str, other: str, value: str, reach: float) -> DataFrame:
    """``node`` of each row of ``left``, n and other: how many rows of ``right`` have its keys and a ``value`` that differs by less than
    ``reach``, and the one if it is alone.

    Both sides are laid in one line by value and summed up in a frame around each row, so no pairs are made. Values are compared
    as exact decimals with four places. A range frame includes its ends; what lies exactly ``reach`` away is taken off by the next smaller step. Null
    keys and values have no neighbours.
    """
    scale = 4
    number = F.round(F.col(value).cast("decimal(28,8)") * 10**scale).cast("long")
    sides = [
        df.dropna(subset=[*keys, value]).select(*keys, number.alias("__at"), F.col(i).alias("__node"), F.lit(k).alias("__side"))
        for k, (df, i) in enumerate(((left, node), (right, other)))
    ]
    steps = int(round(reach * 10**scale)) - 1
    # rows of a value are summed first, so that a frame has a row for each value
    of_right = F.col("__side") == 1
    sums = sides[0].unionByName(sides[1]).groupBy(*keys, "__at").agg(F.count_if(of_right).alias("n"), F.sum(F.when(of_right, F.col("__node")).cast("decimal(38,0)")).alias("ids"))
    # a key's line is cut into bins; what lies near an edge is known in both bins, so no task has to hold a whole key
    width = 64 * (steps + 1)
    bins = F.array_distinct(F.array(*[F.floor((F.col("__at") + d) / width) for d in (-steps, 0, steps)]))
    sums = sums.withColumn("__bin", F.explode(bins))
    near = Window.partitionBy(*keys, "__bin").orderBy("__at").rangeBetween(-steps, steps)
    sums = sums.select(*keys, "__at", "__bin", F.sum("n").over(near).alias("n"), F.sum("ids").over(near).alias("ids"))
    sums = sums.filter(F.col("__bin") == F.floor(F.col("__at") / width)).drop("__bin")
    met = sides[0].join(sums, [*keys, "__at"])
    return met.select(F.col("__node").alias(node), "n", F.when(F.col("n") == 1, F.col("ids").cast("long")).alias("other"))


def relink(ledger: DataFrame, candidates: DataFrame, arrived: DataFrame, keys: Sequence[str], node: str, link: str, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``ledger`` with the links of its pending rows (``link`` is null) worked out again where their keys got a new candidate.

    ``rule`` takes pending rows and candidates and gives node, n and other, as the first linking did. Only keys among those of
    ``arrived`` can come out otherwise than before, so the rest is not looked at; rows that are linked stay as they are. ``candidates``
    holds old and new ones.
    """
    fresh = arrived.select(*keys).dropna().distinct()
    pending = ledger.filter(F.col(link).isNull()).drop(link).join(fresh, list(keys), "left_semi")
    asked = pending.select(*keys).distinct()
    found = rule(pending, candidates.join(asked, list(keys), "left_semi")).filter("n = 1").select(F.col(node).alias("__node"), F.col("other").alias("__new"))
    joined = ledger.join(found, F.col(node) == F.col("__node"), "left")
    return joined.withColumn(link, F.coalesce(link, "__new")).select(*ledger.columns)


def keep_all_if_none(children: DataFrame, parent: str, keep: Column) -> DataFrame:
    """Of each parent the children that pass the filter, or all of them if none does.

    Whether any does is a grouped maximum that is joined back, so a parent with many children is split like any other join.
    """
    kept = F.coalesce(keep, F.lit(False))
    marked = children.withColumn("__kept", kept)
    known = marked.groupBy(F.col(parent).alias("__parent")).agg(F.max("__kept").alias("__any"))
    back = marked.join(known, F.col(parent).eqNullSafe(F.col("__parent")))
    return back.filter(F.col("__kept") | ~F.col("__any")).drop("__kept", "__any", "__parent")


def address_ladder(queries: DataFrame, index: DataFrame) -> DataFrame:
    """id, lon, lat, precision from a road, a main and a sub number, with an optional district.

    First the exact number, then the main number alone if a sub number was given. The districts of the
    hits must agree with the query's, and without one only a single district will do. The index is first folded to
    one row for each number, with the first point of each of its districts, so a query meets one row on each rung.
    """
    point = F.min(F.struct("lon", "lat")).alias("point")

    def rung(asked: DataFrame, keys: list[str], precision: str) -> DataFrame:
        districts = index.groupBy(*keys, "district").agg(point)
        folded = districts.groupBy(*keys).agg(F.collect_list(F.struct(F.col("district").alias("found"), "point")).alias("places"))
        fitting = F.filter("places", lambda x: F.col("district").isNull() | x["found"].startswith(F.col("district")))
        hits = asked.join(folded, keys).select("id", fitting.alias("places")).filter(F.size("places") == 1)
        at = F.col("places")[0]["point"]
        return hits.select("id", at["lon"].alias("lon"), at["lat"].alias("lat"), F.lit(precision).alias("precision"))

    exact = rung(queries, ["road", "main", "sub"], "building")
    rest = queries.join(exact, "id", "left_anti").filter("sub <> 0").drop("sub")
    return exact.unionByName(rung(rest, ["road", "main"], "road"))
