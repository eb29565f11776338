"""Rule tables applied to profiles: three-valued checks, income limits, scores and cut lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.relational import distinct_on, small


def at_most(value: Column, limit: Column) -> Column:
    """True without a limit, null for an unknown value."""
    return F.when(limit.isNull(), F.lit(True)).otherwise(value <= limit)


def at_least(value: Column, limit: Column) -> Column:
    return F.when(limit.isNull(), F.lit(True)).otherwise(value >= limit)


def required(flag: Column, needed: Column) -> Column:
    """True where nothing is required; otherwise the flag, which may be unknown."""
    return F.when(~F.coalesce(needed, F.lit(False)), F.lit(True)).otherwise(flag)


def one_of(values: Column, allowed: Column) -> Column:
    """Whether an array shares a value with the allowed ones; true if all are allowed."""
    return F.when(allowed.isNull() | (F.size(allowed) == 0), F.lit(True)).otherwise(F.arrays_overlap(values, allowed))


def income_limits(profiles: DataFrame, standard: DataFrame, household: str, pct: Column, bonus: bool = True) -> DataFrame:
    """``profiles`` with income_limit: the stated amount of the household's size and percentage, else the
    base amount of that size times the percentage, rounded half up. Sizes count from 1 to 7; households of one
    and two get 20 and 10 points more.
    """
    size = F.least(F.greatest(F.col(household), F.lit(1)), F.lit(7))
    extra = F.when(F.col(household) == 1, 20).when(F.col(household) == 2, 10).otherwise(0) if bonus else F.lit(0)
    rows = profiles.withColumn("__size", size).withColumn("__pct", pct + extra)
    stated = standard.select(F.col("household").alias("__size"), F.col("pct").alias("__pct"), F.col("amount").alias("__stated"))
    base = standard.filter("pct = 100").select(F.col("household").alias("__size"), F.col("amount").alias("__base"))
    joined = rows.join(small(stated), ["__size", "__pct"], "left").join(small(base), "__size", "left")
    limit = F.coalesce("__stated", F.floor(F.col("__base") * F.col("__pct") / 100 + 0.5).cast("long"))
    return joined.withColumn("income_limit", limit).drop("__size", "__pct", "__stated", "__base")


def verdict(checks: Sequence[Column]) -> tuple[Column, Column]:
    """(ok, unsure): ok if no check is false; unsure if one is unknown."""
    passes = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in checks])
    unknown = reduce(lambda a, b: a | b, [c.isNull() for c in checks])
    return passes, passes & unknown


def clamp(value: Column, low: int, high: int) -> Column:
    """The value within bounds; null stays."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def band_score(value: Column, steps: Sequence[tuple[int, int]]) -> Column:
    """Points of the first step whose least value is reached; steps from high to low; unknown gives null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for least, points in steps:
        out = out.when(value >= least, F.lit(points))
    return out.otherwise(0)


def standing(rank: Column, score: Column, cut_rank: Column, cut_score: Column) -> Column:
    """win, tie or below a cut line: the smaller rank wins, then the larger score.

    A cut without a score let all of its rank pass. Without own score nothing can be said.
    """
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(rank < cut_rank, "win").when(rank > cut_rank, "below")
        .when(cut_score.isNull() | (score > cut_score), "win").when(score == cut_score, "tie").otherwise("below")
    )


def first_fitting(profiles: DataFrame, ranks: DataFrame, key: str, fits: Column, order: str) -> DataFrame:
    """The first rank row, by ``order``, that each profile satisfies; profiles without one are absent.

    ``ranks`` is a rule table, which is sent to every task once its size has been checked.
    """
    pairs = profiles.join(small(ranks), fits)
    return distinct_on(pairs, [key], [F.col(order)])


def monotonic(options: Column) -> Column:
    """Whether deposits do not fall and rents do not rise from option to option."""
    deposits, rents = F.transform(options, lambda o: o["deposit"]), F.transform(options, lambda o: o["rent"])
    return (deposits == F.array_sort(deposits)) & (rents == F.reverse(F.array_sort(rents)))


def lowest_deposit(options: Column) -> Column:
    """The option with the lowest deposit, then the lowest rent."""
    return F.array_min(F.transform(options, lambda o: F.struct(o["deposit"].alias("deposit"), o["rent"].alias("rent"), o["label"].alias("label"))))
