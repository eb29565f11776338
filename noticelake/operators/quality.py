"""Quality rules: rows that break one go to quarantine with the reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The clean rows, and the others with ``reasons``; a rule that gives null is not broken."""
    hits = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    marked = df.withColumn("reasons", F.array_compact(F.array(*hits)))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def changed_counts(before: DataFrame, after: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys whose number of rows changed by more than a share of what it was."""
    b = before.groupBy(*keys).agg(F.count("*").alias("before"))
    a = after.groupBy(*keys).agg(F.count("*").alias("after"))
    both = b.join(a, keys, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return both.filter(F.abs(F.col("after") - F.col("before")) > share * F.col("before"))


#: How far from the middle a value is a typing error, and how near a repaired one must come.
FAR, NEAR, LEAST_ROWS = 5, 2, 3


def without_digit_errors(rows: DataFrame, keys: Sequence[str], deposit: str, area: str, ratio: str) -> DataFrame:
    """``rows`` with ``deposit`` repaired where a digit too many or too few was typed, and error: fixed, dropped or null.

    Within a table, its keys, a deposit goes with the area and the ratio that it is for (100 if there is none). Far from the upper median
    of that, the one power of ten that brings it near is applied; with none or several the deposit is dropped, as null. Tables of
    less than LEAST_ROWS rows, and rows without an area or deposit, stay as they are. All is exact decimals.
    """
    exact = "decimal(20,6)"
    share = F.coalesce(F.nullif(F.col(ratio), F.lit(0)), F.lit(100)).cast(exact)
    norm = F.when(F.col(area) > 0, (F.col(deposit).cast("decimal(28,8)") / (F.col(area).cast("decimal(12,4)") * share.cast("decimal(8,2)"))).cast("decimal(28,8)"))
    known = rows.withColumn("__norm", norm)
    counted = known.filter("__norm IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("__n"))
    # the upper median: of the values in order the one at half their number, found by their rank
    order = Window.partitionBy(*keys).orderBy("__norm")
    ranked = known.filter("__norm IS NOT NULL").select(*keys, "__norm", F.row_number().over(order).alias("__at")).join(counted, list(keys))
    middle = ranked.filter((F.col("__at") == F.floor(F.col("__n") / 2) + 1) & (F.col("__n") >= LEAST_ROWS)).select(*keys, F.col("__norm").alias("__mid"))
    joined = known.join(middle, list(keys), "left")
    mid, value = F.col("__mid"), F.col("__norm")
    fine = mid.isNull() | value.isNull() | (mid <= 0) | ((value * FAR >= mid) & (value <= mid * FAR))
    factors = F.array(*[F.lit(f).cast("decimal(6,2)") for f in ("10", "0.1", "100", "0.01")])
    fits = F.filter(factors, lambda f: (value * f * NEAR >= mid) & (value * f <= mid * NEAR))
    repaired = F.when(F.size(fits) == 1, F.floor(F.col(deposit).cast("decimal(20,2)") * fits[0]).cast("long"))
    error = F.when(~fine, F.when(F.size(fits) == 1, "fixed").otherwise("dropped"))
    return joined.select(*[F.when(fine, F.col(c)).otherwise(repaired).alias(c) if c == deposit else F.col(c) for c in rows.columns], error.alias("error"))
