"""Relational helpers that Spark lacks by name: each takes DataFrames and returns a lazy plan."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asc(column: str | Column) -> Column:
    """Ascending with nulls last, as the reference semantics order them."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def desc(column: str | Column) -> Column:
    """Descending with nulls first."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


#: Rows of a table, at most, that is sent to every task.
MOST_SMALL = 10_000


def small(df: DataFrame, most: int = MOST_SMALL) -> DataFrame:
    """``df`` marked to be sent to every task, after its rows were counted; more than ``most`` are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of more than {most} rows is not sent to every task")
    return F.broadcast(df)


#: Rows of a task, about, where it has to sort them.
MOST_DEALT = 500_000


def tasks_for(*frames: DataFrame, most: int = MOST_DEALT) -> int:
    """Into how many tasks the rows of ``frames`` are dealt so that each gets about ``most``; they are counted for that."""
    return 1 + sum(df.count() for df in frames) // most


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_k_per_group(df, keys, order, 1)


def top_k_per_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; the rank filter lets Spark cut groups before the shuffle."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def union_tagged(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """A union of frames of equal columns, each with its name in a tag column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def facets(df: DataFrame, axes: dict[str, tuple[Column, Column]], common: Column | None = None) -> DataFrame:
    """Counts per value of each axis under the filters of all other axes: kind, value, n.

    ``axes`` maps a name to the axis's value and its chosen filter. Every row is expanded once per axis
    whose other filters it passes, so one scan and one shuffle serve all axes.
    """
    cells = []
    for name, (value, _) in axes.items():
        others = all_of([F.coalesce(f, F.lit(False)) for other, (_, f) in axes.items() if other != name])
        cell = F.struct(F.lit(name).alias("kind"), value.cast("string").alias("value"))
        cells.append(F.when(others & value.isNotNull(), cell))
    base = df if common is None else df.filter(common)
    return (
        base.select(F.explode(F.array_compact(F.array(*cells))).alias("f"))
        .groupBy(F.col("f.kind").alias("kind"), F.col("f.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


@dataclass(frozen=True)
class SortKey:
    """One key of an order: an expression, its direction and where its nulls stand."""

    value: Column
    kind: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        name = f"{'desc' if self.descending else 'asc'}_nulls_{'first' if self.nulls_first else 'last'}"
        return getattr(self.value, name)()

    def beyond(self, bound: Column) -> Column:
        """Whether the key comes strictly behind a bound, which may be null."""
        further = self.value < bound if self.descending else self.value > bound
        if self.nulls_first:
            return F.coalesce(further, self.value.isNotNull() & bound.isNull())
        return F.coalesce(further, self.value.isNull() & bound.isNotNull())


def behind(keys: Sequence[SortKey], bounds: Sequence[Column]) -> Column:
    """The rows that follow a row with these keys in the order: the first key that differs decides."""
    found = F.lit(False)
    for key, bound in reversed(list(zip(keys, bounds, strict=True))):
        found = key.beyond(bound) | (key.value.eqNullSafe(bound) & found)
    return found


def cursor_values(keys: Sequence[SortKey]) -> Column:
    """The keys of a row as an array of text, of which ``to_cursor`` makes a cursor."""
    return F.array(*[k.value.cast("string") for k in keys])


def to_cursor(values: Sequence[str | None]) -> str:
    """The keys of the last row of a page as one word for a URL."""
    return base64.urlsafe_b64encode(json.dumps(list(values)).encode()).decode().rstrip("=")


def from_cursor(keys: Sequence[SortKey], cursor: str | None) -> list[Column] | None:
    """The bounds that a cursor names, or None if it does not fit the keys."""
    try:
        values = json.loads(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)))
    except ValueError:
        return None
    if not isinstance(values, list) or len(values) != len(keys) or not all(v is None or isinstance(v, str) for v in values):
        return None
    return [F.lit(v).try_cast(k.kind) for k, v in zip(keys, values, strict=True)]


def keyset_page(df: DataFrame, keys: Sequence[SortKey], bounds: Sequence[Column] | None, limit: int) -> DataFrame:
    """One page: the rows behind the bounds, in order, one more than ``limit`` to show if more follow."""
    rows = df if bounds is None else df.filter(behind(keys, bounds))
    return rows.orderBy(*[k.order() for k in keys]).limit(limit + 1)


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The latest row of each key, for joins with what belongs to it."""
    return distinct_on(df, keys, order)


def latest_snapshot(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """All rows of each key's last day; ties stay. Days are summed up before the shuffle, and no key's rows are held."""
    last = df.groupBy(*keys).agg(F.max(day).alias("__last"))
    return df.join(last, list(keys)).filter(F.col(day) == F.col("__last")).select(*df.columns)


def completeness(fields: Sequence[Column]) -> Column:
    """How many of the given conditions hold; null counts as no."""
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in fields])


def ratio_of_sums(top: Column, bottom: Column, digits: int) -> Column:
    """sum(top) / sum(bottom) rounded as a decimal; null where the lower sum is 0."""
    quotient = F.sum(top).cast("double") / F.nullif(F.sum(bottom).cast("double"), F.lit(0.0))
    return F.round(quotient.cast("decimal(28,8)"), digits).cast("double")


def runs(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Consecutive whole numbers per key as ranges: keys, first, last, n."""
    inside = Window.partitionBy(*keys).orderBy(position)
    marked = df.select(*keys, position).distinct().withColumn("__run", F.col(position) - F.row_number().over(inside))
    return marked.groupBy(*keys, "__run").agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")
    ).drop("__run")


def cap_steps(df: DataFrame, value: str, caps: Sequence[int]) -> DataFrame:
    """Thresholds worth offering: count above 0, below the total and not that of the step before."""
    counted = df.agg(F.count(value).alias("total"), *[F.count_if(F.col(value) <= c).alias(f"c{i}") for i, c in enumerate(caps)])
    steps = F.array(*[F.struct(F.lit(c).cast("long").alias("cap"), F.col(f"c{i}").alias("n")) for i, c in enumerate(caps)])
    rows = counted.select("total", F.posexplode(steps).alias("i", "s")).select("total", "i", "s.cap", "s.n")
    # one row per threshold: a handful
    before = F.lag("n").over(Window.partitionBy("total").orderBy("i"))
    return rows.withColumn("before", before).filter(
        (F.col("n") > 0) & (F.col("n") < F.col("total")) & ~F.col("n").eqNullSafe(F.col("before"))
    ).select("cap", "n")
