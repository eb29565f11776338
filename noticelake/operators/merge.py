"""Copy-on-write merges: each takes the old snapshot and the new rows and returns the next snapshot.

Plain Parquet has no update in place, so a mutation is a pure function of two frames. The caller writes
its result as a new snapshot and then moves the pointer to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.relational import distinct_on, tasks_for


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    keep_if_null: Sequence[str] = (),
    never: Sequence[str] = (),
    unseen: Sequence[str] = (),
    expressions: dict[str, Column] | None = None,
) -> DataFrame:
    """Old and new rows merged by key, with the flags inserted and changed.

    New values overwrite, except: columns in ``keep_if_null`` keep the old value where the new one is
    null; those in ``never`` keep it always; ``expressions`` (over o.x and n.x) decide for themselves.
    ``changed`` compares all columns but the keys and ``unseen``. Rows without a new version pass through
    with both flags false. Keys match null-safely; each side has a key once.
    """
    expressions = expressions or {}
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = o.join(n, match, "full_outer")
    has_old, has_new = F.col("__o").isNotNull(), F.col("__n").isNotNull()
    merged = []
    for c in old.columns:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            value = F.when(has_old, before).otherwise(after)
        elif c in expressions:
            value = F.when(has_new & has_old, expressions[c]).when(has_new, after).otherwise(before)
        elif c in never or c not in new.columns:
            value = F.when(has_old, before).otherwise(after)
        elif c in keep_if_null:
            value = F.coalesce(after, before)
        else:
            value = F.when(has_new, after).otherwise(before)
        merged.append(value.alias(c))
    compared = [c for c in old.columns if c not in keys and c not in unseen]
    was = F.struct(*[F.col(f"__was.{c}") for c in compared])
    now = F.struct(*[F.col(c) for c in compared])
    out = joined.select(
        *merged, F.struct(*[F.col(f"o.{c}").alias(c) for c in compared]).alias("__was"),
        (~has_old).alias("inserted"), (has_old & has_new).alias("__both"),
    )
    return out.withColumn("changed", F.col("__both") & ~was.eqNullSafe(now)).drop("__was", "__both")


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """The children of the parents in the batch are exactly the new ones; those of others stay."""
    kept = old.join(parents.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def replace_folded(old: DataFrame, new: DataFrame, keys: Sequence[str], folds: dict[str, str], carry: Sequence[str]) -> DataFrame:
    """New rows folded by key (sum, min or max per column) with enrichment columns carried over from old rows."""
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    folded = new.groupBy(*keys).agg(*[how[f](c).alias(c) for c, f in folds.items()])
    before = distinct_on(old.select(*keys, *carry), keys, [F.col(c).asc_nulls_last() for c in carry])
    return folded.join(before, list(keys), "left")


def first_wins(new: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Of rows with one key the first by position."""
    return distinct_on(new, keys, [F.col(position).asc_nulls_last()])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and those of the new ones whose key no old row has."""
    match = [old[k].eqNullSafe(new[k]) for k in keys]
    fresh = new.join(old, match, "left_anti").dropDuplicates(list(keys))
    return old.unionByName(fresh.select(*old.columns))


def sweep(rows: DataFrame, seen: DataFrame, key: str, covered: Column, status: str, closed: str) -> DataFrame:
    """Rows in the covered range that a scan has not seen, closed; with the status before."""
    missing = rows.filter(covered & ~F.col(status).eqNullSafe(F.lit(closed))).join(seen.select(key).distinct(), key, "left_anti")
    return missing.withColumn("before", F.col(status)).withColumn(status, F.lit(closed))


def retain(rows: DataFrame, stamp: Column, as_of: Column, months: int) -> DataFrame:
    """Rows no older than so many months."""
    return rows.filter(stamp >= F.add_months(as_of, -months))


def update_evaluated(old: DataFrame, links: DataFrame, evaluated: DataFrame, key: str, column: str) -> DataFrame:
    """``old`` with the link of every evaluated row set anew, to null where none was found, and the flag changed.

    Rows that were not looked at keep theirs. ``links`` and ``evaluated`` have each key once.
    """
    looked = evaluated.select(key, F.lit(True).alias("__looked")).join(links.select(key, F.col(column).alias("__link")), key, "left")
    joined = old.join(looked, key, "left")
    after = F.when(F.col("__looked"), F.col("__link")).otherwise(F.col(column))
    changed = ~F.col(column).eqNullSafe(after)
    columns = [after.alias(column) if c == column else F.col(c) for c in old.columns]
    return joined.select(*columns, changed.alias("changed"))


def sync(old: DataFrame, seed: DataFrame, scope: Column | None = None) -> DataFrame:
    """The table as the seed has it; rows of the old one stay only outside the scope, and none without one."""
    return seed if scope is None else old.filter(~F.coalesce(scope, F.lit(False))).unionByName(seed)


def amendment_links(rows: DataFrame, cluster: str, node: str, amended: Column, canonical: Column) -> DataFrame:
    """node and amends: for the canonical row of a cluster, if it is an amendment and others are not, the latest such; else null."""
    original = rows.filter(~amended).groupBy(cluster).agg(F.max(node).alias("amends"))
    return rows.join(original, cluster, "left").select(node, F.when(canonical & amended, F.col("amends")).alias("amends"))


def replace_by_post(children: DataFrame, ledger: DataFrame, batch: DataFrame, posts: DataFrame, keys: Sequence[str], order: str, now: Column, empty: str) -> tuple[DataFrame, DataFrame]:
    """The children and the ledger after some posts were read again.

    The children of the posts in ``posts`` are exactly those of the batch, of rows with one key the first by ``order``; those of other
    posts stay. Their rows in the ledger get the number of rows, the time, and a note where there is no row. ``ledger`` has post, row_count,
    parsed_at and note; the first of ``keys`` is the post.
    """
    post = keys[0]
    # all are dealt by post into the same tasks, as many as the rows need, so that what a task sorts doesn't grow with the tables
    tasks = tasks_for(batch, posts)
    again = posts.select(post).repartition(tasks, post).distinct()
    own = first_wins(batch.repartition(tasks, post).join(again, post, "left_semi"), keys, order)
    after = replace_children(children.repartition(tasks, post), own, again, post)
    counts = batch.groupBy(F.col(post).alias("__post")).agg(F.count("*").alias("__n"))
    read = posts.select(F.col(post).alias("__post")).distinct().join(counts, "__post", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    joined = ledger.join(read, F.col(post) == F.col("__post"), "left")
    seen, n = F.col("__post").isNotNull(), F.col("__n")
    new = {"row_count": n, "parsed_at": now, "note": F.when(n == 0, F.lit(empty))}
    return after, joined.select(*[F.when(seen, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in ledger.columns])


def write_matches(places: DataFrame, cache: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places and the cache of matches after a geocoding run.

    ``found`` has place, address (as it is normalised), lon, lat and precision. The cache has a row for each normalised address, so that
    places spelt in several ways share one; of several matches of an address the one of the smallest place counts. Places that the run
    missed keep what they had.
    """
    once = found.groupBy("address").agg(F.min_by(F.struct("lon", "lat", "precision"), "place").alias("m")).select("address", "m.*")
    merged = upsert(cache, once, ["address"]).drop("inserted", "changed")
    given = found.groupBy("place").agg(F.min_by(F.struct("lon", "lat", "precision"), "address").alias("__m"))
    joined = places.join(given, "place", "left")
    out = [F.when(F.col("__m").isNotNull(), F.col(f"__m.{c}")).otherwise(F.col(c)).alias(c) if c in ("lon", "lat", "precision") else F.col(c) for c in places.columns]
    return joined.select(*out), merged
