"""A mix of sources whose words come to target numbers, by fitting budgets with sums of whole documents.

Each source is taken whole as often as its target allows. What is left of the target is a budget for a part of its documents:
they are counted by their exact length, the lengths give their even share, and a bounded-knapsack dynamic programme over
documents of common lengths fills the rest, exactly where they can. A source's table of lengths has at most about the square root of
twice its words as rows, as each length in it is there at least once.

Which documents of a length are taken is decided by a seeded hash, in cells of about the square root of the number of documents,
so no length, source or group of copies meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.shared import documents, stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 17
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: The dynamic programme gets a budget of so many documents of the usual length.
ROOM = 64


def nearest(table: int, budget: int) -> int:
    """The set bit of ``table`` that is nearest to ``budget``; of two as near, the lower. Bit 0 is set."""
    low = (table & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = table >> (budget + 1)
    high = budget + (above & -above).bit_length()
    return high if above and high - budget < budget - low else low


def reached(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length, of (length, how many there are), sum up to ``budget`` or as near to it as any choice does.

    Bounded knapsack: bit s of the table says that s words can be had, up to twice the budget, as what is beyond is farther off than
    nothing. Copies of a length enter in doubling bundles. The tables are kept to walk back over them; the programme ends when
    no choice can be nearer, as all sums are multiples of the lengths' common divisor.
    """
    most = 2 * budget
    mask = (1 << (most + 1)) - 1
    items = [(length, n) for length, n in items if 0 < length <= most]
    step = math.gcd(*[length for length, _ in items]) if items else 1
    best = min(budget % step, step - budget % step)
    table, tables, bundles = 1, [], []
    for length, n in items:
        size = 1
        while n > 0 and abs(nearest(table, budget) - budget) > best:
            took = min(size, n)
            n, size = n - took, 2 * size
            grown = table | (table << took * length) & mask if took * length <= most else table
            if grown != table:
                tables.append(table)
                bundles.append((length, took))
                table = grown
    at = nearest(table, budget)
    chosen: dict[int, int] = {}
    for before, (length, took) in zip(reversed(tables), reversed(bundles), strict=True):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + took
            at -= took * length
    return chosen


def fitted(histogram: list[tuple[int, int]], budget: int, spare: bool = False) -> dict[int, int]:
    """How many documents of each length to take so that their words come to ``budget``; (length, n) are all there are.

    ``spare``: all documents are taken once already, so that some may be given back; their number is then negative.

    Walking up the lengths, each gives its even share, with what rounding left over from those below. The words are then off by
    no more than the longest document; the longest go, and others come in, until what is lacking is
    small. Documents of about the usual length give back a room of ROOM such, and the programme fills that from all not taken. If it
    can't be filled exactly, the shortest give back as much too.
    """
    histogram = sorted((length, n) for length, n in histogram if length > 0 and n > 0)
    total, docs = sum(length * n for length, n in histogram), sum(n for _, n in histogram)
    if budget <= 0 or not total:
        return {}
    chosen, seen, usual = {}, 0, None
    for length, n in histogram:
        chosen[length] = (seen + n) * budget // total - seen * budget // total
        seen += n
        usual = length if usual is None and 2 * seen >= docs else usual
    lacking = budget - sum(length * n for length, n in chosen.items())
    for length, _ in reversed(histogram):
        back = min(chosen[length], max(0, -(lacking // length)))
        chosen[length] -= back
        lacking += back * length
    for length, n in reversed(histogram):
        more = min(n - chosen[length], lacking // length)
        chosen[length] += more
        lacking -= more * length
    around = sorted(histogram, key=lambda x: (x[0] > usual, abs(x[0] - usual)))

    def filled(orders: list[list[tuple[int, int]]]) -> tuple[int, dict[int, int]]:
        """What is missed, and the choice, after documents were given back in these orders, a room for each, and the room was filled."""
        own, room = dict(chosen), lacking
        for k, order in enumerate(orders, 1):
            for length, n in order:
                back = min(own[length] + n * spare, max(0, -((room - k * ROOM * usual) // length)))
                own[length] -= back
                room += back * length
        for length, n in reached([(length, n - own[length]) for length, n in around], room).items():
            own[length] += n
            room -= n * length
        return abs(room), own

    missed, best = filled([around])
    if missed:  # documents of about the usual length can't make up a difference that only short ones have
        missed, best = min((missed, best), filled([around, histogram]), key=lambda x: x[0])
    return {length: n for length, n in best.items() if n}


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``place``, from 0 in the given order, without one task that holds them all."""
    parts = stored(rows.orderBy(*order).withColumn("__nl_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("__nl_at", 33)
    ends = parts.groupBy(part.alias("__nl_part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("__nl_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(ends.select("__nl_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__nl_start")))
    place = F.col("__nl_start") + F.col("__nl_at").bitwiseAND((1 << 33) - 1)
    return parts.join(starts, part == F.col("__nl_part")).select(*rows.columns, place.alias("place"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of all words by weight, ``most`` times the source at most.

    Weights are dealt in turn to the sources in the order of their code points, null last. What is above the most goes to the
    others by weight, again and again until none is above. Each round looks at sums alone.
    """
    placed = numbered(sources, [F.col("source").isNull(), "source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(placed.withColumn("weight", weight), "weighted-sources")
    sums = [F.sum(F.col("source_size").cast("decimal(38,0)")).alias("s"), F.sum("weight").alias("w")]
    whole = rows.agg(*sums).first()
    total, weighing = int(whole.s or 0), int(whole.w or 0)
    words = total
    while True:
        share = F.col("weight").cast("decimal(10,0)") * F.lit(words).cast("decimal(20,0)")
        above = share > F.col("source_size").cast("decimal(20,0)") * F.lit(most * weighing).cast("decimal(18,0)")
        held = rows.filter(above).agg(*sums).first()
        now = (total - most * int(held.s or 0), int(whole.w or 0) - int(held.w or 0))
        if now == (words, weighing) or now[1] <= 0:
            break
        words, weighing = now
    even = share.cast("double") / F.lit(float(max(1, weighing)))
    return rows.select("source", "source_size", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(even).alias("target"))


def source_key(column: str) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken, the words of it that the mix takes.

    A null text has no words, a null source is a source of its own, the last one; null ids are ids. Each row counts for itself,
    also where it repeats another; of rows alike in id and text any may be the one that is taken once more. A source
    without words gets nothing. The taken words of a source are its target rounded to a whole number, or as near to it as
    its documents come. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    dice = F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        dice.alias("dice"),
    )
    rows = stored(rows, "sizes")
    lengths = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(with_targets(sources, weights, most), "targets")

    def fit(key, table):
        import pyarrow as pa

        size, target = table["source_size"][0].as_py(), table["target"][0].as_py()
        whole, budget = divmod(min(int(target + 0.5), most * size), size) if size else (0, 0)
        lengths = list(zip(table["size"].to_pylist(), table["n"].to_pylist(), strict=True))
        chosen = fitted(lengths, budget, whole > 0)
        more = [chosen.get(a, 0) for a, _ in lengths]
        # what gives back some is taken whole once less, and then but for those
        table = table.append_column("whole", pa.array([whole - (m < 0) for m in more], pa.int64()))
        return table.append_column("more", pa.array([m + n * (m < 0) for m, (_, n) in zip(more, lengths, strict=True)], pa.int64()))

    known = targets.select(source_key("source").alias("key"), "source_size", "target")
    counted = lengths.select(source_key("source").alias("key"), "size", "n").join(known, "key")
    kinds = "key string, size long, n long, source_size long, target double, whole long, more long"
    plan = stored(counted.groupBy("key").applyInArrow(fit, kinds), "plan")

    # documents of a length meet in cells by hash; each cell gives its even share of what the length gives
    cells = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("key", source_key("source")).withColumn("cell", F.pmod("dice", F.lit(cells)))
    cell_sizes = rows.groupBy("key", "size", "cell").agg(F.count("*").alias("held"))
    so_far = F.sum("held").over(Window.partitionBy("key", "size").orderBy("cell"))
    shared = cell_sizes.withColumn("so_far", so_far).join(plan, ["key", "size"])
    quota = F.expr("cast(more as decimal(19,0)) * so_far div n - cast(more as decimal(19,0)) * (so_far - held) div n")
    quotas = shared.select("key", "size", "cell", "source_size", "target", "whole", quota.alias("quota"))
    place = F.row_number().over(Window.partitionBy("key", "size", "cell").orderBy("dice", "doc_id"))
    picked = rows.withColumn("place", place).join(quotas, ["key", "size", "cell"])
    taken = F.col("size") * (F.col("whole") + (F.col("place") <= F.col("quota")).cast("long"))
    return picked.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix takes whose sources weigh 1, 2, 3 in turn and repeat three times at most."""
    return mix(documents(spark, sf_dir))
