"""Exact deduplication in two passes over a Bloom filter, with DataFrame functions only.

Pass one hashes every text, counts how often each Bloom cell is hit and keeps the cells hit twice
or more as packed bitmaps. Pass two looks each row up: a row with a cell that was hit once has a
text of its own and passes straight through. Only the rest, possibly repeated, are shuffled and
grouped by the digest of their text.

A filter has a fixed largest size, so what is broadcast is bounded. More texts than it can tell apart are first laid out by
ranges of their digests' hashes, without a shuffle, and each range has a filter of its own. A fuller filter lets more rows
through to the exact grouping, never fewer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.shared import documents, salted_join, shared_dir, stored, text_or_empty

#: Bits of one bitmap row, as bitmap_construct_agg makes them.
BITMAP_BITS = 32768
#: The filter has at most this many bitmaps: 64 MB to broadcast.
MAX_BITMAPS = 16384
CELLS_PER_TEXT = 16
SEEDS, RANGE_SEED = (1, 2), 3
DIGEST, MAYBE = "__nl_digest", "__nl_maybe"


def cell(key: Column, seed: int, bits: int) -> Column:
    """The Bloom cell of a digest for one hash function."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))


def cell_bitmaps(keys: DataFrame, bits: int, key: str = DIGEST, least: int = 2) -> DataFrame:
    """Bitmaps of the cells that the keys hit ``least`` times or more: bucket, bitmap."""
    hits = keys.select(F.explode(F.array(*[cell(F.col(key), s, bits) for s in SEEDS])).alias("cell"))
    often = hits.groupBy("cell").count().filter(F.col("count") >= least)
    return often.groupBy((F.col("cell") / BITMAP_BITS).cast("long").alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("cell", F.lit(BITMAP_BITS))).alias("bitmap")
    )


def is_set(bitmap: Column, position: Column) -> Column:
    """Whether the bit at a position of a bitmap is 1; false where there is no bitmap."""
    byte = F.conv(F.hex(F.substr(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (position % 8).cast("int")) == 1, F.lit(False))


def with_maybe(rows: DataFrame, bitmaps: DataFrame, bits: int, key: str = DIGEST) -> DataFrame:
    """``rows`` with the flag MAYBE: false only where the key is surely none of those of the bitmaps."""
    out, flag = rows, F.lit(True)
    for s in SEEDS:
        at, bucket, bitmap = f"__nl_cell{s}", f"__nl_bucket{s}", f"__nl_bitmap{s}"
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
        out = out.withColumn(at, cell(F.col(key), s, bits)).join(
            side, (F.col(at) / BITMAP_BITS).cast("long") == F.col(bucket), "left"
        )
        flag = flag & is_set(F.col(bitmap), F.pmod(at, F.lit(BITMAP_BITS)))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], flag.alias(MAYBE))


def filter_bits(rows: int) -> int:
    """Bits of the filter for so many rows: a multiple of BITMAP_BITS, bounded above."""
    wanted = max(1, -(-rows * CELLS_PER_TEXT // BITMAP_BITS))
    return min(MAX_BITMAPS, wanted) * BITMAP_BITS


def ranges_needed(rows: int) -> int:
    """How many filters so many rows need."""
    return max(1, -(-rows * CELLS_PER_TEXT // (BITMAP_BITS * MAX_BITMAPS)))


def laid_out(rows: DataFrame, ranges: int, name: str) -> list[DataFrame]:
    """``rows`` by range of the hash of their DIGEST: each task writes what it has to a folder of each range."""
    if ranges == 1:
        return [rows]
    spark, at = rows.sparkSession, F.pmod(F.xxhash64(DIGEST, F.lit(RANGE_SEED)), F.lit(ranges)).cast("int")
    path = shared_dir(spark, name)
    rows.withColumn("__nl_range", at).write.partitionBy("__nl_range").parquet(path)
    read = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__nl_range", T.IntegerType())])).parquet(path)
    return [read.filter(F.col("__nl_range") == k).drop("__nl_range") for k in range(ranges)]


def digests_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ids and text digests, written once so that both passes read them and not the texts."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias(DIGEST))
    return stored(slim, "digests")


def filters_of(slim: DataFrame, total: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """The digests by range, the bitmaps of each range, and the bits of a filter."""
    ranges = ranges_needed(total)
    bits, parts = filter_bits(-(-total // ranges)), laid_out(slim, ranges, "digest-ranges")
    return parts, [stored(cell_bitmaps(p, bits), "bitmaps") for p in parts], bits


def all_flagged(parts: list[DataFrame], bitmaps: list[DataFrame], bits: int) -> DataFrame:
    """The rows of all ranges with MAYBE."""
    return reduce(lambda a, b: a.unionByName(b), [with_maybe(p, b, bits) for p, b in zip(parts, bitmaps, strict=True)])


def groups_of(again: DataFrame) -> DataFrame:
    """Of each digest among the possibly repeated rows: the id that stays and how many rows share it."""
    return again.groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal if identical; null counts as empty. The row with the largest id of each group
    stays. A null id is smaller than all others. Rows that repeat an id with the same text count
    each in group_size and share one decision. An empty table gives no rows. Extra columns are not
    read.
    """
    slim = digests_of(docs, id_col, text_col)
    flagged = all_flagged(*filters_of(slim, slim.count()))
    single = flagged.filter(~F.col(MAYBE)).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), DIGEST
    )
    again = flagged.filter(MAYBE).select("doc_id", DIGEST)
    groups = stored(groups_of(again), "groups")
    sizes = groups.select(DIGEST, F.col("group_size").alias("n"))
    grouped = salted_join(again, groups, DIGEST, sizes).select("doc_id", "keep_id", "group_size", DIGEST)
    return single.unionByName(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col(DIGEST).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that with the largest id; all columns stay.

    Rows whose text the filter shows to be unique pass through unshuffled. Of rows that repeat both
    the largest id and the text, one stays. Columns may have any names but those beginning __nl_.
    """
    slim = digests_of(docs, id_col, text_col)
    parts, bitmaps, bits = filters_of(slim, slim.count())
    whole = laid_out(docs.withColumn(DIGEST, F.sha2(text_or_empty(text_col), 256)), len(parts), "text-ranges")
    flagged = all_flagged(whole, bitmaps, bits)
    again = all_flagged(parts, bitmaps, bits).filter(MAYBE)
    keep = groups_of(again).select(F.col(DIGEST).alias("__nl_keep"), F.col("keep_id").alias("__nl_keep_id"))
    stays = (F.col(DIGEST) == F.col("__nl_keep")) & F.col(id_col).cast("long").eqNullSafe(F.col("__nl_keep_id"))
    repeated = flagged.filter(MAYBE).join(keep, stays, "left_semi").dropDuplicates([DIGEST])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return flagged.filter(~F.col(MAYBE)).select(*columns).unionByName(repeated.select(*columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents with equal texts the one that stays, their number, and the text's digest."""
    return exact_groups(documents(spark, sf_dir))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
