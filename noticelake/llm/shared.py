"""What several operators need: the shared folder, checkpoints, files and table reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.session import checkpoint_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a temporary folder takes its place on a local master; on a
    cluster that is an error.
    """
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and cut from its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def new_file(folder: str, name: str) -> Iterator:
    """A stream to a new file from a task; the file appears under its name only when complete."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, f"{path}/{name}")


def write_file(folder: str, name: str, data: bytes) -> None:
    """Writes one whole file from a task."""
    with new_file(folder, name) as out:
        out.write(data)


@contextmanager
def opened(folder: str, name: str) -> Iterator:
    """A file that a task wrote, to be read by ranges."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as source:
        yield source


def read_file(folder: str, name: str) -> bytes:
    """One whole file that a task wrote."""
    with opened(folder, name) as source:
        return source.read()


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of a whole number written as decimal text."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


#: A key with this share of the rows, one in so many, is spread over tasks when it is joined.
HOT_SHARE = 100


def salted_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined on ``key`` with ``one``, which has each key once; ``counts`` has the rows of each key as ``n``.

    A key that holds a HOT_SHARE-th of all counted rows or more is split by a hash of the row, and its row of
    ``one`` is repeated for each part. There are at most HOT_SHARE such keys, so they are written into the plan.
    Null keys meet nothing.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    part = max(1, int(total) // HOT_SHARE)
    hot = counts.filter(F.col("n") >= max(2, part)).select(F.col(key).alias("key"), F.ceil(F.col("n") / part).cast("int").alias("parts")).collect()
    if not hot:
        return many.join(one, key, how)
    known = F.create_map(*[F.lit(x) for r in hot for x in (r.key, r.parts)])
    parts = F.coalesce(F.try_element_at(known, F.col(key)), F.lit(1))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), parts.cast("long")).cast("int")
    left = many.withColumn("__nl_salt", salt)
    right = one.withColumn("__nl_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "__nl_salt"], how).drop("__nl_salt")
