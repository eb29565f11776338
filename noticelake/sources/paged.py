"""Landed pages of a paged API as a Spark data source: a partition for each page, as far as the pages go.

The pages of an answer lie in ``<path>/page=<n>/`` as files of JSON envelopes, one in each line. The first page says how many items there are;
from that and the size of a page follows which pages there are to be read, so no file is opened that isn't part of the answer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from noticelake.sources.landed import api_items

NAME = "landed_pages"


def page_lines(path: str, page: int) -> Iterator[str]:
    """The envelopes of one page; none if it has not landed."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
    for info in sorted(found, key=lambda f: f.path):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            with store.open_input_stream(info.path) as source:
                yield from source.read().decode("utf-8").splitlines()


def body_of(line: str) -> dict:
    return json.loads(line).get("response", {}).get("body", {}) or {}


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("pagesize", 100))
        self.most = int(options["maxpages"]) if "maxpages" in options else None

    def partitions(self) -> list[Page]:
        """From the first page's total; a page too many is never read."""
        first = next(page_lines(self.path, 1), None)
        total = int(body_of(first).get("totalCount") or 0) if first else 0
        pages = max(1, math.ceil(total / self.size))
        return [Page(k) for k in range(1, (pages if self.most is None else min(pages, self.most)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for line in page_lines(self.path, partition.number):
            items = body_of(line).get("item")
            count = len(items) if isinstance(items, list) else int(bool(items))
            yield partition.number, count, line


class LandedPages(DataSource):
    """Options: path, pageSize (100), maxPages (all)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page int, items int, value string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def paged_items(spark: SparkSession, path: str, item: str, page_size: int = 100, max_pages: int | None = None) -> DataFrame:
    """The items of a paged answer, typed by ``item``, a DDL struct: page after page until the total is reached, a page is empty
    or has not landed, or ``max_pages`` is.
    """
    spark.dataSource.register(LandedPages)
    reader = spark.read.format(NAME).option("path", path).option("pageSize", page_size)
    pages = (reader if max_pages is None else reader.option("maxPages", max_pages)).load()
    # what lies behind the first gap or empty page does not belong to the answer: pages before it are all there are up to their number
    full = pages.filter("items > 0").groupBy("page").agg(F.count("*").alias("n"))
    ends = full.select("page").agg(F.collect_set("page").alias("p"))  # one number for each page
    last = ends.select(F.aggregate(F.array_sort("p"), F.lit(0), lambda acc, x: F.when(x == acc + 1, x).otherwise(acc)).alias("last"))
    kept = pages.join(F.broadcast(last), F.col("page") <= F.col("last"))
    return api_items(kept.select("value"), item)
