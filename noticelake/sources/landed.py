"""Readers of landed source files; fetching them is not this library's work."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "struct<response: struct<header: struct<resultCode: string, resultMsg: string>, body: struct<totalCount: string, item: {item}>>>"


def api_items(raw: DataFrame, item: str, column: str = "value") -> DataFrame:
    """The items of JSON envelopes, typed by ``item``, a DDL struct.

    A single object counts as a list of one; an answer without data gives no rows; any other result code
    raises an error when the rows are read.
    """
    many = F.from_json(column, ENVELOPE.format(item=f"array<{item}>"))
    one = F.from_json(column, ENVELOPE.format(item=item))
    code = F.get_json_object(column, "$.response.header.resultCode")
    is_list = F.get_json_object(column, "$.response.body.item").startswith("[")
    items = F.when(is_list, many["response"]["body"]["item"]).otherwise(F.array_compact(F.array(one["response"]["body"]["item"])))
    message = F.concat(F.lit("the source answered "), F.coalesce(code, F.lit("nothing")))
    checked = F.when(code == "00", items).when(code.isin("03", "NODATA"), F.slice(items, 1, 0)).otherwise(F.raise_error(message).cast(f"array<{item}>"))
    return raw.select(F.inline(checked))


def delimited(spark: SparkSession, paths: list[str], columns: list[str], encoding: str = "cp949", sep: str = "|") -> DataFrame:
    """Rows of delimited text with exactly as many fields as columns; others are dropped. Adds the file's name.

    Spark's own readers know few encodings, so lines are read byte by byte and decoded in Arrow batches.
    """
    def decode(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lines = [x.encode("latin-1").decode(encoding, "replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), batch.column(1)], ["line", "file"])

    raw = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(paths, schema="line string")
    named = raw.filter("line IS NOT NULL").select("line", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"))
    fields = F.split("line", f"\\Q{sep}\\E", -1)
    rows = named.mapInArrow(decode, "line string, file string").select(fields.alias("f"), "file")
    return rows.filter(F.size("f") == len(columns)).select(*[F.col("f")[i].alias(c) for i, c in enumerate(columns)], "file")


def not_loaded(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of files that the load log does not name."""
    return rows.join(log.select("file").distinct(), "file", "left_anti")


def last_record_wins(rows: DataFrame, keys: list[str], order: list[Column], gone: Column) -> DataFrame:
    """The last record of each key by load order; keys whose last record deletes them are absent."""
    from noticelake.operators.relational import distinct_on

    return distinct_on(rows, keys, order).filter(~F.coalesce(gone, F.lit(False)))


GLYPH = '<text\\s+l="([-0-9.]+)"\\s+t="([-0-9.]+)"\\s+w="([-0-9.]+)"\\s+h="([-0-9.]+)"[^>]*>([^<]*)</text>'


def unescape(text: Column) -> Column:
    """The five named references of XML."""
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(ch))
    return text


def glyphs(pages: DataFrame) -> DataFrame:
    """doc_id, page, page_w, page_h, l, t, w, h, ch of XML pages doc_id, page, xml."""
    tags = F.regexp_extract_all("xml", F.lit(GLYPH), F.lit(0))
    head = [F.regexp_extract("xml", f'<page[^>]*\\b{k}="([-0-9.]+)"', 1).try_cast("double").alias(f"page_{k}") for k in ("w", "h")]
    one = pages.select("doc_id", "page", *head, F.posexplode(tags).alias("pos", "tag"))
    parts = [F.regexp_extract("tag", GLYPH, i + 1).cast("double").alias(k) for i, k in enumerate("ltwh")]
    return one.select("doc_id", "page", "page_w", "page_h", "pos", *parts, unescape(F.regexp_extract("tag", GLYPH, 5)).alias("ch"))


def list_items(pages: DataFrame, row: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """Rows of HTML list pages: each match of ``row``, and in it the first group of each field's pattern."""
    rows = pages.withColumn("__row", F.explode(F.regexp_extract_all(html, F.lit(row), F.lit(0))))
    return rows.select(
        *[c for c in pages.columns if c != html],
        *[F.nullif(F.trim(F.regexp_extract("__row", p, 1)), F.lit("")).alias(n) for n, p in fields.items()],
    )


def labelled_lines(html: Column, mark: str = "■") -> Column:
    """A map of the label and value of each marked line of an HTML body; the first of a label counts."""
    lines = F.split(F.regexp_replace(html, "(?i)<br\\s*/?>|</(?:p|div|li|tr)>", "\n"), "\n")
    plain = F.transform(lines, lambda x: F.trim(unescape(F.regexp_replace(x, "<[^>]*>", ""))))
    own = F.filter(plain, lambda x: x.startswith(mark) & x.contains(":"))
    pairs = F.transform(own, lambda x: F.struct(F.trim(F.regexp_extract(x, f"{mark}\\s*([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, ":(.*)$", 1)).alias("v")))
    first = F.aggregate(
        pairs, F.slice(pairs, 1, 0),
        lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.map_from_entries(first)


def sitemap_urls(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Distinct URLs of sitemaps with the first position of each: url, pos."""
    locs = pages.select("page", F.posexplode(F.regexp_extract_all(xml, F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))).alias("pos", "url"))
    return locs.groupBy("url").agg(F.min(F.struct("page", "pos")).alias("pos"))


def sitemap_tree(files: DataFrame, root: str, skip: Column | None = None) -> DataFrame:
    """url and pos of the addresses that a sitemap names, in its order and each once.

    ``files`` has the address and xml of landed sitemaps. If the root is an index, the sitemaps that it names are read, one level
    down; those that have not landed are left out. What ``skip`` says of ``url`` is left out too.
    """
    listed = files.select("address", F.col("xml").contains("<sitemapindex").alias("is_index"), F.posexplode(F.regexp_extract_all("xml", F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))).alias("at", "url"))
    top = listed.filter(F.col("address") == root)
    none = F.lit(-1)
    direct = top.filter("NOT is_index").select("url", F.struct(F.col("at").alias("file"), none.alias("line")).alias("pos"))
    named = top.filter("is_index").groupBy(F.col("url").alias("address")).agg(F.min("at").alias("file"))
    below = listed.filter("NOT is_index").join(named, "address").select("url", F.struct("file", F.col("at").alias("line")).alias("pos"))
    found = direct.unionByName(below)
    kept = found if skip is None else found.filter(~F.coalesce(skip, F.lit(False)))
    return kept.groupBy("url").agg(F.min("pos").alias("pos"))


def manual_rows(files: DataFrame) -> DataFrame:
    """Rows of hand-made tables seq, columns array<string>, rows array<array<string>> as maps, in order."""
    cells = files.select("seq", "columns", F.posexplode("rows").alias("row_no", "cells"))
    return cells.select("seq", (F.col("row_no") + 1).alias("row_no"), F.map_from_arrays("columns", "cells").alias("cells"))
