"""How far the sources of a language lie apart, by hash-consed segment trees over term ids.

Terms are counted once for each group (a language and a source). The terms of a language are cut into blocks of bounded
size. In a block every group has a segment tree over the ids of the block's terms; a node is known by its two children
alone, a leaf by its count, so identical runs of counts are one node, in whichever groups and places they occur. Two trees are
walked together from their roots, and each pair of nodes that the walk meets is priced once, however often it recurs. The
prices of the blocks are summed.

Sources of a language are cut into blocks as well, so a task holds two blocks of sources and one block of terms, and no
group, language or term is held whole by anyone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.shared import documents, stored

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
#: Terms of a block, and sources of a block, on average; ids are dealt to blocks by hash.
TERM_BLOCK, SOURCE_BLOCK = 4096, 64
#: Distinct terms that a task counts before it passes the counts on.
HELD_TERMS = 200_000
#: Bytes of a text that are split into terms at once.
PIECE_BYTES = 1 << 20
#: Bytes that no term holds become spaces, A to Z become a to z.
SPLIT = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if c < 0x5B else c for c in range(256))


def pieces(line: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a line in runs of bounded length; a word is never cut."""
    at = 0
    while at < len(line):
        end = line.find(b" ", at + size) if at + size < len(line) else -1
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def group_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with the term) of each group; nulls count as empty."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held: dict = {}

        def flush() -> Iterator:
            for (lang, source), (n, df) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 20_000):
                    own = terms[i : i + 20_000]
                    columns = [[lang] * len(own), [source] * len(own), [t.decode() for t in own], [n[t] for t in own], [df[t] for t in own]]
                    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set = set()
                for words in pieces(text.encode().translate(SPLIT)):
                    n.update(words)
                    seen.update(words)
                df.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (lang_col, source_col, text_col)])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same in numpy: a long division by thousands, so that nothing overflows below totals of 9e15."""
    rest, out = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


class Forest:
    """The segment trees of several groups over the same ids, with equal subtrees kept once.

    ``counts`` has a row for each group; -1 stands for an id that is not used.
    """

    def __init__(self, counts: np.ndarray):
        groups, n = counts.shape
        width = 1 << max(0, n - 1).bit_length()
        leaves = np.full((groups, width), -1, np.int64)
        leaves[:, :n] = counts
        self.counts, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(groups, width)
        #: for each level from the leaves up: the children of each of its distinct nodes
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.sizes = [len(self.counts)]
        while nodes.shape[1] > 1:
            pairs, inverse = np.unique(nodes[:, 0::2] * self.sizes[-1] + nodes[:, 1::2], return_inverse=True)
            self.left.append(pairs // self.sizes[-1])
            self.right.append(pairs % self.sizes[-1])
            self.sizes.append(len(pairs))
            nodes = inverse.reshape(groups, -1)
        self.roots = nodes[:, 0]

    def prices(self, one: int, others: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The divergence of group ``one`` from each of some others over these ids, and of each of them from it.

        All walks go down together. What is alike is met once at each level: a pair of nodes, for one pair of groups.
        """
        pair = np.arange(len(others))
        a, b = np.full(len(others), self.roots[one]), self.roots[others]
        met = []
        for left, right, n in zip(reversed(self.left), reversed(self.right), reversed(self.sizes[:-1]), strict=True):
            key = (np.concatenate([pair, pair]) * n + np.concatenate([left[a], right[a]])) * n + np.concatenate([left[b], right[b]])
            distinct, inverse = np.unique(key, return_inverse=True)
            met.append(inverse)
            b, key = distinct % n, distinct // n
            a, pair = key % n, key // n
        a, b = self.counts[a], self.counts[b]
        there = a >= 0
        p, q = shares(np.maximum(a, 0), np.full(len(a), totals[one])), shares(np.maximum(b, 0), totals[others][pair])
        gap = (p - q) ** 2
        forth, back = np.where(there, gap // q, 0), np.where(there, gap // p, 0)
        for inverse in reversed(met):
            half = len(inverse) // 2
            forth, back = (v[inverse[:half]] + v[inverse[half:]] for v in (forth, back))
        return forth, back


def pair_values(kept: DataFrame, known: DataFrame, groups: DataFrame, langs: DataFrame, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, item and value of each two sources of a language.

    ``kept`` has lang, source, term, n and total (of the language); ``known`` has lang and term; ``groups`` has lang, source and size (the divisor of its
    shares); ``langs`` has lang, terms and sources, their numbers.
    """
    blocks = langs.select(
        "lang",
        F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("long").alias("tbs"),
        F.ceil(F.col("sources") / source_block).cast("long").alias("sbs"),
    )

    def dealt(rows: DataFrame, term_blocks: Column) -> DataFrame:
        """Each row in all pairs of source blocks that its own is part of."""
        own = F.pmod(F.xxhash64("source"), F.col("sbs"))
        rows = rows.join(blocks, "lang").withColumn("tb", term_blocks).withColumn("sb", own)
        others = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("sbs") - 1), lambda o: F.struct(F.least("sb", o).alias("i"), F.greatest("sb", o).alias("j"))
        )
        rows = rows.withColumn("at", F.explode(others))
        return rows.select("lang", "tb", "at.i", "at.j", "sb", "source", "term", "n", "total")

    block_of = F.pmod(F.xxhash64("term"), F.col("tbs"))
    counts = dealt(kept, block_of)
    held = known.join(blocks, "lang").groupBy("lang", block_of.alias("tb")).agg(F.count("*").alias("held"))
    named = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("size").alias("n"), F.lit(0).cast("long").alias("total"))
    # every group is met in every block of terms, with the number of its terms, as it may have none of them
    every = dealt(named, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tbs") - 1)))
    every = every.join(held, ["lang", "tb"], "left").withColumn("total", F.coalesce("held", F.lit(0))).drop("held").select(*counts.columns)

    def price(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        lang, _, i, j = (k.as_py() for k in key)
        head = table.filter(pc.is_null(table["term"]))
        body = table.filter(pc.is_valid(table["term"]))
        sources, totals, side = head["source"].to_pylist(), head["n"].to_numpy(), head["sb"].to_numpy()
        terms = body["term"].combine_chunks().dictionary_encode() if len(body) else None
        words = terms.dictionary if terms is not None else []
        weight = np.zeros(len(words), np.int64)
        n_terms = head["total"][0].as_py() if len(head) else 0
        counts = np.zeros((len(sources), n_terms), np.int64)  # terms that none of these sources has stay zero
        if len(words):
            column = terms.indices.to_numpy()
            row = pc.index_in(body["source"], value_set=pa.array(sources)).to_numpy()
            weight[column] = body["total"].to_numpy()
            # frequent terms first: rare ones then lie side by side, and their subtrees are alike
            place = np.empty(len(words), np.int64)
            place[np.lexsort((np.array(words.to_pylist(), object), -weight))] = np.arange(len(words))
            counts[row, place[column]] = body["n"].to_numpy()
        out: list = []
        forest = Forest(counts) if n_terms else None
        first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
        for x in first.tolist():
            rest = second[second > x] if i == j else second
            if len(rest):
                zero = np.zeros(len(rest), np.int64)
                forth, back = forest.prices(x, rest, totals) if forest else (zero, zero)
                for y, f, b in zip(rest.tolist(), forth.tolist(), back.tolist(), strict=True):
                    out += [(sources[x], sources[y], f), (sources[y], sources[x], b)]
        a, b, v = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(v, pa.int64())})

    priced = counts.unionByName(every).groupBy("lang", "tb", "i", "j").applyInArrow(price, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    term_block: int = TERM_BLOCK,
    source_block: int = SOURCE_BLOCK,
) -> DataFrame:
    """How each source of a language differs from the others (part ``pair``) and in which terms from the language (``term``).

    Columns: lang, source, part, item, value, rank. Null texts, languages and sources count as empty ones. Each row is a
    document, also where it repeats another. A group without any kept term is compared like others; a language without kept
    terms gives pairs of value 0 and no terms; a source that is alone in its language gives no pairs. Ties go by the item's
    bytes. An empty table gives no rows. Other columns are not read.
    """
    counts = stored(group_counts(docs, text_col, lang_col, source_col), "term-counts")
    known = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    known = stored(known, "known-terms")
    kept = stored(counts.drop("docs").join(known, ["lang", "term"]), "kept-terms")
    found = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = found.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = stored(sizes, "group-sizes")
    terms = known.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = sizes.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("all"))
    langs = stored(langs.join(terms, "lang", "left").select("lang", "sources", "all", F.coalesce("terms", F.lit(0)).alias("terms")), "languages")
    groups = sizes.join(langs, "lang").select("lang", "source", (F.col("n") + F.col("terms")).alias("size"), (F.col("all") + F.col("terms")).alias("whole"))
    groups = stored(groups, "groups")

    pairs = pair_values(kept, known, groups, langs, term_block, source_block)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    p, q = share(F.col("n"), F.col("size")), share(F.col("total"), F.col("whole"))
    own = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    own = own.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    top = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language from each other, and their 200 most distinctive terms."""
    return divergence(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT g.lang, g.source, coalesce(max(v.v), 0) + coalesce(sum(c.n), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
whole AS (SELECT lang, sum(n) + count(*) AS size FROM l GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, kept.term, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // g.size AS BIGINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM (
    SELECT c.lang, c.source, c.term, CAST(1 + 1000000000::HUGEINT * (c.n + 1) // g.size AS BIGINT) AS p,
      CAST(1 + 1000000000::HUGEINT * (l.n + 1) // whole.size AS BIGINT) AS q
    FROM c JOIN g USING (lang, source) JOIN l USING (lang, term) JOIN whole USING (lang))
  WHERE p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pair UNION ALL FROM term)
QUALIFY part = 'pair' OR rank <= 200
"""
