"""Near duplicates of a corpus: candidates from SimHash and MinHash, then an exact comparison of shingle sets.

Links of fingerprints within a few bits come from the vantage-point trees. Texts of similarity 0.8 often lie further
apart than that, so documents also meet in buckets: BANDS times, those whose ROWS smallest shingle hashes
agree. Two texts of similarity 0.8 share no bucket with a probability of (1 - 0.8^4)^20, about 3 in 100,000, and less
the more similar they are.

Within a bucket no pairs are made of all with all. Its hub, the document that meets most others, is compared with each
of them; those it does not resemble go on with a hub of their own, and so on, until none is left that has not been
compared. What is left of a bucket after ROUNDS of this is full of texts that only share a part; those that are not
connected yet are compared in blocks, and only what connects them leaves a block.

A document that the hub resembles and one that it does not may still be alike. By the triangle inequality of Jaccard distances the hub
is then not far from the second either: those in that ring that are not connected with the hub by other ways are compared with
what resembles it, in blocks too. So of two similar texts that share a bucket no link is lost.

All candidates are compared by their exact sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.exact_dedup import MAYBE, cell_bitmaps, filter_bits, with_maybe
from noticelake.llm.shared import salted_join, stored, text_or_empty
from noticelake.llm.simhash import RADIUS, components, digest_blocks, links, majority

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
ROUNDS = 3
#: Documents of a block, for what is left of a bucket.
BLOCK_DOCS = 1024
#: Deviations by which the share of equal hashes may fall short of the similarity.
DEVIATIONS = 4.5
#: Odd factors of the hash functions, the odd numbers after a start spread by a bijection of 64 bits.
FACTORS = (np.arange(1, 2 * HASHES, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2C)
FACTORS |= np.uint64(1)


def signature(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """The least hash of the shingles for each hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for block in blocks:
        for a in range(0, len(block), 1024):
            np.minimum(least, (block[a : a + 1024, None].astype(np.uint64) * FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One number for each band, made of its hashes and its place."""
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def with_signatures(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (SimHash), keys (of the bands) and marks (a byte of each hash) of each row of doc_id, text."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                fps, keys, marks = [], [], []
                for text in batch.column(1).to_pylist():
                    blocks = list(digest_blocks(text, words)) if len(text) < 1_000_000 else None
                    fps.append(majority(blocks if blocks is not None else digest_blocks(text, words)))
                    least = signature(blocks if blocks is not None else digest_blocks(text, words))
                    keys.append(band_keys(least).view(np.int64))
                    marks.append((least >> np.uint64(32) & np.uint64(255)).astype(np.uint8).tobytes())
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.array(fps, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat),
                        pa.array(marks, pa.binary()),
                    ],
                    ["doc_id", "fp", "keys", "marks"],
                )

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, keys array<long>, marks binary")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """doc_id and s, the set of hashed shingles, of each row of doc_id, text."""
    split = F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")
    own = rows.select("doc_id", F.filter(split, lambda w: w != "").alias("w"))
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1)))
    return own.select(
        "doc_id", F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))).alias("s")
    )


def only_these(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose doc_id is among some distinct ones; texts that a Bloom filter shows to be others are not shuffled."""
    bits = filter_bits(ids.count())
    bitmaps = stored(cell_bitmaps(ids, bits, "doc_id", 1), "needed")
    return with_maybe(rows, bitmaps, bits, "doc_id").filter(MAYBE).select(*rows.columns).join(ids, "doc_id", "left_semi")


def ring(similarity: float) -> float:
    """How like each other two texts are at least that both resemble a third."""
    return 2 * similarity - 1


def similar(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those pairs a, b whose sets of shingles have at least this Jaccard similarity, sim. A document of many pairs should be b."""
    half = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    per_b = pairs.groupBy("b").agg(F.count("*").alias("n"))
    both = salted_join(half, sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b", per_b)
    common = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - common
    # counts are compared, not the quotient, so that the least is exact
    return both.filter(common >= least * either).select("a", "b", common.cast("long").alias("common"), either.cast("long").alias("either"))


def alike(known: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b among those known that are similar."""
    return known.filter(F.col("common") >= similarity * F.col("either")).select("a", "b")


def connecting(first: np.ndarray, second: np.ndarray, ids: np.ndarray, roots: np.ndarray, seen: np.ndarray, shingled: list, similarity: float) -> list:
    """Edges (larger, smaller id) between rows of ``first`` and of ``second`` that are similar and whose roots differ, as many as connect
    them. Signatures and sizes rule out what can't be similar before any sets are compared.
    """
    enough = int(np.floor(HASHES * (similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / HASHES))))
    sizes = np.array([len(x) for x in shingled])
    group, found = roots.copy(), []  # whatever is connected has one number
    same = len(first) == len(second) and bool((first == second).all())
    for x in first.tolist():
        rest = second[group[second] != group[x]]
        if same:
            rest = rest[ids[rest] < ids[x]]
        rest = rest[np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x])]
        rest = rest[(seen[rest] == seen[x]).sum(axis=1) >= enough]
        for y in rest.tolist():
            if group[x] != group[y]:
                common = len(np.intersect1d(shingled[x], shingled[y], assume_unique=True))
                if common >= similarity * (sizes[x] + sizes[y] - common):
                    group[group == group[y]] = group[x]
                    found.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return found


def columns_of(table) -> tuple:
    """ids, roots, signatures and sorted shingles of a table of documents."""
    ids, roots = (table[c].to_numpy() for c in ("doc_id", "root"))
    seen = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(-1, HASHES)
    return ids, roots, seen, [np.sort(x.values.to_numpy()) for x in table["s"].combine_chunks()]


def as_edges(found: list):
    import pyarrow as pa

    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def left_over(members: DataFrame, marks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges a, b (a > b) between the members p, doc_id, root of each bucket that differ in their root and are similar.

    Blocks of documents are compared with each other, first by their signatures and then, if those allow the similarity, by
    their sets; of what is connected within a block only as many edges leave it as connect it.
    """
    sizes = members.groupBy("p").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("blocks"))
    dealt = members.join(marks, "doc_id").join(sizes, "p").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")),
    )
    spread = dealt.join(sets, "doc_id").select("p", "block", "doc_id", "root", "marks", "s", F.explode(others).alias("at"))
    spread = spread.select("p", "at.i", "at.j", "block", "doc_id", "root", "marks", "s")

    def compare(key, table):
        _, i, j = (k.as_py() for k in key)
        block = table["block"].to_numpy()
        return as_edges(connecting(np.flatnonzero(block == i), np.flatnonzero(block == j), *columns_of(table), similarity))

    return spread.groupBy("p", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def across(spokes: list[DataFrame], known: DataFrame, roots: DataFrame, marks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Edges a, b (a > b) between what a bucket's hub resembles and what it does not, where these are not connected; None if all are.

    ``spokes`` has the members p, doc_id, hub of each round, ``known`` the similarities of pairs down to the ring, ``roots``
    what documents are connected with so far.
    """
    every = reduce(lambda a, b: a.unionByName(b), [m.select(F.xxhash64("p", F.lit(k)).alias("p"), "doc_id", "hub") for k, m in enumerate(spokes)])
    near = every.join(known.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), (F.col("common") / F.col("either")).alias("sim")), ["doc_id", "hub"])
    near = stored(near, "ring")
    beside = near.filter(F.col("sim") < similarity).join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    hubs = beside.groupBy("hub").agg(F.count("*").alias("n"))
    hub_roots = hubs.join(roots, F.col("hub") == F.col("doc_id"), "left").select("hub", F.coalesce("root", "hub").alias("hub_root"))
    apart = stored(salted_join(beside, hub_roots, "hub", hubs).filter("root <> hub_root").select("p", "doc_id", "root", "sim"), "apart")
    if apart.isEmpty():
        return None
    # what is as like the hub as this is too far from all of those apart; a little is left for rounding
    buckets = apart.groupBy("p").agg(F.max("sim").alias("closest"), F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("blocks"))
    within = near.filter(F.col("sim") >= similarity).join(buckets, "p").filter(F.col("sim") <= F.col("closest") + (1 - similarity) + 1e-9)
    within = within.join(roots, "doc_id").select("p", "doc_id", "root", "blocks")
    others = within.groupBy("p").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("others"))

    def placed(rows: DataFrame, own: str, count: str, other: str, across_: str, side: int) -> DataFrame:
        own_block = F.pmod(F.xxhash64("doc_id"), F.col(count)).alias(own)
        all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col(across_) - 1)).alias(other)
        full = rows.join(marks, "doc_id").join(sets, "doc_id")
        return full.select("p", own_block, F.lit(side).alias("side"), "doc_id", "root", "marks", "s", all_blocks)

    left = placed(apart.select("p", "doc_id", "root").join(buckets, "p").join(others, "p"), "i", "blocks", "j", "others", 0)
    right = placed(within.join(others, "p"), "j", "others", "i", "blocks", 1)

    def compare(table):
        side = table["side"].to_numpy()
        return as_edges(connecting(np.flatnonzero(side == 0), np.flatnonzero(side == 1), *columns_of(table), similarity))

    return left.unionByName(right.select(*left.columns)).groupBy("p", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and group_id, the smallest id of the near duplicates that a document is connected with.

    A null text counts as empty; texts without words, and rows without an id, are left out, as they say nothing of each
    other. Rows that repeat an id are one document, with the largest of their texts. An empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    if not ids.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"))
    prints = stored(with_signatures(rows, words), "signatures")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    ends = [points.select(F.col("fp").alias(c), F.col("least").alias(f"doc_{c}")) for c in ("a", "b")]
    close = links(points, radius).join(ends[0], "a").join(ends[1], "b").select(
        F.greatest("doc_a", "doc_b").alias("a"), F.least("doc_a", "doc_b").alias("b")
    )
    # buckets: the bands, and the fingerprint itself
    held = prints.select("doc_id", F.explode(F.array_union("keys", F.array(F.xxhash64("fp")))).alias("p"))
    sizes = stored(held.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    together = stored(salted_join(held, sizes, "p", sizes), "members")
    weights = together.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    rest = together.select("doc_id", "p").join(weights, "doc_id")
    members = with_hubs(rest, 1)
    close = stored(close, "close")
    needed = stored(weights.select("doc_id").union(close.select(F.explode(F.array("a", "b")))).distinct(), "needed-ids")
    sets = stored(shingle_sets(only_these(rows, needed), words), "shingles")
    tried, spokes = stored(as_pairs(members).union(close).distinct(), "candidates-1"), [members]
    known = stored(similar(sets, tried, ring(similarity)), "similar-1")
    marks = prints.select("doc_id", "marks")
    more: list[DataFrame] = []
    for k in range(2, ROUNDS + 1):
        members = with_hubs(unlike_hubs(members, alike(known, similarity)), k)
        if members.isEmpty():
            break
        spokes.append(members)
        pairs = stored(as_pairs(members).join(tried, ["a", "b"], "left_anti"), f"candidates-{k}")
        if not pairs.isEmpty():
            known = stored(known.union(similar(sets, pairs, ring(similarity))), f"similar-{k}")
            tried = tried.union(pairs)
    else:
        roots = connected(alike(known, similarity))
        left = unlike_hubs(members, alike(known, similarity)).join(roots, "doc_id", "left").select("doc_id", "p", F.coalesce("root", "doc_id").alias("root"))
        more.append(stored(left_over(stored(left, "left"), marks, sets, similarity), "similar-left"))
    edges = reduce(lambda a, b: a.union(b), more, alike(known, similarity))
    roots = connected(edges)
    missed = across(spokes, known, roots, marks, sets, similarity)
    if missed is not None:
        roots = connected(edges.union(stored(missed, "similar-across")))
    return prints.select("doc_id").join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def connected(edges: DataFrame) -> DataFrame:
    """doc_id and root of the documents that edges a, b connect."""
    return components(ordered(edges)).withColumnRenamed("node", "doc_id")


def with_hubs(members: DataFrame, k: int) -> DataFrame:
    """The members doc_id, p, weight of each bucket of two or more with its hub, but for the hub itself.

    The hub is the document with the most others in its buckets: of texts that were all made from one that is likely the one.
    """
    hub = F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub")
    members = stored(members.select("doc_id", "p", "weight"), f"members-{k}")
    hubs = stored(members.groupBy("p").agg(hub, F.count("*").alias("n")).filter("n > 1"), f"hubs-{k}")
    return stored(salted_join(members, hubs.select("p", "hub"), "p", hubs.select("p", "n")).filter("doc_id <> hub"), f"spokes-{k}")


def as_pairs(members: DataFrame) -> DataFrame:
    return members.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()


def unlike_hubs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members that their bucket's hub does not resemble; what does is linked already."""
    return members.join(edges.select(F.col("a").alias("doc_id"), F.col("b").alias("hub")), ["doc_id", "hub"], "left_anti")


def ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest id; all columns stay.

    Texts without words, and rows without an id, say nothing of each other, so they all stay. Rows that
    repeat an id are one document: all of them stay, or none.
    """
    gone = (
        near_groups(docs, words, similarity, RADIUS, id_col, text_col)
        .filter("doc_id <> group_id")
        .select(F.col("doc_id").alias("__nl_gone"))
        .distinct()
    )
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__nl_gone"), "left_anti")
