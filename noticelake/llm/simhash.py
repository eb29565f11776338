"""SimHash near-duplicates, linked exactly through vantage-point trees.

Each text becomes a 64-bit fingerprint, and equal fingerprints are one point from then on. A
vantage-point tree over a bounded sample cuts the points into shards by Hamming distance. A point is
stored in one shard and asked for in every later shard that the triangle bounds cannot rule out, so
each pair within the radius meets in exactly one shard. There a local tree finds the links, and only
enough of them leave the shard to keep its points connected. Stars over those edges then give the
components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.shared import checkpoint, documents, salted_join, stored, text_or_empty

RADIUS = 3
SEED = 42
#: Points that a shard should hold.
SHARD_POINTS = 8192
#: Points, at most, that the upper tree is built from; it is fitted on them and routes all points.
SAMPLE_POINTS = 65_536
LEAF_POINTS = 128
#: Shingles of a text that are looked at together.
BLOCK_SHINGLES = 16_384


def words_of(text: str) -> list[bytes]:
    """The words of a text with A to Z lower-cased, as UTF-8; white space is space and 9 to 13."""
    return text.encode("utf-8").lower().split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Runs of ``n`` words joined by spaces, repeats included; the whole sequence if it is shorter."""
    if not words:
        return []
    line, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[n:]] + [len(line)]
    return [line[a:b] for a, b in zip(starts, ends, strict=False)]


def digest_blocks(text: str, n: int) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle of a text as big-endian unsigned numbers, up to BLOCK_SHINGLES at a time."""
    words, digest = words_of(text), xxhash.xxh64_digest
    for a in range(0, max(1, len(words) - n + 1), BLOCK_SHINGLES):
        parts = shingles(words[a : a + BLOCK_SHINGLES + n - 1], n)
        if parts:
            yield np.frombuffer(b"".join([digest(p, SEED) for p in parts]), ">u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The number whose bits are those that over half of some digests have; zero if there are none."""
    ones, total = np.zeros(64, np.int64), 0
    for block in blocks:
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprint(text: str, n: int) -> int:
    """The SimHash of a text as an unsigned number; zero for a text without words."""
    return majority(digest_blocks(text, n))


def with_fingerprints(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col))
    return rows.mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A binary tree: points no farther than ``cut`` from the vantage point go left, others right."""

    def __init__(self, points: np.ndarray, leaf: int, rows: np.ndarray | None = None, depth: int = 0):
        self.rows = np.arange(len(points)) if rows is None else rows
        self.left = self.right = None
        own = points[self.rows]
        if len(own) <= leaf or depth > 60:
            return
        best = None
        for v in own[:: max(1, len(own) // 5)][:5]:
            d = distances(own, v)
            cut = int(np.median(d))
            if not (d > cut).any():
                cut = int(d.max()) - 1
            near = d <= cut
            if 0 < near.sum() < len(own):
                # what a query has to visit twice is what lies near the cut
                blur = np.mean(np.abs(d - cut) <= RADIUS) + abs(near.mean() - 0.5)
                if best is None or blur < best[0]:
                    best = (blur, v, cut, near)
        if best is None:
            return
        _, self.vantage, self.cut, near = best
        self.left = VantageTree(points, leaf, self.rows[near], depth + 1)
        self.right = VantageTree(points, leaf, self.rows[~near], depth + 1)

    def number(self, first: int = 0) -> int:
        """Numbers the leaves from left to right; returns the next free number."""
        if self.left is None:
            self.first, self.last = first, first
            return first + 1
        middle = self.left.number(first)
        end = self.right.number(middle)
        self.first, self.last = first, end - 1
        return end

    def visit_home(self, queries: np.ndarray, rows: np.ndarray, found: list) -> None:
        """Appends (leaf, rows of the points that are stored in it)."""
        if not len(rows):
            return
        if self.left is None:
            found.append((self, rows))
            return
        near = distances(queries[rows], self.vantage) <= self.cut
        self.left.visit_home(queries, rows[near], found)
        self.right.visit_home(queries, rows[~near], found)

    def visit(self, queries: np.ndarray, rows: np.ndarray, radius: int, found: list) -> None:
        """Appends (leaf, rows of the queries that have to see it)."""
        if not len(rows):
            return
        if self.left is None:
            found.append((self, rows))
            return
        d = distances(queries[rows], self.vantage).astype(np.int16)
        self.left.visit(queries, rows[d <= self.cut + radius], radius, found)
        self.right.visit(queries, rows[d > self.cut - radius], radius, found)


def smallest_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connects the two sides of a block of links: the smallest label that reaches each."""
    most = np.iinfo(np.int64).max
    while True:
        a = np.minimum(left, np.where(linked, right[None, :], most).min(axis=1))
        b = np.minimum(right, np.where(linked, a[:, None], most).min(axis=0))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def spanning_links(points: np.ndarray, n_own: int, radius: int) -> np.ndarray:
    """Pairs of indices that connect what is linked. The first ``n_own`` points are the shard's own.

    Own points are linked with each other and with the others; the others not among themselves.
    """
    own = points[:n_own]
    tree = VantageTree(own, LEAF_POINTS)
    found: list = []
    tree.visit(points, np.arange(len(points)), radius, found)
    out = []
    for leaf, rows in found:
        for at in range(0, len(rows), 8192):
            asked = rows[at : at + 8192]
            linked = distances(points[asked][:, None], own[leaf.rows][None, :]) <= radius
            linked &= asked[:, None] != leaf.rows[None, :]
            hit, met = linked.any(axis=1), linked.any(axis=0)
            if not hit.any():
                continue
            q, p = asked[hit], leaf.rows[met]
            a, b = smallest_labels(linked[hit][:, met], q.astype(np.int64), p.astype(np.int64))
            out.append(np.stack([np.concatenate([q, p]), np.concatenate([a, b])], axis=1))
    if not out:
        return np.zeros((0, 2), np.int64)
    pairs = np.unique(np.concatenate(out), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    root = list(range(len(points)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    tops = np.array([top(i) for i in range(len(points))])
    moved = np.flatnonzero(tops != np.arange(len(points)))
    return np.stack([moved, tops[moved]], axis=1)


def links(points: DataFrame, radius: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges a, b (a > b) that connect the distinct fingerprints ``fp`` within ``radius`` bits."""
    n = points.count()
    wanted = min(SAMPLE_POINTS, max(1024, 16 * (n // shard_points)))
    sample = points.orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(wanted).collect()
    chosen = np.array([r.fp for r in sample], np.int64).view(np.uint64)
    tree = VantageTree(chosen, max(1, int(len(chosen) * shard_points / max(n, 1))))
    tree.number()

    def route(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            every = np.arange(len(own))
            at_home: list = []
            home = np.zeros(len(own), np.int64)
            tree.visit_home(own, every, at_home)
            for leaf, rows in at_home:
                home[rows] = leaf.first
            asked: list = []
            tree.visit(own, every, radius, asked)
            parts = [(home, own, np.ones(len(own), bool))]
            for leaf, rows in asked:
                rows = rows[home[rows] < leaf.first]
                parts.append((np.full(len(rows), leaf.first), own[rows], np.zeros(len(rows), bool)))
            shard, fp, stored_here = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(fp.view(np.int64)), pa.array(stored_here)], ["shard", "fp", "own"]
            )

    def search(key, table):
        import pyarrow as pa

        fp = table["fp"].to_numpy().view(np.uint64)
        own = table["own"].to_numpy()
        order = np.argsort(~own, kind="stable")
        fp, n_own = fp[order], int(own.sum())
        pairs = spanning_links(fp, n_own, radius) if n_own else np.zeros((0, 2), np.int64)
        a, b = fp.view(np.int64)[pairs[:, 0]], fp.view(np.int64)[pairs[:, 1]]
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    routed = points.select("fp").mapInArrow(route, "shard long, fp long, own boolean")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected to, for every node of an edge (a > b).

    Large and small stars in turn, written down after each round, until no edge changes.
    """
    edges = checkpoint(edges.select("a", "b"))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_components(
    docs: DataFrame, words: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint's bits as a long) and component_id.

    component_id is the smallest id reached over links of ``radius`` or fewer differing bits. A null
    text counts as empty; texts without words have fingerprint zero and link like others. Null ids
    take part in linking but name a component only if it has no other id. Repeated rows share a
    component. An empty table gives no rows; other columns are not read.
    """
    rows = stored(with_fingerprints(docs, words, id_col, text_col), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    roots = checkpoint(components(links(points, radius)))
    named = points.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    linked = named.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(linked, "root").select("fp", "component_id")
    return salted_join(rows, by_fp, "fp", points.select("fp", "n")).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of each document over three words, in hexadecimal, and its component at three bits or fewer."""
    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
