"""Best-fit decreasing packing of tokenised documents into fixed windows.

Each task packs the documents of its own partition, pool after pool, so nothing is shuffled and a
task holds one pool of pieces at most. Documents longer than a window are first cut into full
windows. The rest of each document goes, longest first, into the open window whose remaining
capacity is the smallest that still holds it; a segment tree over the capacities finds that window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.shared import documents, text_or_empty
from noticelake.llm.tokens import byte_level_encoder

WINDOW = 1024
#: Tokens that a task gathers before it packs them: 16 MB of ids.
POOL_TOKENS = 4_000_000
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


class CapacityTree:
    """Open windows by remaining capacity; ``take(n)`` gives the tightest that holds ``n``."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        node = self.size + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The capacity and id of the tightest window with room for ``need``; it is removed."""
        count, node = self.count, self.size + need
        while not count[node]:
            while node & 1 and node > 1:
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        window_id = self.open[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, window_id


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece, and how many windows there are. Lengths are 1 to window."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    tree, windows = CapacityTree(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        capacity, w = found or (window, windows)
        windows += found is None
        where[i], offset[i] = w, window - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], w)
    return where, offset, windows


def cut(total: int, window: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``total`` tokens."""
    return [(s, min(window, total - s)) for s in range(0, total, window)]


def pack_pool(pool: list[tuple[int, bytes]], window: int, first: int) -> tuple[list[tuple], int]:
    """Rows of the packed pieces of (doc_id, ids) pairs, and the next free sequence number."""
    pieces = [(d, ids, s, n) for d, ids in pool for s, n in cut(len(ids) // 4, window)]
    where, offset, used = best_fit_decreasing([p[3] for p in pieces], window)
    rows = [
        (d, s, n, ids[4 * s : 4 * (s + n)], len(ids) // 4, first + w, o)
        for (d, ids, s, n), w, o in zip(pieces, where, offset, strict=True)
    ]
    return rows, first + used


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """One row per piece: its place in its document, its ids (little-endian u32) and its window.

    A null text counts as empty and so is the single end id; a null id stays null; repeated rows
    are packed each for itself; an empty table gives no rows. Other columns of ``docs`` are not read.
    ``sequence_id`` is unique over the whole result; offsets in a sequence leave no gap.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encoder = byte_level_encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

        def batches_of(rows: list[tuple]) -> Iterator:
            for i in range(0, len(rows), 2000):
                columns = zip(*rows[i : i + 2000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                )

        pool, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                pool.append((doc_id, ids))
                held += len(ids) // 4
                if held >= pool_tokens:
                    rows, first = pack_pool(pool, window, first)
                    pool, held = [], 0
                    yield from batches_of(rows)
        rows, _ = pack_pool(pool, window, first)
        yield from batches_of(rows)

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(run, PIECE_SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    import public_tokenizers

    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
