"""Token ids in bit-packed files: each id takes the fewest bits that hold the vocabulary.

A file holds the documents of one shard. Its layout, all numbers little-endian:

    magic        8 bytes, NLTOKEN2
    data         blocks of ids packed bit by bit, lowest bit first, each padded to a byte
    doc_ids      i64 x n_docs; the first n_null of them stand for null
    doc_ends     u64 x n_docs, ids of the shard up to the document's end
    offsets      u64 x (blocks + 1), bytes from the start of the data
    tail         bits of an id u32, ids in each block but the last u32, n_ids u64, n_docs u64, n_null u64,
                 magic 8 bytes

So a block goes to the file as soon as it is full. Blocks are found by their offsets and unpacked with
numpy, and any range of ids is read without the rest of the file. Documents are range-partitioned
by id, so the shards in order of their partition, and of their number within it, hold all ids in
ascending order.
"""

from __future__ import annotations

import io
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.shared import documents, new_file, opened, shared_dir, stored, text_or_empty
from noticelake.llm.tokens import byte_level_encoder

MAGIC = b"NLTOKEN2"
BLOCK_IDS = 65_536
#: A task starts a new file after this many ids.
FILE_IDS = 8_000_000
#: Ids that a batch of read documents has, about.
BATCH_IDS = 500_000
TAIL = struct.Struct("<IIQQQ8s")


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits, lowest bit first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        fields = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = fields
        out = np.packbits(wide, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class FileWriter:
    """Writes a file to a stream, block by block as ids come; only the tables pile up. Documents without an id come first."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.names, self.ends, self.offsets = array("q"), array("Q"), array("Q", [0])
        self.rest, self.n_ids, self.n_null = bytearray(), 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Appends a document's ids, little-endian u32."""
        self.n_ids += len(ids) // 4
        self.n_null += doc_id is None
        self.names.append(doc_id or 0)
        self.ends.append(self.n_ids)
        self.rest += ids
        size = 4 * self.block_ids
        whole = len(self.rest) // size * size
        for at in range(0, whole, size):
            self._block(bytes(self.rest[at : at + size]))
        del self.rest[:whole]

    def _block(self, ids: bytes) -> None:
        block = pack(np.frombuffer(ids, "<u4"), self.bits)
        self.out.write(block)
        self.offsets.append(self.offsets[-1] + len(block))

    def end(self) -> None:
        if self.rest:
            self._block(bytes(self.rest))
        for table, kind in ((self.names, "<i8"), (self.ends, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(table, kind).tobytes())
        self.out.write(TAIL.pack(self.bits, self.block_ids, self.n_ids, len(self.names), self.n_null, MAGIC))


def to_file(docs: list[tuple[int | None, bytes]], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The file of (doc_id, little-endian u32 ids) pairs."""
    out = io.BytesIO()
    made = FileWriter(out, bits, block_ids)
    for doc_id, ids in docs:
        made.add(doc_id, ids)
    made.end()
    return out.getvalue()


class TokenFile:
    """Random access to the ids of one file of ``size`` bytes, given a way to read a range of it: its start and length."""

    def __init__(self, read, size: int):
        if size < len(MAGIC) + TAIL.size:
            raise ValueError("not a token file")
        self.read = read
        self.bits, self.block_ids, self.n_ids, n_docs, self.n_null, magic = TAIL.unpack(read(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        blocks = -(-self.n_ids // self.block_ids)
        length = 16 * n_docs + 8 * (blocks + 1)
        tables = read(size - TAIL.size - length, length)
        self.doc_ids = np.frombuffer(tables, "<i8", n_docs)
        self.doc_ends = np.frombuffer(tables, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(tables, "<u8", blocks + 1, 16 * n_docs).astype(np.int64)

    @classmethod
    def of(cls, content: bytes) -> TokenFile:
        return cls(lambda start, size: content[start : start + size], len(content))

    @classmethod
    def on(cls, source) -> TokenFile:
        """The file behind a stream that can seek."""

        def read(start: int, size: int) -> bytes:
            source.seek(start)
            return source.read(size)

        return cls(read, source.size())

    def block(self, k: int) -> np.ndarray:
        start, end = int(self.offsets[k]), int(self.offsets[k + 1])
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.read(len(MAGIC) + start, end - start), self.bits, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, its start in the shard and its ids, holding a block or so at a time."""
        start, held, held_from, k = 0, np.zeros(0, "<u4"), 0, 0
        for number, (name, end) in enumerate(zip(self.doc_ids.tolist(), self.doc_ends.tolist(), strict=True)):
            parts = [held[start - held_from :]]
            while held_from + len(held) < end:
                held_from, held, k = k * self.block_ids, self.block(k), k + 1
                parts.append(held)
            ids = np.concatenate(parts)[: end - start]
            yield (None if number < self.n_null else name), start, ids
            start = end


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the ids of all documents under ``folder`` and returns the list of files.

    A row: name, part and number (their order), n_docs, n_ids. Each document ends with ``end_id``; a null
    text counts as empty. A null id comes first. Rows with equal ids stand side by side, in an order that
    their texts set; many of them may take several parts. An empty table gives no files. Other columns are
    not read. A task that is run again writes files of other names; only those in the list count.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = byte_level_encoder(tokenizer)
        bits = bits_for(encoder.vocab_size)
        end = end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()

        def rows() -> Iterator:
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    some = batch.slice(a, 500)
                    yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)

        files, left = [], rows()
        for row in left:
            name = f"{uuid.uuid4().hex}.ids"
            with new_file(folder, name) as out:
                made = FileWriter(out, bits, block_ids)
                while row is not None:
                    made.add(row[0], encoder.encode(row[1]) + end)
                    row = next(left, None) if made.n_ids < file_ids else None
                made.end()
            files.append((name, part, len(files), len(made.names), made.n_ids))
        names, types = ["name", "part", "number", "n_docs", "n_ids"], [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate(types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # rows of one id may go over several parts
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    written = ordered.mapInArrow(run, "name string, part long, number long, n_docs long, n_ids long")
    return stored(written, "token-file-list")


def with_starts(files: DataFrame) -> DataFrame:
    """``files`` with file_start, the number of ids in all files before each.

    Parts are summed first, so the window without a key sees one row for each part, of which there are as
    many as shuffle partitions.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start")
    )
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    numbered = files.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return numbered.join(parts, "part").select("name", (F.col("part_start") + F.col("in_part")).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document from the listed files: doc_id, start, n_tokens, ids (little-endian u32).

    ``start`` counts the ids of all documents before it, over all files. Each file is read by ranges, a
    block or so at a time.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with opened(folder, name) as source:
                    for doc_id, start, ids in TokenFile.on(source).documents():
                        rows.append((doc_id, first + start, len(ids), ids.tobytes()))
                        size += len(ids)
                        if size >= BATCH_IDS:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # a task for each file, or a few: the list is small, what it names is not
    listed = with_starts(files).repartition(max(1, min(files.count(), 10_000)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = shared_dir(spark, "token-files")
    files = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_token_files(spark, folder, files)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
