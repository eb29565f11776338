"""Spelling variants of a corpus' words by blocked Gram matrices of letter counts.

Words that differ in one letter differ little in how often they hold each letter: the squared distance of their letter counts is 2 if a letter is
replaced and 1 if one is inserted or deleted. So words are laid in blocks by their length and by how many of their letters belong to
each of a few classes. Words of one edit lie in the same block, in one where a letter has changed its class, or in one of the
next length with a letter more; no other blocks meet. For two blocks that meet, a product of their count matrices gives all squared
distances at once; pairs that are near enough are verified letter by letter.

A block is met by all of its neighbours in one place, in tiles of bounded size, so no task holds a large block whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.shared import checkpoint, documents, stored

LEAST_LETTERS, LEAST_COUNT, FORM_RATIO, SLIP_EVERY = 6, 5, 5, 199
#: Distinct runs that a task counts before it passes the counts on, and bytes of a text that are split at once.
HELD_WORDS, PIECE_BYTES = 300_000, 1 << 20
#: Words of a tile: a product of two tiles is a matrix of 4 MB.
TILE = 1024
#: Tiles of a neighbouring block that a task takes.
GUEST_TILES = 16
#: Letters whose numbers name a block, each class with its letters; all others are in the last class.
CLASSES = ("eaq", "instvz", "orcubk")
#: Latin-1 bytes that no run holds become spaces, A to Z become a to z.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 32 for c in range(256))


def text_runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of a text in Latin-1, in lists of bounded length."""
    line, at = text.encode("latin-1", "replace").translate(LETTERS), 0  # other letters become a question mark, so a space
    while at < len(line):
        end = line.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(line) else -1
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def slipped(run: bytes, start: int, every: int) -> bytes:
    """The run, or if its checksum after ``start`` is a multiple of ``every``, the run without one letter."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, slip_every: int = SLIP_EVERY, least_letters: int = LEAST_LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n, its occurrences in all texts, of words with enough letters."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held: Counter = Counter()

        def flush() -> Iterator:
            words = list(held)
            for i in range(0, len(words), 20_000):
                own = words[i : i + 20_000]
                columns = [pa.array([w.decode("latin-1") for w in own], pa.string()), pa.array([held[w] for w in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n"])
            held.clear()

        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for words in text_runs(text):
                    for w, n in Counter(words).items():
                        if len(w) >= least_letters:
                            w = slipped(w, start, slip_every)
                            if len(w) >= least_letters:
                                held[w] += n
            if len(held) > HELD_WORDS:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word, over the 26 letters and the 64 code points from U+00C0 on.

    The numbers are exact: in double precision where a word is so long that squares pass what single precision holds.
    """
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    column = np.where(codes >= 0xC0, codes - 0xC0 + 26, codes - 0x61)
    row = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(row * 90 + column, minlength=90 * len(words)).reshape(-1, 90)
    return counts.astype(np.float64 if lengths.max(initial=0) > 1000 else np.float32)


def near_pairs(one: np.ndarray, other: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two count matrices at a squared distance of at most ``most``, by one product of the two."""
    a, b = ((m**2).sum(axis=1, keepdims=True) for m in (one, other))
    # with the squares as columns of their own, the product is minus the squared distance
    minus = np.hstack([2 * one, -a, -np.ones_like(a)]) @ np.hstack([other, np.ones_like(b), b]).T
    return np.nonzero(minus >= -most)


def code_table(words: list[str]) -> np.ndarray:
    """The letters of words that are equally long, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ in exactly one place; rows are equally long."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b``, longer by one letter, are those of ``a`` with a letter inserted."""
    head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int32).sum(axis=1) if a.shape[1] else 0
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int32).sum(axis=1) if a.shape[1] else 0
    return head + tail >= a.shape[1]


def edit_pairs(one: list[str], other: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words that differ by one edit; all of ``one`` are equally long, so are all of ``other``, as long or a letter longer.

    ``same``: the lists are one, and each pair is met once.
    """
    counts = letter_counts(one)
    i, j = near_pairs(counts, counts if same else letter_counts(other))
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    a, b = code_table(one), code_table(other)
    verify = replaced if a.shape[1] == b.shape[1] else inserted
    step = max(1, 8_000_000 // max(1, b.shape[1]))
    good = np.concatenate([verify(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)])
    return i[good], j[good]


def block_of(word) -> list:
    """The numbers that name a word's block, as columns: its length and its letters of each class."""
    return [F.length(word), *[F.length(word) - F.length(F.translate(word, c, "")) for c in CLASSES]]


def neighbours() -> list[tuple[int, ...]]:
    """Steps from a word's block to the blocks where it is looked for: one of each two blocks where a letter changed
    its class, and those with a letter more. The first is the block itself.
    """
    classes = len(CLASSES) + 1
    unit = [tuple(int(c == k) for k in range(classes)) for c in range(classes)]
    changed = [tuple(x - y for x, y in zip(unit[a], unit[b], strict=True)) for a in range(classes) for b in range(a)]
    steps = [tuple([0] * classes), *changed, *unit]
    return [(sum(s), *s[:-1]) for s in steps]


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near and best (a struct of minus the largest n of a near word, and that word) for each word with a near one.

    ``words`` has the distinct words as word, with n. Only letters as runs have them are allowed.
    """
    names = ["length", *[f"c{k}" for k in range(len(CLASSES))]]
    home = words.select("word", "n", *[c.cast("int").alias(x) for c, x in zip(block_of(F.col("word")), names, strict=True)])
    sizes = stored(home.groupBy(*names).agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles")), "blocks")
    home = home.join(sizes, names).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
    steps = [F.struct(F.lit(k).alias("step"), *[(F.col(x) + d).alias(x) for x, d in zip(names, s, strict=True)]) for k, s in enumerate(neighbours())]
    to = F.explode(F.array(*steps)).alias("to")
    # guests come in rounds of GUEST_TILES tiles of their block; a tile at home takes part in as many rounds as its largest neighbour needs
    rounds = F.floor((F.col("tiles") - 1) / GUEST_TILES).alias("last")
    needed = sizes.select(rounds, to).select("last", "to.*").groupBy(*names).agg(F.max("last").alias("last"))
    hosts = stored(sizes.join(needed, names), "hosts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    own = home.drop("tiles").join(hosts.select(*names, "last"), names).withColumn("round", every)
    own = own.select(*names, F.col("tile").alias("at"), "round", F.lit(-1).alias("step"), "word", "n")
    sent = home.select("word", "n", "tile", to).select("word", "n", "tile", "to.*")
    met = sent.join(hosts.select(*names, "tiles"), names).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.filter((F.col("step") > 0) | (F.col("tile") < F.col("at")))  # of a block's own tiles each two meet once
    met = met.select(*names, "at", F.floor(F.col("tile") / GUEST_TILES).alias("round"), "step", "word", "n")

    def compare(key, table):
        import pyarrow as pa

        step, words, n = table["step"].to_numpy(), table["word"].to_pylist(), table["n"].to_numpy()
        home, found = np.flatnonzero(step == -1), []
        for s in np.unique(step).tolist() if len(home) else ():
            guests = np.flatnonzero(step == s)
            if s == -1 and key[-1].as_py() > 0:
                continue  # a tile meets itself in the first round
            for at in range(0, len(guests), tile):
                part = guests[at : at + tile]
                for back in range(0, len(home), tile):
                    own = home[back : back + tile]
                    if s == -1 and back > at:
                        continue
                    short, long = (part, own) if len(words[part[0]]) < len(words[own[0]]) else (own, part)
                    i, j = edit_pairs([words[k] for k in short], [words[k] for k in long], s == -1 and at == back)
                    found.append((short[i], long[j]))
        a = np.concatenate([np.concatenate([x, y]) for x, y in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([np.concatenate([y, x]) for x, y in found]) if found else np.zeros(0, np.int64)
        # of a word's near words the most frequent, then the smallest, comes first
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
        order = np.lexsort((rank[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1)) if len(a) else a
        count = np.diff(np.append(first, len(a)))
        columns = [
            pa.array([words[k] for k in a[first]], pa.string()), pa.array(count, pa.int64()),
            pa.array(n[b[first]], pa.int64()), pa.array([words[k] for k in b[first]], pa.string()),
        ]
        return pa.Table.from_arrays(columns, ["word", "n_near", "near_n", "near"])

    together = own.unionByName(met).groupBy(*names, "at", "round")
    parts = together.applyInArrow(compare, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of the way from form to form, for the words (word, form) that have a form.

    Each round doubles the steps that a word looks ahead; a form is several times as frequent as its word, so ways are short.
    """
    ahead = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = ahead.join(further, "root", "left")
        now = checkpoint(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = now.select("word", "root")
        if now.filter("moved").isEmpty():
            return ahead


def variants(
    docs: DataFrame,
    slip_every: int = SLIP_EVERY,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: word, form, root, n, n_near and form_n.

    A null text has no words; a null id counts as an empty one in what decides about slips. Each row counts, also where it repeats
    another. Of near words as frequent as each other the smallest in code points is the form. An empty table gives no rows. Other columns
    are not read.
    """
    found = word_counts(docs, slip_every, least_letters, id_col, text_col).filter(F.col("n") >= least_count)
    words = stored(found, "words")
    near = stored(near_words(words), "near-words")
    form = F.when(-F.col("best.minus_n") >= F.col("n") * ratio, F.col("best.near"))
    all_words = words.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.minus_n")).alias("near_n"))
    rows = stored(all_words, "forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n")
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near words of each word, the form it is likely a variant of, and the root that its forms lead to."""
    return variants(documents(spark, sf_dir))
