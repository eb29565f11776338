"""BPE encoding with word ends, and decoding, for texts of any length.

White space ends every word of this kind of vocabulary, so the chunks between spaces encode on their
own and repeated ones come from a cache. Text with no place to split is encoded as a tree: its halves
are encoded apart, then a window around each join is encoded again, and grows until its first and last
tokens are those that the two sides had there. Where the tokens agree, every adjacent pair is one that
the merges leave alone, so the joined sequence is exactly the encoding of the whole.

Documents with an unsplit run beyond ``UNSPLIT`` characters have that run cut into leaves, which are
encoded as rows of their own over the cluster and then joined per document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from noticelake.llm.shared import documents, text_or_empty
from noticelake.llm.tokens import CACHE_BYTES, PLAIN, Cache, byte_alphabet, to_byte_chars

#: An unsplit run of more characters than this is encoded by several tasks.
UNSPLIT = 4096
#: Characters of a leaf of the tree.
LEAF = 256
WINDOW_TOKENS = 4
# Fixed value: the word pattern of the vocabulary's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = " \t\n\x0b\x0c\r"
LONG_RUN = re.compile(f"[^{SPACES}]{{{UNSPLIT + 1},}}")
FROM_BYTE_CHARS = str.maketrans({c: chr(b) for b, c in byte_alphabet().items()})


class WordEndEncoder:
    """Ids and token strings of a BPE whose last symbol of each word carries an end mark."""

    def __init__(self, path: str, room: int = CACHE_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.whole = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"])
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.end = model["end_of_word_suffix"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.token = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        if spec["decoder"] is not None:
            raise ValueError("the decoder is not that of plain tokens")
        self.words = Cache(self.word, room)
        self.chunks = Cache(self._chunk, room)

    def leaf(self, text: str, final: bool) -> list[int]:
        """Ids of byte characters; only the last leaf of a word has the end mark."""
        return [t.id for t in (self.whole if final else self.inner).tokenize(text)]

    def size(self, token_id: int) -> int:
        return len(self.token[token_id].removesuffix(self.end))

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The ids of both sides' text, from the ids of each."""
        k = WINDOW_TOKENS
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            window = "".join(self.token[i] for i in a + b)
            at_end = final and whole_right
            ids = self.leaf(window.removesuffix(self.end) if at_end else window, at_end)
            if (whole_left or ids[0] == a[0]) and (whole_right or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            k *= 2

    def join_all(self, parts: list[list[int]], final: bool) -> list[int]:
        """Joins neighbours pair by pair until one part is left."""
        while len(parts) > 1:
            last = len(parts) - 1
            parts = [
                self.join(parts[i], parts[i + 1], final and i + 1 == last) if i < last else parts[i]
                for i in range(0, len(parts), 2)
            ]
        return parts[0] if parts else []

    def word(self, word: str) -> list[int]:
        """Ids of one word, as a tree if it is long."""
        text = to_byte_chars(word)
        cuts = leaves(text)
        return self.join_all([self.leaf(c, i == len(cuts) - 1) for i, c in enumerate(cuts)], True)

    def split_words(self, text: str) -> list[str]:
        """The words that the library's normalizer and pre-tokenizer make of a text."""
        if (text.isascii() and text.isprintable()) or PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [w.translate(FROM_BYTE_CHARS).encode("latin-1").decode("utf-8") for w, _ in words]

    def ids(self, text: str) -> list[int]:
        if any(a in text for a in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [i for w in self.split_words(text) for i in self.words[w]]

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """How many ids a chunk has, the ids in decimal and its tokens, each joined by spaces."""
        return self.digest_parts(self.ids(chunk))

    def digest_parts(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def encoded(self, text: str) -> tuple[int, str, str]:
        """The same for a whole text."""
        if any(a in text for a in self.added):
            return self.digest_parts(self.ids(text))
        parts = [p for p in map(self.chunks.__getitem__, text.split(" ")) if p[0]]
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


def leaves(text: str) -> list[str]:
    return [text[i : i + LEAF] for i in range(0, len(text), LEAF)]


_ENCODERS: dict[str, WordEndEncoder] = {}


def word_end_encoder(path: str) -> WordEndEncoder:
    """The encoder of this Python worker for one vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEndEncoder(path)
    return _ENCODERS[path]


def is_long(text_col: str):
    """Whether a text has an unsplit run that is encoded over several tasks."""
    return (F.length(text_col) > UNSPLIT) & F.col(text_col).rlike(f"[^ \\t\\n\\x0B\\f\\r]{{{UNSPLIT + 1}}}")


DIGESTS = "n_tokens long, ids string, decoded string"


def encode_short(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes rows of doc_id, text where they are."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encoder = word_end_encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(0, len(ids), 200):
                out = [encoder.encoded(t) for t in batch.column(1).slice(i, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 200),
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.string()),
                        pa.array([o[2] for o in out], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id long, {DIGESTS}")


def pieces_of(encoder: WordEndEncoder, text: str) -> Iterator[tuple[int, bool, list[str]]]:
    """A long text in parts that encode apart: (word, final, strings).

    ``word`` is -1 for whole stretches of text and otherwise numbers a long word, whose leaves follow
    one another in byte characters; ``final`` marks its last leaf.
    """
    if any(a in text for a in encoder.added):
        yield -1, True, [text]
        return
    at, number = 0, 0
    for run in LONG_RUN.finditer(text):
        yield -1, True, [text[at : run.start()]]
        at, short = run.end(), []
        for word in encoder.split_words(run.group()):
            chars = to_byte_chars(word)
            if len(chars) <= UNSPLIT:
                short.append(word)
                continue
            yield -2, True, short
            short = []
            for i in range(0, len(chars), UNSPLIT):
                yield number, i + UNSPLIT >= len(chars), [chars[i : i + UNSPLIT]]
            number += 1
        yield -2, True, short
    yield -1, True, [text[at:]]


def encode_piece(encoder: WordEndEncoder, word: int, final: bool, strings: list[str]) -> list[int]:
    if word == -1:
        return encoder.ids(strings[0])
    if word == -2:
        return [i for w in strings for i in encoder.words[w]]
    cuts = leaves(strings[0])
    return encoder.join_all([encoder.leaf(c, final and i == len(cuts) - 1) for i, c in enumerate(cuts)], final)


def encode_long(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes rows of doc_id, text whose long runs are cut, encoded over the cluster and joined."""

    def split(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encoder = word_end_encoder(tokenizer)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
        names = ["row", "doc_id", "pos", "word", "final", "strings"]
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for row, doc_id, text in zip(*columns, strict=True):
                parts = [(row, doc_id, pos, *p) for pos, p in enumerate(pieces_of(encoder, text))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[i] for p in parts], t) for i, t in enumerate(types)], names
                )

    def encode(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encoder = word_end_encoder(tokenizer)
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3, 6))
            ids = [encode_piece(encoder, *part) for part in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(ids, pa.list_(pa.int32()))],
                ["row", "doc_id", "pos", "word", "final", "ids"],
            )

    def join(key, table):
        import pyarrow as pa

        encoder = word_end_encoder(tokenizer)
        table = table.sort_by("pos")
        ids: list[int] = []
        parts: list[list[int]] = []
        columns = (table[c].to_pylist() for c in ("word", "final", "ids"))
        for word, final, piece in zip(*columns, strict=True):
            if word < 0:
                ids += piece
                continue
            parts.append(piece)
            if final:
                ids += encoder.join_all(parts, True)
                parts = []
        n, decimal, decoded = encoder.digest_parts(ids)
        return pa.table(
            {
                "doc_id": pa.array([table["doc_id"][0].as_py()], pa.int64()),
                "n_tokens": pa.array([n], pa.int64()),
                "ids": [decimal],
                "decoded": [decoded],
            }
        )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    fields = "row long, doc_id long, pos long, word long, final boolean"
    cut = numbered.mapInArrow(split, f"{fields}, strings array<string>").repartition("row", "pos")
    encoded = cut.mapInArrow(encode, f"{fields}, ids array<int>")
    return encoded.groupBy("row").applyInArrow(join, f"doc_id long, {DIGESTS}")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (decimal, joined by one space), decoded.

    ``decoded`` is what the library's decode gives with special tokens kept. A null text counts as
    empty and has no ids; repeated rows give a row each; an empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    short = encode_short(rows.filter(~is_long("text")), tokenizer)
    return short.unionByName(encode_long(rows.filter(is_long("text")), tokenizer))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and the decoded text of each document, as digests."""
    import public_tokenizers

    rows = encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
