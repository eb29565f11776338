"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of a window of fixed length; each filter's largest
response goes into a softmax over the languages. A text is cut into windows from its first byte to its
last, and its probabilities are those of its windows, weighted by their bytes.

The network is fitted on the driver to a bounded sample of labelled rows. To apply it, the responses
of a filter to each pair of neighbouring bytes are tabulated, so a filter costs a lookup or two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.shared import crc32_of_id, documents

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled rows that the network is fitted to, over all languages; and windows of each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 4000, 4
BUCKETS = 1 << 30
#: Languages, the most frequent ones, that the network tells apart.
MOST_LANGUAGES = 1000
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(id_col) % 5 == 0, F.lit(False))


def windows_of(text: str) -> np.ndarray:
    """All windows of a text's bytes, the last one filled up with zeros."""
    raw = text.encode("utf-8")
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteNet:
    """The network's weights, how to fit them and how to apply them."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.kernels = [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.biases, self.dense, self.offset]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of a batch of windows and its derivative by each parameter."""
        n, length = x.shape
        vectors = self.embedding[x]
        rows = np.arange(n)[:, None]
        fields, tops, at = [], [], []
        for w, kernel, bias in zip(WIDTHS, self.kernels, self.biases, strict=True):
            field = np.concatenate([vectors[:, j : length - w + 1 + j] for j in range(w)], axis=2)
            response = field @ kernel + bias
            best = response.argmax(axis=1)
            fields.append(field)
            at.append(best)
            tops.append(np.maximum(response[rows, best, np.arange(FILTERS)], 0))
        pooled = np.concatenate(tops, axis=1)
        logits = pooled @ self.dense + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
        p[np.arange(n), y] -= 1
        p /= n
        d_dense, d_offset, d_pooled = pooled.T @ p, p.sum(axis=0), p @ self.dense.T
        d_embedding = np.zeros_like(self.embedding)
        d_kernels, d_biases = [], []
        for k, (w, field, best, top) in enumerate(zip(WIDTHS, fields, at, tops, strict=True)):
            d = d_pooled[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
            chosen = field[rows, best]  # n, filters, width * embedding
            d_kernels.append(np.einsum("nfi,nf->if", chosen, d))
            d_biases.append(d.sum(axis=0))
            d_field = (d[:, :, None] * self.kernels[k].T[None]).reshape(n, FILTERS, w, EMBEDDING)
            byte = x[rows[:, :, None], best[:, :, None] + np.arange(w)]
            np.add.at(d_embedding, byte.ravel(), d_field.reshape(-1, EMBEDDING))
        return loss, [d_embedding, *d_kernels, *d_biases, d_dense, d_offset]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 4e-3, seed: int = 1) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.parameters()]
        square = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                own = order[i : i + batch]
                _, grads = self.gradients(x[own], y[own])
                for p, g, m, s in zip(self.parameters(), grads, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * 0.5**epoch * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> None:
        """The responses to pairs of neighbouring bytes, for ``probabilities``."""
        def part(kernel: np.ndarray, j: int) -> np.ndarray:
            return self.embedding @ kernel[j * EMBEDDING : (j + 1) * EMBEDDING]

        def pair(kernel: np.ndarray, j: int) -> np.ndarray:
            return (part(kernel, j)[:, None] + part(kernel, j + 1)[None]).reshape(-1, FILTERS)

        self.looked_up = [[pair(k, j) if j + 1 < w else part(k, j) for j in range(0, w, 2)] for w, k in zip(WIDTHS, self.kernels, strict=True)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The softmax of each window."""
        pairs = x[:, :-1].astype(np.int32) << 8
        pairs |= x[:, 1:]
        tops = []
        for w, parts, bias in zip(WIDTHS, self.looked_up, self.biases, strict=True):
            end = x.shape[1] - w + 1
            response = parts[0].take(pairs[:, :end], axis=0)
            for k, table in enumerate(parts[1:], 1):
                index = pairs if len(table) > 256 else x
                response += table.take(index[:, 2 * k : 2 * k + end], axis=0)
            tops.append(np.maximum(response.max(axis=1) + bias, 0))
        logits = np.concatenate(tops, axis=1) @ self.dense + self.offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, and windows with the number of the language of each.

    At most SAMPLE_ROWS rows, or one of each language, are taken, chosen by a hash of their id, the
    same number of each language as far as there are so many; of each text SAMPLE_WINDOWS windows at
    equal distances.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES)
    share = F.lit(SAMPLE_ROWS / max(1, counts.count())) / F.col("n")
    kept = counts.select("lang", (F.least(F.lit(1.0), share) * BUCKETS).cast("long").alias("below"))

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8")
                starts = sorted({int(s) for s in np.linspace(0, max(0, len(raw) - WINDOW), SAMPLE_WINDOWS)})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(starts), pa.int64()),
                        pa.array([lang] * len(starts), pa.string()),
                        pa.array([raw[s : s + WINDOW].ljust(WINDOW, b"\0") for s in starts], pa.binary()),
                    ],
                    ["id", "lang", "window"],
                )

    chosen = rows.join(F.broadcast(kept), "lang").filter(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(BUCKETS)) < F.col("below"))
    found = (
        chosen.select(F.col("id").cast("long"), "lang", "text")
        .mapInArrow(cut, "id long, lang string, window binary")
        .orderBy("id", "lang", "window")
        .limit(2 * SAMPLE_ROWS * SAMPLE_WINDOWS)
        .collect()
    )
    languages = sorted({r.lang for r in found})
    x = np.frombuffer(b"".join(bytes(r.window) for r in found), np.uint8).reshape(-1, WINDOW)
    return languages, x, np.array([languages.index(r.lang) for r in found], np.int64)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network fitted to the labelled rows that are not held out; none if there are no such rows."""
    languages, x, y = labelled_sample(docs, id_col, text_col, lang_col)
    if not languages:
        return None
    net = ByteNet(languages)
    net.fit(x, y)
    return net


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with __nl_lang and __nl_score, all other columns as they are.

    A null text or one without a letter is ``und`` with score 0, as is every text if there is no
    network. Only the text is read for a prediction. Rows that repeat get equal predictions; an empty
    table gives no rows. Columns may have any names but those beginning __nl_.
    """
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("__nl_lang", T.StringType()), T.StructField("__nl_score", T.DoubleType())]
    )
    marked = docs.withColumn("__nl_letters", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = list(docs.columns)
    at = names.index(text_col)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        if net is not None:
            net.tables()
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                letters = batch.column(batch.num_columns - 1).to_pylist()
                own = [j for j, ok in enumerate(letters) if ok and net is not None]
                if own:
                    texts = batch.column(at)
                    for j, p in zip(own, text_probabilities(net, [texts[j].as_py() for j in own]), strict=True):
                        best = int(p.argmax())
                        langs[j], scores[j] = net.languages[best], float(min(1.0, p[best]))
                columns = batch.columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*names, "__nl_lang", "__nl_score"],
                )

    return marked.mapInArrow(run, schema)


def text_probabilities(net: ByteNet, texts: list[str]) -> list[np.ndarray]:
    """The probabilities of each text, over all its windows; long texts go through in parts."""
    cut = [windows_of(t) for t in texts]
    every = np.concatenate(cut)
    p = np.concatenate([net.probabilities(every[i : i + 256]) for i in range(0, len(every), 256)])
    out, at = [], 0
    for t, w in zip(texts, cut, strict=True):
        weight = np.full(len(w), float(WINDOW))
        weight[-1] -= w.size - len(t.encode("utf-8"))
        out.append((p[at : at + len(w)] * weight[:, None]).sum(axis=0) / weight.sum())
        at += len(w)
    return out


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learnt from labelled documents that are not held out."""
    docs = documents(spark, sf_dir)
    rows = predict(docs.select("doc_id", "text"), fit_languages(docs))
    return rows.select(
        "doc_id", held_out().alias("held_out"), F.col("__nl_lang").alias("lang_pred"), F.col("__nl_score").alias("score")
    )
