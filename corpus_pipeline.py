"""A corpus pipeline: language identification, exact and near deduplication, packing.

Each stage reads what the one before it kept and writes Parquet; all but the last return rows of
documents with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.exact_dedup import drop_exact
from noticelake.llm.language import UNKNOWN, fit_languages, predict
from noticelake.llm.near import drop_near
from noticelake.llm.packing import pack_documents
from noticelake.llm.shared import documents, stored

#: A text belongs to none of the languages known if its likeliest is less likely than so many times an even chance, at
#: most MOST_NEEDED.
LEAST_GAIN, MOST_NEEDED = 1.2, 0.5
#: Near duplicates share so much of their shingles of so many words.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no language that the labelled rows show.

    Learns from the labelled documents of its own input; with no labels no document is rejected for
    its language. A null text has no letter, so it goes, as do empty ones; null ids and labels are no reason to go. Rows that repeat
    a text fare alike. An empty table stays empty; all columns stay as they are.
    """
    net = fit_languages(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    needed = min(MOST_NEEDED, LEAST_GAIN / len(net.languages))
    found = predict(docs, net).filter((F.col("__nl_lang") != UNKNOWN) & (F.col("__nl_score") >= needed))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of each text.

    A null text counts as empty, a null id is smaller than all others. Of rows that repeat both the largest id and the text one
    stays. An empty table stays empty.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.

    Texts without words, null ones among them, and rows without an id say nothing of each other and all stay. Rows that repeat an id
    are one document: all of them stay, or none. An empty table stays empty.
    """
    return drop_near(docs, SHINGLE_WORDS, SIMILARITY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens, with their ids.

    A null text is a single end id; a null id stays null; repeated rows are packed each for itself; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("packing", packing)]

#: The network and the trees have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what is between them is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
