from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from noticelake.llm.language import fit_languages, predict
from noticelake.llm.shared import stored
from tests.llm.data import awkward, empty

SF = "/root/testdata/sf0.001"


def test_every_stage_keeps_the_columns_and_takes_awkward_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in cp.STAGES[:-1]:
            out = stored(stage(spark, docs, SF), name)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert cp.packing(spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(
        docs.filter("doc_id = 0").withColumn("doc_id", F.lit(90_000).cast("long")).withColumn("text", F.lit("1234 !!")))
    kept = cp.exact(spark, twice, SF)
    texts = kept.select("text").collect()
    assert len(texts) == len(set(texts)) == twice.select("text").distinct().count()
    assert cp.language(spark, twice, SF).filter("doc_id = 90000").count() == 0
    assert cp.language(spark, docs, SF).count() >= 0.99 * docs.count()


def test_run_packs_what_is_left(spark):
    out = cp.run(spark, SF)
    per = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per.filter("n <> t").count() == 0
    assert 0 < per.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_texts_of_no_known_language_go(spark):
    """Labels of two languages: their texts stay, with a label or without; others stay only if they look much like one of the two."""
    import random

    rng = random.Random(11)
    words = {"en": "the of and river stone light over under green quick brown fox".split(), "de": "der die und fluss stein licht unter gruen schnell braun fuchs".split()}
    rows = [(k, " ".join(rng.choice(words[("en", "de")[k % 2]]) for _ in range(60)), ("en", "de")[k % 2] if k < 300 else None) for k in range(320)]
    strange = [(1000 + k, " ".join("".join(rng.choice("\u3042\u3044\u3046\u3048\u304a\u304b\u304d") for _ in range(5)) for _ in range(40)), None) for k in range(20)]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in cp.language(spark, docs, SF).collect()}
    assert kept >= {k for k, *_ in rows}
    # what goes is what is less likely than LEAST_GAIN times an even chance
    scores = {r.doc_id: r["__nl_score"] for r in predict(docs, fit_languages(docs)).collect()}
    assert kept == {k for k, x in scores.items() if x >= cp.LEAST_GAIN / 2}
    assert cp.language(spark, docs.filter("lang IS NULL"), SF).count() == 40  # without labels nothing is rejected


def test_near_finds_chains_of_edited_copies(spark):
    """Documents and copies of copies, each edited a little more: the groups are those of all pairs at the similarity."""
    import random

    from noticelake.llm.near import near_groups
    from tests.llm.test_duplicates import brute_groups

    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for start in range(0, 40, 2):
        words = texts[start].split()
        for _ in range(4):
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice("alpha beta gamma delta".split())
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_groups(docs, cp.SHINGLE_WORDS, cp.SIMILARITY).collect()}
    want = brute_groups(dict(enumerate(texts)), cp.SIMILARITY)
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(texts) - 20
