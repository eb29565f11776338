from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import exact_dedup, fingerprints, near, simhash
from tests.llm.data import awkward, empty, prose


def test_exact_groups_equal_brute_force(spark):
    docs = awkward(spark)
    rows = docs.collect()
    by_text = defaultdict(list)
    for r in rows:
        by_text[r.text or ""].append(r.doc_id)
    want = []
    for r in rows:
        own = by_text[r.text or ""]
        keep = max((i for i in own if i is not None), default=None)
        want.append((r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_a_full_filter_only_lets_more_through(spark, monkeypatch):
    docs = awkward(spark)
    want = sorted(map(repr, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 64)
    assert sorted(map(repr, exact_dedup.exact_groups(docs).collect())) == want


def test_filters_by_range_give_the_same_groups(spark, monkeypatch):
    docs = awkward(spark).unionByName(spark.range(60).select(
        (F.col("id") + 100).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("text"),
        *[F.lit(None).cast(t).alias(c) for c, t in awkward(spark).dtypes[2:]]))
    want, kept = sorted(map(repr, exact_dedup.exact_groups(docs).collect())), sorted(map(repr, exact_dedup.drop_exact(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BITMAPS", 1)
    monkeypatch.setattr(exact_dedup, "CELLS_PER_TEXT", 2000)
    assert exact_dedup.ranges_needed(docs.count()) > 3
    assert sorted(map(repr, exact_dedup.exact_groups(docs).collect())) == want
    assert sorted(map(repr, exact_dedup.drop_exact(docs).collect())) == kept
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.drop_exact(empty(spark)).count() == 0


def test_hot_keys_are_joined_like_others(spark):
    from noticelake.llm.shared import salted_join

    many = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(300)] + [(None, 1), ("alone", 2)], "key string, v int")
    one = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(200)], (None, 7)], "key string, w int")
    counts = many.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(map(repr, salted_join(many, one, "key", counts, how).collect()))
        assert got == sorted(map(repr, many.join(one, "key", how).collect()))
        assert got == sorted(map(repr, salted_join(many, one, "key", counts.filter("n < 0"), how).collect()))


def test_unique_rows_pass_the_filter(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 2 * F.when(F.col("id") < 100, 1).otherwise(2))).alias("text"))
    slim = exact_dedup.digests_of(docs, "doc_id", "text")
    bits = exact_dedup.filter_bits(5000)
    flagged = exact_dedup.with_maybe(slim, exact_dedup.cell_bitmaps(slim, bits), bits)
    maybe = flagged.filter(exact_dedup.MAYBE)
    assert maybe.count() < 400
    repeated = slim.groupBy(exact_dedup.DIGEST).count().filter("count > 1")
    assert repeated.join(maybe, exact_dedup.DIGEST, "left_anti").count() == 0


def test_drop_exact_keeps_one_row_of_each_text_with_all_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert {r.doc_id for r in kept.collect()} >= {2, 4} and 1 not in {r.doc_id for r in kept.collect()}


def brute_fingerprint(text, n=3):
    import xxhash

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts)) if parts else 0


def brute_components(points, radius):
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_equals_brute_force(spark):
    docs = awkward(spark).filter("doc_id IS NOT NULL").select("doc_id", "text")
    base = prose(300, 1).split()
    near = []
    for i in range(40):
        words = list(base)
        words[7 * i % 300] = f"w{i % 7}"
        near.append((100 + i, " ".join(words)))
    docs = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = docs.collect()
    points = [brute_fingerprint(r.text) for r in rows]
    label = brute_components(points, 3)
    least = defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        least[c].append(r.doc_id)
    want = sorted((r.doc_id, p if p < 2**63 else p - 2**64, min(least[c])) for r, p, c in zip(rows, points, label, strict=True))
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_components(docs).collect())
    assert got == want and len({c for _, _, c in got}) < 30
    assert simhash.near_components(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_points", [16, 64, 10_000])
def test_links_over_shards_connect_what_is_linked(spark, shard_points):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = [base]
    for _ in range(3):  # chains of near points
        points.append(points[-1][:120] ^ (np.uint64(1) << rng.integers(0, 63, 120).astype(np.uint64)))
    every = np.unique(np.concatenate(points))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long").repartition(4)
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, shard_points)).collect()}
    got = [roots.get(int(x), int(x)) for x in every.view(np.int64)]
    want = brute_components([int(x) for x in every], 3)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_drop_near_keeps_the_smallest_and_wordless_texts(spark):
    kept = near.drop_near(awkward(spark), 5, 0.8)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == awkward(spark).columns
    assert {3, 4, 5} <= set(ids) and 1 in ids and 2 not in ids


def test_close_fingerprints_group_only_similar_texts(spark):
    line = "one two three four five six seven eight nine "
    tails = [" ".join(f"w{k}x{i}" for i in range(25)) for k in range(3)]
    texts = {1: line * 400 + tails[0], 2: line * 400 + tails[1], 3: line * 400 + tails[1] + " more", 4: line * 400 + tails[2], 5: tails[0]}
    points = {i: brute_fingerprint(t, 5) for i, t in texts.items()}
    assert all((points[i] ^ points[1]).bit_count() <= 3 for i in (2, 3, 4))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = {r.doc_id: r.group_id for r in near.near_groups(docs, 5, 0.8).collect()}
    assert groups == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    assert sorted(r.doc_id for r in near.drop_near(docs, 5, 0.8).collect()) == [1, 2, 4, 5]


def shingle_set(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_groups(texts, similarity):
    """The smallest id that each document is connected with over exact similarities of all pairs."""
    sets, label = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def unlike(n, seed):
    """Words that hardly any other seed has."""
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_groups_equal_brute_force(spark):
    texts, licence = {}, "this text is given to you under a licence of seven words or more and ends here"
    base = unlike(120, 1)
    for k in range(5):  # alike to each other, with a line that ids below and above have too
        words = list(base)
        words[20 * k + 5] = f"x{k}"
        texts[10 + k] = " ".join(words) + "\n" + licence + "."
    texts[0], texts[99] = (" ".join(unlike(40, s)) + "\n" + licence + "." for s in (2, 3))
    chain = unlike(200, 4)
    for k in range(6):  # each alike to the next, the ends are not
        texts[20 + k] = " ".join([f"y{k}x{i}" if i < 9 * k else w for i, w in enumerate(chain)])
    edited = unlike(150, 5)  # an edit in every sentence, and no sentence ends at all
    texts[40], texts[41] = " ".join(edited), " ".join(w if i % 50 != 25 else "zz" for i, w in enumerate(edited))
    boiler = unlike(60, 6)  # many that share three fifths
    for k in range(60):
        texts[200 + k] = " ".join(boiler + unlike(40, 100 + k))
    texts[260] = texts[230] + " and more"
    star = unlike(400, 7)  # copies of one text that are like it, but hardly like each other; it has neither end of the ids
    for k in range(40):
        texts[300 + k] = " ".join(star if k == 20 else [f"z{k}x{i}" if i % 80 == 2 * k else w for i, w in enumerate(star)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_groups(texts, 0.8)
    assert {r.doc_id: r.group_id for r in near.near_groups(docs, 5, 0.8).collect()} == want
    assert len({want[10 + k] for k in range(5)}) == len({want[300 + k] for k in range(40)}) == 1 and want[40] == want[41] and want[260] == want[230]


def test_what_rounds_leave_of_a_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "ROUNDS", 2)
    monkeypatch.setattr(near, "BLOCK_DOCS", 7)
    monkeypatch.setattr(near, "band_keys", lambda least: np.full(near.BANDS, 5, np.uint64))  # one bucket of all
    texts = {k: " ".join(unlike(40, k)) for k in range(30)} | {50 + k: " ".join(unlike(40, k // 2)) + f" end{k}" for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near.near_groups(docs, 5, 0.8).collect()} == brute_groups(texts, 0.8)


def test_near_groups_of_repeated_rows(spark):
    docs = awkward(spark)
    groups = near.near_groups(docs).collect()
    assert len({r.doc_id for r in groups}) == len(groups) and {r.doc_id for r in groups} == {1, 2, 6, 7, 8, 9, -5, 2**40}
    assert near.near_groups(empty(spark)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_recover_every_difference(spark):
    import re

    docs = awkward(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    paragraphs = re.compile(r"\S+(?:[ \t\x0b\f\r]+\S+){0,23}", re.A)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, nxt = (set(paragraphs.findall(t)) for t in (text, edited, after))
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(g.near_edited - jaccard(own, changed)) < 1e-9 and abs(g.near_next - jaccard(own, nxt)) < 1e-9
    assert got[1].fingerprint == got[2].fingerprint != got[8].fingerprint


def test_too_small_sketches_are_made_again(spark):
    sql = "aggregate(sequence(1L, {n}L), array(0L), (a, i) -> array_append(a, xxhash64(i)))"
    for n in (2, 10, 30, 60):
        df = spark.range(1).selectExpr(f"{sql.format(n=n)} AS a", "array(0L, 5L) AS b")
        assert df.selectExpr(f"{fingerprints.difference_sql('a', 'b')} AS d").first().d == n + 1
    full = spark.range(1).selectExpr(f"{sql.format(n=60)} AS a", "array(0L) AS b")
    a, b = (fingerprints.sketch_sql(c, 24) for c in "ab")
    assert full.selectExpr(f"{fingerprints.peeled_sql(a, b, 24)} AS d").first().d is None


def cells_of(fingerprint):
    """The number of digests and the cells that a fingerprint shows."""
    body = fingerprint[8:]
    cells = [body[i : i + 28] for i in range(0, len(body), 28)]
    assert len(cells) == fingerprints.FINGERPRINT_CELLS
    return int(fingerprint[:8], 16), [(int(c[:4], 16), int(c[4:20], 16), int(c[20:], 16)) for c in cells]


def peeled_by_hand(first, second):
    """How many digests two shown fingerprints differ by, from the two strings alone."""
    (_, a), (_, b) = cells_of(first), cells_of(second)
    cells = [[(x[0] - y[0]) % 65536, x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(a, b, strict=True)]
    part, n = len(cells) // 3, 0
    while True:
        # without the check's hash: a single digest is one that lies where its own bits say, in all three parts
        single = next(
            ((c, k) for i, (c, k, h) in enumerate(cells) if c in (1, 65535)
             and (k >> 21 * (i // part)) % part == i % part
             and all(cells[p * part + (k >> 21 * p) % part] != [0, 0, 0] for p in range(3))), None)
        if single is None:
            return n if all(c == [0, 0, 0] for c in cells) else None
        c, k = single
        h = next(x[2] for i, x in enumerate(cells) if x[0] == c and x[1] == k)
        for p in range(3):
            at = p * part + (k >> 21 * p) % part
            cells[at] = [(cells[at][0] - c) % 65536, cells[at][1] ^ k, cells[at][2] ^ h]
        n += 1


def test_likeness_follows_from_the_shown_fingerprints(spark):
    rows = [(i, "\n".join(f"line {(i + k) % 9} of some text" for k in range(6))) for i in range(9)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for r, after in zip(got, [*got[1:], got[0]], strict=True):
        for other, near, how in ((r.edited_fingerprint, r.near_edited, r.edited_by_fingerprint), (after.fingerprint, r.near_next, r.next_by_fingerprint)):
            total, differs = cells_of(r.fingerprint)[0] + cells_of(other)[0], peeled_by_hand(r.fingerprint, other)
            assert how and abs((total - differs) / (total + differs) - near) < 1e-12


def test_repeated_ids_edit_with_the_smallest_next_text(spark):
    rows = [(1, "abcdef"), (1, "xy"), (2, "zzzz\nb"), (2, "mmmm"), (None, "qrst"), (-(2**63) + 1, "0123456789")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nexts = {None: "0123456789", -(2**63) + 1: "abcdef", 1: "mmmm", 2: "qrst"}
    want = sorted((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nexts[i][: len(t) // 2]).encode()).hexdigest()) for i, t in rows)
    for parts in (1, 5):
        got = fingerprints.fingerprint_documents(df.repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want


def test_fingerprints_of_awkward_tables(spark):
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
    assert fingerprints.fingerprint_documents(awkward(spark)).count() == awkward(spark).count()
    one = fingerprints.fingerprint_documents(awkward(spark).filter("doc_id = 1")).first()
    assert one.near_next == 1.0
