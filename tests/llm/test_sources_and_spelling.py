"""Divergence of sources, mixes and spelling variants against plain versions."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import divergence, mixing, queries, spelling
from tests.llm.data import awkward, empty

SF = "/root/testdata/sf0.001"


# divergence of sources


def brute_divergence(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(r[1], t) for r, t in zip(rows, terms, strict=True) if r[0] == lang]
        docs = Counter(x for _, t in own for x in set(t))
        kept = {x for x, n in docs.items() if n >= least_docs}
        counts, whole = defaultdict(Counter), Counter()
        for source, t in own:
            counts[source].update(x for x in t if x in kept)
            whole.update(x for x in t if x in kept)

        def shares(c, kept=kept):
            size = sum(c.values()) + len(kept)
            return {x: 1 + 1_000_000_000 * (c[x] + 1) // size for x in kept}

        every, q_all = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s, p in every.items():
            pairs = [(-sum((p[x] - q[x]) ** 2 // q[x] for x in kept), o.encode(), o) for o, q in every.items() if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            far = [(-((p[x] - q_all[x]) ** 2 // q_all[x]), x.encode(), x) for x in kept if counts[s][x] and p[x] > q_all[x]]
            out += [(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(sorted(far)[:top], 1)]
    return sorted(out)


def test_divergence_of_awkward_rows(spark):
    rows = [(r.lang, r.source, r.text) for r in awkward(spark).collect()]
    rows += [("en", "t", "The river, the fox"), ("en", None, "river Fox river"), ("en", "t", "river"), ("fr", "only", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int")
    for blocks in ({}, {"term_block": 2, "source_block": 1}):
        got = sorted(map(tuple, divergence.divergence(docs, top_terms=4, **blocks).collect()))
        assert got == brute_divergence(rows, 3, 4)
    assert divergence.divergence(empty(spark)).count() == 0


def test_divergence_of_sources_over_many_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    got = divergence.divergence(docs, top_terms=30, term_block=100, source_block=6).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, 3, 30)


def test_a_forest_prices_as_a_plain_sum_and_keeps_equal_trees_once():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.4, (5, 300)).astype(np.int64)
    counts[3] = counts[1]
    totals = counts.sum(axis=1) + 300
    forest = divergence.Forest(counts)
    assert forest.roots[1] == forest.roots[3] and sum(forest.sizes) < 5 * 300
    for one in range(5):
        others = np.array([k for k in range(5) if k != one])
        forth, back = forest.prices(one, others, totals)
        for k, f, b in zip(others, forth, back, strict=True):
            p, q = ([1 + 1_000_000_000 * (int(c) + 1) // int(totals[g]) for c in counts[g]] for g in (one, k))
            assert f == sum((x - y) ** 2 // y for x, y in zip(p, q, strict=True))
            assert b == sum((x - y) ** 2 // x for x, y in zip(p, q, strict=True))


def test_shares_are_exact_far_beyond_what_a_product_holds():
    counts = np.array([0, 10**13, 7 * 10**14 - 1, 123_456_789_012_345])
    totals = np.full(4, 8 * 10**14)
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // (8 * 10**14) for c in counts]


def test_long_texts_are_split_in_pieces(monkeypatch):
    line = b"ab  cde f " * 50 + b"g" * 40
    assert [w for p in divergence.pieces(line, 7) for w in p] == line.split()


# mixes


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """{source: words} -> {source: target}, in exact fractions."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, held = set(order), {}
    while True:
        words, weighing = sum(sizes.values()) - sum(held.values()), sum(weight[s] for s in free)
        above = {s for s in free if weighing and Fraction(weight[s] * words, weighing) > most * sizes[s]}
        if not above:
            return {s: float(held[s]) if s in held else float(Fraction(weight[s] * words, weighing)) for s in order}
        held |= {s: most * sizes[s] for s in above}
        free -= above


def check_mix(rows, got):
    """``rows``: (doc_id, source, text); ``got``: rows of mix(). Returns by how much each source misses its target."""
    size_of = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    sizes = Counter()
    for (_, s, _), n in zip(rows, size_of, strict=True):
        sizes[s] += n
    targets = brute_targets(sizes)
    want = sorted((repr(i), repr(s), n, sizes[s], targets[s]) for (i, s, _), n in zip(rows, size_of, strict=True))
    assert sorted((repr(r.doc_id), repr(r.source), r.size, r.source_size, r.target) for r in got) == want
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[r.source] += r.taken
    return {s: abs(taken[s] - t) for s, t in targets.items()}


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(77, "a few words", None, None, None, None, None)], awkward(spark).schema))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    check_mix(rows, got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    blank = docs.withColumn("text", F.lit(" "))
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_mix_meets_its_targets_to_the_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    off = check_mix(rows, mixing.mix(docs).collect())
    assert max(off.values()) <= 0.5


def test_a_small_rest_is_met_by_giving_back(spark):
    assert sum(a * n for a, n in mixing.fitted([(50, 40), (70, 9), (33, 20)], 7, spare=True).items()) == 7
    assert all(-n <= mixing.fitted([(50, 2), (33, 2)], 1, spare=True).get(a, 0) <= n for a, n in [(50, 2), (33, 2)])
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert max(check_mix(rows, mixing.mix(docs).collect()).values()) <= 0.5


def test_mix_of_a_hot_length_and_a_small_source(spark):
    rows = [(k, "hot", "one two three") for k in range(3000)] + [(5000 + k, "tiny", "a b") for k in range(3)] + [(6000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    off = check_mix(rows, mixing.mix(docs).collect())
    assert off["tiny"] <= 1 and off[None] <= 0.5 and off["hot"] <= 1.5


def test_sums_are_as_near_as_any_choice():
    rng = np.random.default_rng(1)
    for _ in range(300):
        items = [(int(a), int(n)) for a, n in zip(rng.choice(np.arange(1, 40), 4, replace=False), rng.integers(1, 4, 4), strict=True)]
        budget = int(rng.integers(1, 120))
        sums = {sum(a * k for (a, _), k in zip(items, ks, strict=True)) for ks in itertools.product(*[range(n + 1) for _, n in items])}
        for choose in (mixing.reached, mixing.fitted):
            if choose is mixing.fitted and budget > sum(a * n for a, n in items):
                continue
            chosen = choose(items, budget)
            assert all(0 <= chosen.get(a, 0) <= n for a, n in items) and set(chosen) <= {a for a, _ in items}
            assert abs(sum(a * k for a, k in chosen.items()) - budget) == min(abs(s - budget) for s in sums)


def test_fitting_keeps_the_mix_of_lengths_and_takes_odd_tables():
    rng = np.random.default_rng(2)
    histogram = list(Counter(rng.integers(1, 3000, 40_000).tolist()).items())
    total = sum(a * n for a, n in histogram)
    for budget in (1, 17, total // 7, total // 2, total - 1, total):
        chosen = mixing.fitted(histogram, budget)
        assert sum(a * n for a, n in chosen.items()) == budget
    half = mixing.fitted(histogram, total // 2)
    for low in range(0, 3000, 500):
        have, took = (sum(n for a, n in x if low <= a < low + 500) for x in (histogram, half.items()))
        assert abs(took / have - 0.5) < 0.02
    distinct = [(a, 1) for a in range(1000, 3000)]  # each length once
    assert sum(a * n for a, n in mixing.fitted(distinct, 1_234_567).items()) == 1_234_567
    giant = [(5_000_000, 1), (100, 20_000), (7, 900)]
    assert sum(a * n for a, n in mixing.fitted(giant, 1_003_001).items()) == 1_003_001
    assert sum(a * n for a, n in mixing.fitted([(2, 50_000)], 33_333).items()) == 33_332


# spelling variants


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(word):
    """What is left of a word without one letter, with the place: words of one edit share one of these."""
    return [(word[:k], word[k + 1 :]) for k in range(len(word))]


def brute_variants(words):
    gap, near = defaultdict(set), defaultdict(set)
    for w in words:
        for key in edits(w):
            gap[key].add(w)
    for same in gap.values():
        for a in same:
            near[a] |= same - {a}
    for w in words:
        for head, tail in edits(w):
            if head + tail in words:
                near[w].add(head + tail)
                near[head + tail].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = spelling.op13_spelling(spark, "/root/testdata/sf0.01").collect()
    want = brute_variants(words)
    assert sorted(tuple(r) for r in got) == want and sum(r[1] is not None for r in want) > 100


def test_variants_of_awkward_rows_and_of_chains(spark):
    chain = [("abcdefgh", 200), ("abcdefg", 40), ("abcdef", 8), ("abcdeé", 40), ("zzzzzz", 5), ("zzzzzy", 5), ("Zzzzyy", 5), ("x" * 3000, 30), ("x" * 3001, 6)]
    rows = [(k, " ".join([w] * n) + " 9") for k, (w, n) in enumerate(chain, 10)] + [(None, None), (None, "abcdefg, ABCDEFG;abcdefg"), (3, "")]
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("word", F.lit(1))
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == want
    assert spelling.variants(empty(spark)).count() == 0


@pytest.mark.parametrize("tile,guests", [(3, 1), (7, 2)])
def test_tiles_lose_no_pair_and_repeat_none(spark, monkeypatch, tile, guests):
    monkeypatch.setattr(spelling, "GUEST_TILES", guests)
    words = {w: (zlib.crc32(w.encode()) % 50) + 1 for w in ("".join(p) for p in itertools.product("aé", "tb", "ax", "no", "ee", "s", ["", "s"]))}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted((r.word, r.n_near, r.best.near) for r in spelling.near_words(frame, tile).collect())
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    assert got == sorted((w, len(x), min(x, key=lambda y: (-words[y], y))) for w, x in near.items() if x)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_long_texts_are_split_into_the_same_runs(monkeypatch):
    text = "Straße Ångström_naïve 漢字word x÷y " * 30
    want = re.findall("[A-Za-zÀ-ÿ]+", text)
    monkeypatch.setattr(spelling, "PIECE_BYTES", 11)
    got = [w.decode("latin-1") for p in spelling.text_runs(text) for w in p]
    assert got == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in want]


def test_divergence_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op11_divergence']})").fetchall()
    assert sorted(want) == sorted(tuple(r[n] for n in names) for r in divergence.op11_divergence(spark, SF).collect())
