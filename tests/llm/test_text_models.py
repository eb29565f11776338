from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import context_mixing as cm
from noticelake.llm import html_text, language, warc
from tests.llm.data import awkward, empty, prose

SF = "/root/testdata/sf0.01"


def test_pages_without_their_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, please agree to that.</div>
    <article><h1>A   heading</h1><p>First paragraph &amp; more,<br>with <b>bold
    text</b> and a <a href="x>y">link</a>.<p>Second one; it isn't closed.<script>var t = "</p><p>no";</script>
    <!-- hidden <p>no</p> --><ul><li>One item, long enough to read.</li></ul></article>
    <aside><p>Other stories, told elsewhere, at length.</p></aside><section id="comments"><p>I disagree, strongly, with all of this!</p></section>
    <form><p>Subscribe now, it is free.</p></form><footer>&copy; 2024, all rights.</footer></body></html>"""
    assert html_text.main_text(page) == "A heading\nFirst paragraph & more, with bold text and a link.\nSecond one; it isn't closed.\nOne item, long enough to read."


def test_layouts_and_comments_by_their_names():
    text = "A paragraph, with commas; and enough length to be one."
    page = f"""<body class="home"><div class="layout-sidebar has-menu"><article class="post"><p>{text}</p></article>
    <div><article class="comment"><p>Another, quite long, opinion of a reader.</p></article></div></div></body>"""
    assert html_text.main_text(page) == text


PARAGRAPH = "This is a paragraph of the article, with commas; it is long enough to be one, and it ends here."
ARTICLE = "".join(f"<p>{PARAGRAPH} Number {i}.</p>" for i in range(5))
ARTICLE_TEXT = "\n".join(f"{PARAGRAPH} Number {i}." for i in range(5))


@pytest.mark.parametrize("page", [
    f'<article><p title="a hidden gem">{PARAGRAPH}</p></article>',
    f'<p data-hidden="false">{PARAGRAPH}</p>',
    f'<p data-class="ad">{PARAGRAPH}</p>',
    f'<section data-x="the role=form"><p>{PARAGRAPH}</p></section>',
    *(f'<body><div>Menu two</div><div class="{name}"><p>{PARAGRAPH}</p></div></body>' for name in
      ("notice-detail", "side", "share", "banner", "reply-box", "comment-view", "menu1", "promo")),
    f'<form id="aspnetForm"><div><p>{PARAGRAPH}</p></div></form>',
])
def test_names_and_values_do_not_empty_an_article(page):
    assert main_text_of(page) == PARAGRAPH


LONG_PARTS = ["The first paragraph of the report is long enough, and it says what was found in spring.", "In the second one, the authors explain how they counted; it took three years, they say.", "The third paragraph closes the part, and names those who helped with the counting."]
PROBES = {
    "discussion": ("<h2>Discussion</h2><p>What was found agrees with earlier work, but not in all points.</p>", ["Discussion", "What was found agrees with earlier work, but not in all points."]),
    "responses": ("<p>Responses:</p><p>Most of those who were asked agreed, a few did not.</p>", ["Responses:", "Most of those who were asked agreed, a few did not."]),
    "list": ("<ul><li>two eggs<li>one cup of milk</ul>", ["two eggs", "one cup of milk"]),
    "table": ("<table><tr><td>2020<td>15<tr><td>2021<td>18</table>", ["2020", "15", "2021", "18"]),
    "link": ("<p><a href=x>The full report is published here, in two volumes.</a></p>", ["The full report is published here, in two volumes."]),
    "button": ("<p>Press the <button>Save</button> key, then wait.</p>", ["Press the Save key, then wait."]),
    "lone button": ("<button>Share this story now please</button>", []),
    "links": ("<ul><li><a href=a>Another story of the day</a><li><a href=b>One more of them</a></ul>", []),
    "comments": ("<h2>Comments</h2><div><p>anna says: nice!</p><p>Reply</p></div>", []),
    "replies": ("<h3>3 replies</h3><p>bob, 2 days ago</p><p>I do not agree with that.</p>", []),
}


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class=content>{}</div>", "<main><article>{}</article></main>", "{}"])
@pytest.mark.parametrize("probe", PROBES)
def test_short_parts_of_an_article_stay_and_furniture_goes(probe, around):
    inner, want = PROBES[probe]
    body = "".join(f"<p>{p}</p>" for p in LONG_PARTS) + inner
    menu = "<nav><ul><li><a href=/>Home</a></ul></nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul>"
    page = f"<html><body>{menu}{around.format(body)}<footer><p>All rights reserved, 2024.</p></footer></body></html>"
    assert main_text_of(page).split("\n") == [*LONG_PARTS, *want]


def test_headings_beside_articles_and_second_articles_stay():
    own = "".join(f"<p>{p}</p>" for p in LONG_PARTS)
    assert main_text_of(f"<body><h1>The title</h1><article>{own}</article></body>").split("\n") == ["The title", *LONG_PARTS]
    two = main_text_of(f"<body><article><h1>One</h1>{own}</article><article><h2>Two</h2>{own}</article><article><p>Read more, here.</p></article></body>")
    assert two.split("\n") == ["One", *LONG_PARTS, "Two", *LONG_PARTS]
    assert main_text_of(f"<body><h1>Site</h1><article><h1>One</h1>{own}</article></body>").split("\n") == ["One", *LONG_PARTS]


def test_pages_with_lists_and_tables_keep_every_block():
    import random

    rng = random.Random(9)
    for _ in range(40):
        blocks, body = [], ""
        for k in range(rng.randrange(4, 12)):
            kind = rng.choice("pppult")
            parts = [f"{rng.choice(LONG_PARTS)} Part {k}."] if kind == "p" else [f"item {k} {i} {rng.choice('abcdef')}" for i in range(rng.randrange(2, 5))]
            blocks += parts
            if kind == "p":
                body += f"<p>{parts[0]}</p>"
            elif kind == "t":
                body += "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in parts) + "</table>"
            else:
                body += "<ul>" + "".join(f"<li>{x}</li>" for x in parts) + "</ul>"
        first = f"<p>{LONG_PARTS[0]}</p><p>{LONG_PARTS[1]}</p>"
        page = f"<body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><article>{first}{body}</article><div class=sidebar><p>Some other words, of no use.</p></div></body>"
        assert main_text_of(page).split("\n") == [*LONG_PARTS[:2], *blocks]


def main_text_of(page):
    return html_text.main_text(page)


@pytest.mark.parametrize("around", [
    '<div class="lnb">Menu one<br>Menu two</div>{}<div class="legal">Terms apply. All rights are ours, always.</div>',
    "<div><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></div>{}<div>© 2024 The Owners, of everything here.</div>",
    "<div>Home</div><div>About us</div>{}<div>Contact</div>",
    '{}<div class="comments"><p>' + "I disagree, with all of this, strongly. " * 40 + "</p></div>",
    "{}<h3>3 Comments</h3><div><p>I disagree, with all of this, strongly; and at length, as readers do.</p></div>",
    '<div class="ad">Buy now, it is cheap. Really, it is.</div>{}<div><a href="/x">Read this as well, and that</a></div>',
])
@pytest.mark.parametrize("element", ["div", "article", "main"])
def test_furniture_goes_with_and_without_article_elements(around, element):
    page = f"<html><body>{around.format(f'<{element}><h1>The heading</h1>{ARTICLE}</{element}>')}</body></html>"
    assert main_text_of(page) == f"The heading\n{ARTICLE_TEXT}"


def test_deep_pages_take_time_in_proportion():
    import time

    took = []
    for n in (4000, 16_000):
        for page in ("<div>x" * n, "<b>" * n + "</i>" * n, "<p><i>" * n, "<li><b>" * n):
            began = time.perf_counter()
            main_text_of(page)
            took.append(time.perf_counter() - began)
    assert sum(took[4:]) < 12 * sum(took[:4]) + 1 and sum(took) < 20


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "plain", "</div></p>", "<p>a", "<a href='", "<!--", "<script>x", "&#x110000;&bogus;", "<p>" * 3000 + "deep"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_extraction_of_awkward_tables(spark):
    rows = spark.createDataFrame([(1, None, None), (1, "u", "<p>Text, here.</p>"), (None, "u", "")], "page_id long, url string, html string")
    got = sorted(map(repr, html_text.extract_pages(rows).collect()))
    assert len(got) == 3 and html_text.extract_pages(rows.limit(0)).count() == 0


def test_tag_paths_find_the_article_of_the_test_pages(spark):
    import html
    import re

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        body = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (9, "u", ""), (7, "u", prose(5000, 3)), (-4, "u", "other é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    listed = warc.write_archives(df, str(tmp_path), archive_bytes=1000)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path), listed).collect()}
    assert {i: r.refers_to for i, r in got.items()} == {1: 5, 5: None, 3: 5, 2: 9, 9: None, 7: None, -4: None}
    for i, _, html in pages:
        payload = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.digest32(payload))
        assert r.record_type == ("revisit" if r.refers_to else "response")
        assert r.payload is None if r.refers_to else bytes(r.payload) == payload
    assert warc.write_archives(df.limit(0), str(tmp_path / "none")).count() == 0


def test_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    listed = warc.write_archives(df, str(tmp_path), min_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, str(tmp_path), listed).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_references_of_repeated_and_missing_ids(spark, tmp_path):
    rows = [(5, "u", "A"), (5, "u", "B"), (9, "u", "A"), (7, "u", "B"), (None, "u", "A"), (None, "u", "C"), (11, "u", "Z"), (11, "u", "Z"), (1, "u", None)]
    got = warc.with_reference(spark.createDataFrame(rows, "page_id long, url string, html string"), 0).collect()
    assert sorted(map(repr, ((r.page_id, r.html, r.refers_to) for r in got))) == sorted(map(repr, [
        (5, "A", 9), (5, "B", 7), (9, "A", None), (7, "B", None), (None, "A", 9), (None, "C", None), (11, "Z", None), (11, "Z", None), (1, None, None)]))


def archive():
    return warc.to_archive([warc.to_record(i, "http://x/", prose(50, i).encode(), None) for i in range(40)])


def test_archives_carry_their_dictionary():
    content = archive()
    assert int.from_bytes(content[4:8], "little") > 1000
    assert [warc.read_record(f)[0] for f in warc.frames(content)] == list(range(40))


def test_damaged_archives_are_refused():
    content = archive()
    for broken in (b"", content[:6], content[20:], content[:-3], content + b"\0\0\0\0junk", content[:8] + b"\xff" * 50 + content[58:]):
        with pytest.raises(Exception):  # noqa: B017 - any refusal will do
            for f in warc.frames(broken):
                warc.read_record(f)
    record = warc.to_record(1, "u", b"payload", None)
    for bad in (record.replace(b"payload", b"payloax"), record.replace(b"Content-Length: 7", b"Content-Length: 8"), record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(warc.ArchiveError):
            warc.read_record(bad)


def test_gradients_are_the_slopes():
    net = language.ByteNet(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)
    loss, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = tuple(int(i) for i in np.unravel_index(np.abs(g).argmax(), g.shape))
        before, step = p[at], 1e-2
        p[at] = before + step
        up, _ = net.gradients(x, y)
        p[at] = before - step
        down, _ = net.gradients(x, y)
        p[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_tabulated_responses_equal_the_convolution():
    net = language.ByteNet(["a", "b"], seed=5)
    net.tables()
    x = np.random.default_rng(1).integers(0, 256, (4, language.WINDOW)).astype(np.uint8)
    p = net.probabilities(x)
    for label in (0, 1):
        loss, _ = net.gradients(x, np.full(4, label))
        assert abs(loss + np.log(p[:, label]).mean()) < 1e-4


def test_languages_of_held_out_documents(spark):
    rows = language.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_tables(spark):
    docs = awkward(spark)
    got = language.predict(docs, language.fit_languages(docs))
    assert got.columns == [*docs.columns, "__nl_lang", "__nl_score"]
    und = {r.doc_id for r in got.collect() if r["__nl_lang"] == "und"}
    assert und == {3, 4, 5, 2**40}
    assert language.fit_languages(empty(spark)) is None
    assert {r["__nl_lang"] for r in language.predict(docs, None).collect()} == {"und"}


def test_prefix_code_is_complete():
    code = cm.PrefixCode(cm.pair_counts([b"hello world, hello", b"", "é".encode()]).reshape(256, 257))
    for lengths in code.length.reshape(256, 257):  # by the byte before
        assert abs(sum(2.0 ** -int(n) for n in lengths) - 1) < 1e-12
    assert code.length[ord("e") * 257 + ord("l")] < code.length[ord("e") * 257 + 200]


def brute_units(text):
    """The symbol and the six bytes before it, the last one first, of each place of a text."""
    raw = cm.LEAD + text
    symbols = [*text, cm.END]
    return [(s, tuple(raw[i + cm.LOOK_BACK - k] for k in range(cm.LOOK_BACK))) for i, s in enumerate(symbols)]


def as_key(unit):
    return unit[0] << 48 | sum(b << (40 - 8 * k) for k, b in enumerate(unit[1]))


TEXTS = [b"some text", b"", b"another one\0with a zero, and a long long run of words", "ünï 漢字".encode(), b"a\nb\tc  d"]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_units_hold_the_bytes_before(size):
    want = [as_key(u) for t in TEXTS for u in brute_units(t)]
    assert np.concatenate(list(cm.key_blocks(TEXTS, size))).tolist() == want
    flags = [False, True, False, True, False]
    keys, counts = cm.distinct_units(TEXTS, flags, size)
    trained = Counter(as_key(u) for t, f in zip(TEXTS, flags, strict=True) if not f for u in brute_units(t))
    assert keys.tolist() == sorted(set(want)) and counts.tolist() == [trained[k] for k in sorted(set(want))]


def context_of(unit, k):
    """The bytes that a context sees of a unit, the last one first."""
    before = unit[1]
    if k:
        return before[:k]
    n = next((i for i, b in enumerate(before) if b <= 32), len(before))
    return before[: max(n, 1)]


def test_contexts_are_cut_from_units_in_order():
    units = {as_key(u): u for t in TEXTS for u in brute_units(t)}
    keys = np.array(sorted(units), np.uint64)
    for k, cut in zip(cm.CONTEXTS, cm.context_keys(keys), strict=True):
        assert (np.diff(cut.astype(np.float64)) >= 0).all()
        same = {}
        for key, c in zip(keys.tolist(), cut.tolist(), strict=True):
            same.setdefault(c, set()).add((units[key][0], context_of(units[key], k)))
        assert all(len(v) == 1 for v in same.values()) and len(same) == len({(u[0], context_of(u, k)) for u in units.values()})


def test_pair_counts_equal_brute_force():
    want = Counter((u[1][0], u[0]) for t in TEXTS for u in brute_units(t))
    got = cm.pair_counts(TEXTS).reshape(256, 257)
    assert {(i, j): n for i, j in np.argwhere(got).tolist() if (n := int(got[i, j]))} == want


def test_words_are_those_between_white_space():
    texts = [b" a b\t\na ", b"", b"  ", "é\x1c漢 a\x0b\x0cb".encode()]
    used, words, sizes = cm.words_of(texts)
    assert [[words[i] for i in part] for part in np.split(used, np.cumsum(sizes)[:-1])] == [t.split() for t in texts]


def random_units(seed):
    """Units of every symbol after a few contexts, with random predictions of each slot."""
    rng = np.random.default_rng(seed)
    code = cm.PrefixCode(rng.integers(0, 3, (256, 257)))
    keys = np.array(sorted(as_key((s, tuple(b))) for b in (b"abc de", b" xyzzy", b"  \n\0ab") for s in range(257)), np.uint64)
    slots, answers = {}, {}
    for c, own in enumerate(cm.context_keys(keys)):
        distinct = own[cm.firsts(own)]
        order, cuts = cm.dealt(distinct, 3)
        for r in range(3):
            out = []
            for key in distinct[order[cuts[r] : cuts[r + 1]]]:
                place = int(cm.code_places(key[None])[0])
                for i in range(int(code.start[place]), int(code.start[place] + code.length[place])):
                    value, kind = slots.setdefault((c, int(key & cm.CONTEXT_MASK), int(code.node[i])), (int(rng.integers(-31, 32)), int(rng.integers(0, 4))))
                    out.append((value if code.bit[i] else -value) << 2 | kind)
            answers[c, r] = cm.packed(np.array(out, np.int8))
    return cm.Units(keys, code, answers, 3)


def test_probabilities_of_all_next_symbols_sum_to_one():
    units = random_units(2)
    model = cm.Model()
    rng = np.random.default_rng(3)
    model.weights, model.map = rng.normal(0.1, 0.1, model.weights.shape).astype(np.float32), rng.uniform(0.3, 0.95, model.map.shape).astype(np.float32)
    chances = np.exp(model.unit_costs(units).astype(np.float64))
    for context in set((units.keys & cm.CONTEXT_MASK).tolist()):
        assert np.abs(chances[(units.keys & cm.CONTEXT_MASK) == context].sum(axis=0) - 1).max() < 2e-3


def test_texts_move_between_mixers_as_by_hand(monkeypatch):
    monkeypatch.setattr(cm, "LOOK_UP", 2 * cm.STEP)
    texts = [prose(300, i).encode() for i in range(5)] + [b"", b"x", prose(2000, 9).encode()]
    keys, counts = cm.distinct_units(texts, [False] * len(texts))
    rng = np.random.default_rng(1)
    costs = np.log(rng.uniform(0.1, 0.9, (len(keys), len(cm.MIXERS)))).astype(np.float32)
    model = cm.Model()
    monkeypatch.setattr(model, "unit_costs", lambda units: costs)
    units = type("Known", (), {"keys": keys})()
    got = model.scores(texts, units, counts)
    row = {k: costs[i].astype(float) for i, k in enumerate(keys.tolist())}
    start = [cm.TRAINED_SHARE] + [(1 - cm.TRAINED_SHARE) / (len(cm.MIXERS) - 1)] * (len(cm.MIXERS) - 1)
    for text, score in zip(texts, got, strict=True):
        shares, whole, symbols = np.array(start), 0.0, [as_key(u) for u in brute_units(text)]
        for a in range(0, len(symbols), cm.STEP):
            gained = shares * np.exp(sum(row[k] for k in symbols[a : a + cm.STEP]))
            whole += math.log10(gained.sum())
            shares = (1 - cm.FLOW) * gained / gained.sum() + cm.FLOW * np.array(start)
        assert abs(score - whole) < 1e-4 * max(1, abs(whole))
    assert np.allclose(got, [model.scores([t], units, counts)[0] for t in texts], rtol=1e-6)


def test_scores_equal_brute_force_counts(spark):
    got = cm.op4_context_mixing(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    low = {r.doc_id: (r.text or "").encode().lower().split() for r in rows}
    training = [i for i in low if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in training for w in low[i])
    n, v, ends = sum(c.values()) + len(training), len(c) + 1, len(training)
    for r in got:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in low[r.doc_id]) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(low[r.doc_id]) + 1, sum(c[w] > 0 for w in low[r.doc_id]) + 1, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
        assert r.held_out == (r.doc_id not in training)


def test_trained_model_beats_a_uniform_one(spark):
    rows = cm.op4_context_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").filter("held_out").collect()
    bits = -sum(r.score for r in rows) * math.log2(10)
    assert bits / sum(len(r.text.encode()) + 1 for r in rows) < 2.8


def test_scores_of_awkward_tables(spark):
    docs = awkward(spark)
    got = cm.score_documents(docs, cm.is_held_out("doc_id")).collect()
    assert len(got) == docs.count() and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert cm.score_documents(empty(spark), cm.is_held_out("doc_id")).count() == 0


def test_predictions_are_of_exact_contexts(spark, tmp_path):
    rows = [(i, prose(60, i) + chr(1000 + i) * 3, i % 5 == 1) for i in range(30)] + [(None, "no id, but words", False), (7, "", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(4)
    chunks = cm.write_chunks(docs, str(tmp_path), 3000)
    assert chunks.count() > 3
    code = spark.sparkContext.broadcast(cm.PrefixCode(cm.all_pair_counts(chunks)))
    found = cm.predictions_of(chunks, str(tmp_path), code, 8).collect()
    counts, words = Counter(), Counter()

    def slots(unit):  # brute force: context, its bytes, the code so far
        place = unit[1][0] * 257 + unit[0]
        a = int(code.value.start[place])
        path = code.value.bit[a : a + int(code.value.length[place])].tolist()
        return [([(k, context_of(unit, k), tuple(path[:j])) for k in cm.CONTEXTS], bit) for j, bit in enumerate(path)]

    for _, text, held in rows:
        if not held:
            words.update(cm.lowered(text).split())
            for unit in brute_units(cm.lowered(text)):
                counts.update((slot, bit) for three, bit in slots(unit) for slot in three)
    assert [sum(r[c] for r in found if r.chunk == "") for c in ("n", "v")] == [sum(words.values()), len(words)]
    for r in chunks.collect():
        texts, _, flags = cm.read_chunk(str(tmp_path), r.chunk)
        keys, _ = cm.read_units(str(tmp_path), r.chunk)
        assert keys.tolist() == cm.distinct_units(texts, flags)[0].tolist()
        by_key = {as_key(u): u for t in texts for u in brute_units(t)}
        for column, less in (("whole", 0), ("without", 1)):
            answers = {(x.context, x.part): x[column] for x in found if x.chunk == r.chunk and x.context != cm.WORDS}
            units = cm.Units(keys, code.value, answers, 8)
            for i, key in enumerate(keys.tolist()):
                for j, (three, bit) in enumerate(slots(by_key[key])):
                    at = int(units.first[i]) + j
                    want = [int(cm.predictions(np.array(max(counts[s, bit] - less, 0)), np.array(counts[s, 1 - bit]))) for s in three]
                    assert [v >> 2 for v in want] == units.values[:-1, at].tolist()
                    assert sum((v & 3) << 2 * k for k, v in enumerate(want)) == int(units.gate[at])


def test_long_documents_and_rows_without_an_id_shape_the_model(spark, tmp_path):
    docs = spark.createDataFrame([(i if i % 2 else None, prose(5000, i), False) for i in range(6)], "doc_id long, text string, held_out boolean")
    chunks = cm.write_chunks(docs, str(tmp_path), 50_000)
    code = spark.sparkContext.broadcast(cm.PrefixCode(cm.all_pair_counts(chunks)))
    model, n, v = cm.fit(cm.predictions_of(chunks, str(tmp_path), code, 8), str(tmp_path), code, 8)
    plain = cm.Model()
    assert np.abs(model.weights - plain.weights).max() > 0.01 and np.abs(model.map - plain.map).max() > 0.01
    assert n == 30_000 and v < 100 and cm.all_pair_counts(chunks)[32].sum() >= 6 * 4000


def test_scores_do_not_depend_on_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(200, i) + f" word{i % 7}") for i in range(60)], "doc_id long, text string")
    one = {r.doc_id: r for r in cm.score_documents(docs.coalesce(1), cm.is_held_out("doc_id")).collect()}
    many = {r.doc_id: r for r in cm.score_documents(docs.repartition(7), cm.is_held_out("doc_id")).collect()}
    for i, r in one.items():
        assert abs(r.base_score - many[i].base_score) < 1e-9 * abs(r.base_score) and (r.n_known, r.n_tokens) == (many[i].n_known, many[i].n_tokens)
        assert abs(r.score - many[i].score) < 0.05 * abs(r.score)  # chunks find weights of their own, which are averaged
