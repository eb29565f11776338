"""Every query of the subpackage on the smallest tables: its columns, and its rows against plain versions."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticelake.llm import queries
from tests.llm.test_duplicates import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_text": "page_id url text n_chars",
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_token_files": "doc_id start n_tokens ids_crc32",
    "op4_context_mixing": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_language": "doc_id held_out lang_pred score",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_divergence": "lang source part item value rank",
    "op12_mixing": "doc_id size source_size target taken",
    "op13_spelling": "word form root n n_near form_n",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    got = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    return got.collect()


def test_all_queries_are_known():
    assert set(queries.queries()) == set(COLUMNS)


def test_main_text(spark):
    want = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(spark, "op1_html_text")
    assert {r.page_id: r.url for r in got} == want and len(got) == len(want) and all(r.n_chars == len(r.text) for r in got)


def test_packing_covers_each_id_once(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op2_packing"):
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_token_files(spark, texts):
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in rows(spark, "op3_token_files")}
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        want = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == want
        start += len(ids)


def test_simhash(spark, texts):
    ids = sorted(texts)
    points = [brute_fingerprint(texts[i]) for i in ids]
    least = {}
    labels = brute_components(points, 3)
    for i, c in zip(ids, labels, strict=True):
        least.setdefault(c, i)
    want = {i: (f"{p:016x}", least[c]) for i, p, c in zip(ids, points, labels, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")} == want


def test_exact_dedup(spark, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    want = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows(spark, "op6_exact_dedup")} == want


def test_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    by_payload = defaultdict(list)
    for r in pages:
        by_payload[r.html or ""].append(r.page_id)
    want = {}
    for r in pages:
        raw, last = (r.html or "").encode(), max(by_payload[r.html or ""])
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[r.page_id] = (len(raw), digest, "response", None) if r.page_id == last else (len(raw), digest, "revisit", last)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows(spark, "op7_warc")} == want


def test_bpe(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows(spark, "op9_bpe"):
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_fingerprints(spark, texts):
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    got = {r.doc_id: r for r in rows(spark, "op10_fingerprints")}
    by_text = {}
    for i in ids:
        t, r = texts[i], got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after[i]][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if edited == t:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint


def test_queries_with_sql_give_its_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        got = queries.queries()[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
