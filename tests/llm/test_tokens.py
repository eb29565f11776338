from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm import bpe, packing, token_files
from noticelake.llm.tokens import ByteLevelEncoder
from tests.llm.data import awkward, empty

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = " \n\t\r'aSbtdre.,!12é²ªµ×İ \u0085\x1c　漢ßΣ́<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoders():
    return ByteLevelEncoder(BYTE), bpe.WordEndEncoder(WORD)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_encoders_equal_the_library(encoders, library, text):
    byte, word = encoders
    assert list(array("I", byte.encode(text))) == library[0].encode(text, add_special_tokens=False).ids
    want = library[1].encode(text, add_special_tokens=False).ids
    n, ids, decoded = word.encoded(text)
    assert (n, ids) == (len(want), " ".join(map(str, want)))
    assert decoded == library[1].decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [2, 3, 7, 16])
def test_tree_joins_are_exact(encoders, library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    rng = random.Random(leaf)
    for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
            assert encoders[1].word(word) == library[1].encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_packing_of_bits_round_trips(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_files.unpack(packed, bits, 1001) == ids).all()


def test_random_access_reads_only_its_blocks():
    ids = np.arange(1000, dtype="<u4") % 900
    content = token_files.to_file([(None, b""), (-(2**63), ids[:10].tobytes()), (7, ids[10:].tobytes())], 10, block_ids=64)
    asked = []

    def read(start, size):
        asked.append(size)
        return content[start : start + size]

    file = token_files.TokenFile(read, len(content))
    assert (file.ids(130, 140) == ids[130:140]).all() and len(asked) == 3 and asked[-1] == 80
    assert (file.ids(60, 200) == ids[60:200]).all() and len(file.ids(5, 5)) == 0
    assert [(d, s, len(x)) for d, s, x in file.documents()] == [(None, 0, 0), (-(2**63), 0, 10), (7, 10, 990)]
    with pytest.raises(ValueError):
        token_files.TokenFile.of(b"X" * 100)


def want_ids(docs, library, end):
    rows = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in docs.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_hold_all_ids_in_order(spark, library, tmp_path):
    docs = awkward(spark)
    files = token_files.write_token_files(docs.repartition(3), BYTE, str(tmp_path / "f"), block_ids=1000, file_ids=5000)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "f"), files).collect(), key=lambda r: r.start)
    want = want_ids(docs, library[0], 2)
    start = 0
    assert [r.doc_id for r in got] == [d for d, _ in want]
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, list(np.frombuffer(r.ids, "<u4"))) == (start, len(ids), ids)
        start += len(ids)
    assert files.count() > 1
    assert token_files.write_token_files(empty(spark), BYTE, str(tmp_path / "g")).count() == 0


def test_best_fit_decreasing_finds_the_tightest_window():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        where, offset, used = packing.best_fit_decreasing(lengths, 64)
        free: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f >= lengths[i]]
            room = min(fits) if fits else 64
            if fits:
                free.remove(room)
            assert 64 - offset[i] == room
            free.append(room - lengths[i])
        assert used == len(free)
        for w in range(used):
            spans = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
            at = 0
            for o, n in spans:
                assert o == at
                at += n
            assert 0 < at <= 64


def test_packed_pieces_cover_all_ids(spark, library):
    docs = awkward(spark)
    pieces = packing.pack_documents(docs, BYTE, pool_tokens=3000).collect()
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc_id, ids in dict(want_ids(docs, library[0], 0)).items():
        n_rows = 2 if doc_id == 2 else 1
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        joined = b"".join(p.ids for p in own[::n_rows])
        assert list(np.frombuffer(joined, "<u4")) == ids and {p.doc_tokens for p in own} == {len(ids)}
    spans: dict = {}
    for p in pieces:
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in spans.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(empty(spark), BYTE).count() == 0


def test_pieces_waste_little(spark):
    docs = spark.createDataFrame([(i, "the river " * (1 + i * 37 % 700)) for i in range(400)], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(docs, BYTE).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    n, used = got.agg(F.count("*"), F.sum("n")).first()
    assert used / (1024 * n) > 0.98


def test_long_texts_encode_as_short_ones(spark, library):
    docs = awkward(spark).unionByName(awkward(spark).limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn(
        "text", F.concat(F.lit("Start "), F.repeat(F.lit("abRa"), 6000), F.lit(" mid' "), F.repeat(F.lit("é1ee"), 3000), F.lit("..end"))))
    got = sorted(map(tuple, bpe.encode_documents(docs, WORD).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = library[1].encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), " ".join(map(str, ids)), library[1].decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(empty(spark), WORD).count() == 0
    assert docs.filter(bpe.is_long("text")).count() == 2


def test_queries_give_the_digests(spark):
    row = packing.op2_packing(spark, "/root/testdata/sf0.001").first()
    assert 0 <= row.ids_crc32 < 2**32
    first = token_files.op3_token_files(spark, "/root/testdata/sf0.001").orderBy("start").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    ids = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids + [2]
    assert (first.start, first.n_tokens, first.ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
