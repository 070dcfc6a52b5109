"""Flat word views, and BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cartlake.llm import bpe
from cartlake.llm.queries import vocabulary_path
from cartlake.llm.words import span_hashes, split_words, text_chunks

TEXTS = ["", None, "One  two\tTHREE\n", " ", "é ü x", "a" * 50, "tail"]


def test_words_follow_the_pattern():
    words = split_words(pa.array(TEXTS))
    raw = words.data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(words.starts, words.ends)]
    assert found == ["one", "two", "three", "é ü", "x", "a" * 50, "tail"]
    assert words.counts.tolist() == [0, 0, 3, 0, 2, 1, 1]


def test_equal_words_have_equal_hashes_and_others_do_not():
    words = split_words(pa.array(["ab ba ab a aa aaa", "ab"]))
    hashes = span_hashes(words.data, words.starts, words.ends)
    assert hashes[0] == hashes[2] == hashes[6] and len(set(hashes.tolist())) == 5


def test_chunks_cover_all_rows_in_order(monkeypatch):
    monkeypatch.setattr("cartlake.llm.words.CHUNK_BYTES", 10)
    batch = pa.record_batch([pa.array(["abc", "d" * 30, None, "e", "f" * 9])], ["text"])
    parts = list(text_chunks(batch))
    assert [t for p in parts for t in p["text"].to_pylist()] == batch["text"].to_pylist() and len(parts) > 2


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_on_random_texts(vocabulary, library):
    pick = random.Random(1)
    parts = list(" \n\t's're've'll'm'd'tXyz019é漢!?…  ") + ["<|endoftext|>", "the ", "ing", " ", "\x1c", "\r\n"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(3000)] + TEXTS
    encoder = bpe.Encoder(vocabulary)
    got = [ids for at in range(0, len(texts), 700) for ids in encoder.encode(texts[at:at + 700])]
    assert [ids.tolist() for ids in got] == [expected(library, t) for t in texts]
    assert [encoder.decode(ids) for ids in got] == [t or "" for t in texts]


def test_long_words_and_forgetting(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    texts = ["ab" * 5000, "a" * 4001, "word " * 3000, "x1y2" * 2000]
    encoder = bpe.Encoder(vocabulary)
    assert [encoder.encode([t])[0].tolist() for t in texts] == [expected(library, t) for t in texts]


def test_query_digests_and_round_trip(spark, library):
    rows = [(1, "Hello <|endoftext|> it's"), (2, None), (3, ""), (3, ""), (None, " \n x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    found = sorted(bpe.digests(docs, vocabulary_path()).collect(), key=str)
    want = []
    for doc_id, text in rows:
        ids = expected(library, text)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    back = bpe.decoded(bpe.encoded(docs, vocabulary_path()), vocabulary_path())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.digests(docs.limit(0), vocabulary_path()).count() == 0
