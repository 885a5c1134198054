"""Ids equal the tokenizer library's, and decoding gives the texts back."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skeinmill.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def _texts() -> list[str | None]:
    draw = random.Random(5)
    marks = ["a", "b", "'s", " ", "  ", "\n", "\t", " ", "é", "日本", "🙂", "é", "1234", "...", "<|endoftext|>", "\x00", "the", "ing"]
    long_word = "".join(draw.choice("etaoinshrdlu") for _ in range(900))
    return [None, "", " ", "   \n\n ", long_word, "a" * 2000, "é" * 400, "x " * 40_000, "=" * 700, *("".join(draw.choices(marks, k=draw.randint(1, 60))) for _ in range(300))]


def test_ids_and_bytes_equal_the_librarys(spark, vocabulary, library):
    texts = _texts()
    rows = [(k % 250 if k % 7 else None, text, "x") for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.encode_and_decode(docs, vocabulary).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id is None, doc_id, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert [(a, b, c, bytes(d), bytes(e)) for a, b, c, d, e in got] == sorted(want, key=repr)


def test_long_words_stop_where_a_lower_pair_appears(vocabulary, library):
    """Rounds that contract many occurrences equal the library's single steps, on words over few letters."""
    draw, database = random.Random(9), bpe._Database(vocabulary)
    words = ["".join(draw.choice(letters) for _ in range(bpe.LONG + draw.randint(1, 120))).encode() for letters in ("ab", "abc", "er ", "sting", "0123") for _ in range(3)]
    for word, ids in zip(words, database.contract(words), strict=True):
        assert ids.tolist() == library._core_bpe.encode_single_piece(word)
    short = [bytes(draw.randrange(256) for _ in range(draw.randint(1, 30))) for _ in range(500)]
    assert [x.tolist() for x in database.contract(short)] == [library._core_bpe.encode_single_piece(w) for w in short]


def test_a_made_up_vocabulary_with_later_parts_of_lower_tokens(spark):
    """'abc' ranks under 'ab' and 'bc', so that a contraction makes a pair of lower rank; whole words are looked up first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 310, b"ab": 305, b"cab": 302, b"aa": 320, b"aaa": 301}
    own, library = bpe.Vocabulary(ranks, r"\S+|\s+"), tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    words = ["".join(draw.choice("abc") for _ in range(draw.choice([3, 9, 30, bpe.LONG + 50]))) for _ in range(120)]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs, own), own).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(words[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == words[r["doc_id"]]


def test_forgetting_and_bounds(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 5)
    encoder = bpe._Encoder(bpe._Database(vocabulary))
    texts = ["one two three four", "five six seven eight nine", "one five ten"]
    assert [np.concatenate([encoder.encode([p])[0] for p in encoder.words(t)]).tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert bpe.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}, r"\S+")


def test_a_known_word_is_looked_up_once():
    """Of words that a worker knows each is asked for once, and one that it forgot meanwhile is learned again."""

    class Counting(dict):
        asked = 0

        def get(self, *a):
            Counting.asked += 1
            return super().get(*a)

        def __contains__(self, key):
            Counting.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    vocabulary = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}, r"\S+|\s+")
    encoder = bpe._Encoder(bpe._Database(vocabulary))
    parts = [["abc", " ", "abd"], [], ["abc", "c"] * 50]
    first = [x.tolist() for x in encoder.encode(parts)]
    assert first == [[257, 32, 256, 100], [], [257, 99] * 50]
    encoder.codes = Counting(encoder.codes)
    assert [x.tolist() for x in encoder.encode(parts)] == first
    assert Counting.asked == sum(map(len, parts))
