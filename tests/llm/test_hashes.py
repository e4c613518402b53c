"""Hashes of words, and token counts on pieces that a weak hash would confuse."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tests.llm.conftest import SCHEMA
from tidemark.llm import queries, tokens, words

PATH = public_tokenizers.path(queries.TOKENIZER)


def thue_morse(doublings):
    """A word and its letter-wise complement, which agree modulo 2 ** 64 under any odd base."""
    s = "a"
    flip = str.maketrans("ab", "ba")
    for _ in range(doublings):
        s += s.translate(flip)
    return s, s.translate(flip)


def test_word_hashes_depend_on_bytes_alone_and_tell_words_apart():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(3000)]
    made += [*thue_morse(10), *thue_morse(12), "a" * 64, "a" * 65, "ü", "中文"]
    seen = {}
    for text in (" ".join(made), "\n".join(reversed(made))):
        for _, _, h, _ in words.pieces(pa.array([text])):
            for w, x in zip(text.split(), h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) == len(set(made))


def test_heads_are_hashes_of_the_first_bytes_of_longer_words():
    ((_, _, h, _),) = words.pieces(pa.array(["toxicity toxic toxicology tox"]), heads=(5,))
    assert h[0, 1] == h[2, 1] != 0 and h[1, 1] == h[3, 1] == 0
    assert len({*h[:, 0].tolist(), int(h[0, 1])}) == 5


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(PATH, *tokens.proofs(PATH))


def library(texts):
    return [len(e.ids) for e in tokens.load(PATH).encode_batch(texts, add_special_tokens=False)]


def test_built_pieces_are_counted_as_the_library_does(counter):
    texts = [*thue_morse(10), *thue_morse(12), " " * 300, "don't 'll 'x <|endoftext|> it's", "", "\U000e0fff odd"]
    assert counter.count(texts).tolist() == library(texts)


def test_texts_of_any_length_are_counted_as_the_library_does(counter):
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("aebéc中🙂 \n1.") for _ in range(rng.randint(1, 120))) for _ in range(10_000))
    assert len(long) > tokens.AT_ONCE
    texts = [long, "x" * (tokens.AT_ONCE + 9), "short"]
    assert counter.count(texts).tolist() == library(texts)


def test_a_hash_that_stands_for_another_piece_is_no_hit(counter, monkeypatch):
    monkeypatch.setattr(tokens, "hashes", lambda buf, starts, sizes: np.full(len(starts), 5, np.uint64))
    one = tokens.Counter(PATH, *tokens.proofs(PATH))
    texts = ["some words and some more words", "zxcvqq wwords"]
    assert one.count(texts).tolist() == library(texts)


def test_classes_equal_those_of_single_trials():
    cut = tokens.load(PATH).pre_tokenizer.pre_tokenize_str
    kinds = tokens.proofs(PATH)[1]
    rng = random.Random(1)
    for i in [*range(0x250), *rng.sample(range(0x250, 0x1F000), 1500)]:
        if kinds[i] != tokens.UNKNOWN and kinds[i] != tokens.SPACE:
            one = [len(cut(f"{x}{chr(i)}")) == 1 for x in "!a1"]
            assert one.index(True) == kinds[i] and sum(one) == 1


def test_counts_of_a_table_equal_the_library(spark):
    texts = [None, "", thue_morse(10)[0], thue_morse(10)[1], "plain words"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, PATH).collect()}
    assert got == dict(enumerate(library([t or "" for t in texts])))
