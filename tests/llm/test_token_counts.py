"""Token counts against the tokenizers library."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import corpus
from tests.llm.test_operators import fuzz
from turnlattice.llm import token_counts
from turnlattice.llm.token_counts import TokenCounter

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return TokenCounter(PATH)


def test_fuzzed_texts(own, library):
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", *fuzz(3000, 5)]
    assert own.counts(texts) == [library(t) for t in texts]


def test_runs_and_long_words(own, library):
    rnd = random.Random(2)
    texts = [c * n for c in ("a", " ", "\n", "=", "-", "é", "0", "ab", " a", "aab") for n in (1, 2, 3, 5, 8, 17, 1000)]
    texts += ["".join(rnd.choice("abcdefghij") for _ in range(n)) for n in (50, 3000, 20000)]
    assert own.counts(texts) == [library(t) for t in texts]


def one_by_one(own, piece):
    """The classic loop: the leftmost of the lowest pairs, one at a time."""
    rank = {(int(k) // own.size, int(k) % own.size): int(r) for k, r in zip(own.keys[:-1], own.order, strict=True)} if not hasattr(own, "_rank") else own._rank
    own._rank = rank
    symbols = [int(own.first[ord(c)]) for c in piece]
    while True:
        best = min(((rank.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return len(symbols)
        symbols[best[1] : best[1] + 2] = [int(own.made[best[0]])]


def test_rounds_against_single_merges(own):
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("etaoinĠsh") for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    assert own.survivors(pieces).tolist() == [one_by_one(own, p) for p in pieces]


def test_cuts_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", 7)
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    texts = fuzz(1500, 9)
    assert all("".join(token_counts.segments(t)) == t for t in texts)
    assert TokenCounter(PATH).counts(texts) == [library(t) for t in texts]


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 10)
    own = TokenCounter(PATH)
    for t in fuzz(300, 3):
        assert own.counts([t, t]) == [library(t)] * 2
        assert len(own.words) < 100


def test_table(spark, tmp_path, library):
    docs = corpus.table(spark, tmp_path / "d")
    out = token_counts.token_counts(docs, PATH, limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r.doc_id, len((r.text or "").encode()), n := library(r.text or ""), n > 100) for r in docs.collect())
    assert Counter(map(tuple, out.collect())) == want  # null ids, repeated rows, null, empty and long texts, columns of any name
    assert token_counts.token_counts(corpus.empty(spark), PATH).count() == 0
