"""Piece counts against greedy matching."""

import random
import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import op10_counts as op


def greedy(pieces, word):
    text, at, n = "▁" + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("▁abc", min_size=1, max_size=4), max_size=14), st.text("abcd", min_size=1, max_size=14))
def test_random_vocabularies(pieces, word):
    assert op.LongestMatch(pieces).count(word) == greedy(pieces, word)


def test_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(op.pieces_of(path))
    rng = random.Random(2)
    texts = [None, "", " \t\n", "Hello  world, naïve\x0bcafé", "中文", "a" * 50_000, "x\xa0y \x1c"] + [" ".join("".join(rng.choice("etaoinshrdlué.") for _ in range(rng.randint(1, 12))) for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame([(i % 25, t, 9) for i, t in enumerate(texts)] + [(None, "the end", 9)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in op.token_counts(docs, path).collect())
    want = []
    for i, t in [(i % 25, t) for i, t in enumerate(texts)] + [(None, "the end")]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words = ["a" * 50_000] if words == ["a" * 50_000] else words
        n = sum(greedy(pieces, w) if len(w) < 1000 else op.automaton(path).count(w) for w in words)
        want.append((i is None, i or 0, len(words), n))
    assert got == sorted(want)
    assert op.token_counts(docs.limit(0), path).count() == 0


def test_full_cache(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 2)
    match = op.LongestMatch(["▁a", "b", "▁"])
    assert [match.counts(["a", "ab", "abb"]) for _ in range(3)] == [6, 6, 6]
