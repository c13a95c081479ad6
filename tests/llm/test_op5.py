"""Near-duplicate components against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from millrace.llm import components, op5_minhash as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=4, percent=80):
    """(size, component's id, whether first) by (id, text); rows are (id, text, key of the text)."""
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    sets = [shingles(t, n) for _, t, _ in order]
    up = list(range(len(order)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(order)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {(d, t): (len(sets[i]), order[top(i)][0], top(i) == i) for i, (d, t, _) in enumerate(order)}


def corpus(seed, families=8, size=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, (" " if rng.random() < 0.5 else "\n").join(w.upper() if rng.random() < 0.2 else w for w in words)))
    rng.shuffle(rows)
    return rows


def check(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    keyed = [(r["doc_id"], r["text"], tuple(r["key"])) for r in docs.select("doc_id", "text", op.text_key().alias("key")).collect()]
    want, named = brute(keyed), {(i, k): t for i, t, k in keyed}
    got = op.judged(docs, shingle=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"], named[r["doc_id"], tuple(r["key"])]], r
    kept = sorted(((r["doc_id"], r["text"]) for r in op.one_of_each(docs, shingle=4).collect()), key=repr)
    alone = [(i, t) for i, t in (r[:2] for r in rows) if not shingles(t, 4)]
    assert kept == sorted([d for d, (size, _, first) in want.items() if size and first] + alone, key=repr)


@pytest.mark.parametrize("block", [5, 2048])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    monkeypatch.setattr(components, "MERGED", 8 * block)
    check(spark, corpus(block))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (6, "a"), (7, "b a"), (None, "a b"), (9, "x " * 30000), (10, "x " * 29999), (11, "É é"), (12, "é é"), (5, "A  B")]
    check(spark, [(i, t, "en", 0) for i, t in rows], "doc_id long, text string, fp string, bucket int")


def test_repeated_and_missing_ids(spark):
    """Every different text is compared, whatever its id: 60 documents share one id, 30 have none, some rows are repeated."""
    rows = [(7 if k < 60 else None if k < 90 else i, t) for k, (i, t) in enumerate(corpus(9))]
    check(spark, rows + rows[:3] * 4 + rows[60:62] * 3 + [(7, None), (None, None), (None, "")] * 2)


def test_different_texts_of_one_id(spark):
    rows = op.near_duplicates(spark.createDataFrame([(1, "a b c d e"), (1, "f g h i j"), (2, "a b c d e"), (3, "f g h i j"), (1, "k l m n o")], "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False)]


def test_one_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (9, "other words are in this one", "z"), (None, "a b c d e f", "n"), (8, None, "e")], "doc_id long, text string, lang string")
    kept = op.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["lang"]) for r in kept.collect()), key=repr) == [(2, "y"), (8, "e"), (9, "z")]
    assert op.one_of_each(docs.limit(0)).count() == 0


def test_values_estimate_similarity():
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(40):
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 50, 50))
        x, y = op.min_max([np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))], bands=80, rows=1)
        hits += (x == y).mean() / 40
    assert abs(hits - 0.8) < 0.02
