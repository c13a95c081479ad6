"""Decontamination on planted passages."""

import random

import pytest

from millrace.llm import op4_decontaminate as op

rng = random.Random(9)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
ITEM = [rng.choice(VOCAB) for _ in range(40)]
SHORT = ["only", "five", "rare", "words", "here"]


def filler(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def changed(words, places):
    return [f"zz{i}" if i in places else w for i, w in enumerate(words)]


CASES = {
    1: (" ".join(filler(50) + ITEM + filler(50)), True),
    2: (" ".join(filler(50) + ITEM[5:25] + filler(50)), True),
    3: (" ".join(filler(9) + changed(ITEM, {4, 9, 17, 23, 31}) + filler(50)).upper(), True),
    4: (", ".join(filler(9)) + " (" + "; ".join(ITEM) + ").", True),
    5: (" ".join(filler(2000)), False),
    6: (" ".join(filler(50) + ITEM[:8] + filler(50)), False),
    7: (None, False),
    8: ("", False),
    9: ("so " + " ".join(SHORT) + " end", True),
    10: (" ".join(filler(20000) + ITEM + filler(20000)), True),
    11: (" ".join(ITEM[:1] * 60), False),
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in CASES.items()] + [(None, CASES[1][0], "en"), (5, CASES[5][0], "en")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (3, " ".join(ITEM)), (8, " ".join(SHORT)), (9, None), (10, "..."), (None, "a b c")], "item_id long, text string")
    return docs, items


def test_overlaps(tables):
    docs, items = tables
    rows = op.overlaps(docs, items).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        assert r["contaminated"] == (CASES[r["doc_id"]][1] if r["doc_id"] else True), r
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["item_id"], by[1]["overlap"], by[1]["matched"]) == (3, 40, 40) and by[3]["matched"] == 35
    assert by[9]["item_id"] == 8 and by[5]["item_id"] is None


def test_filter_and_slices(tables, monkeypatch):
    docs, items = tables
    clean = op.decontaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [5, 5, 6, 7, 8, 11]
    whole = sorted(map(str, op.overlaps(docs, items).collect()))
    monkeypatch.setattr(op, "SLICE", 40)
    assert op.sliced(items)[1] > 2
    assert sorted(map(str, op.overlaps(docs, items).collect())) == whole
    assert sorted(r["doc_id"] for r in op.decontaminated(docs, items).collect()) == [5, 5, 6, 7, 8, 11]


def test_empty(spark, tables):
    docs, items = tables
    assert op.overlaps(docs.limit(0), items).count() == 0
    assert op.overlaps(docs, items.limit(0)).where("contaminated").count() == 0


def test_masks_meet_substitutions():
    """Any 20 words with one substitution in each five share a window under some mask, or nearly so."""
    missed = 0
    for _ in range(400):
        words = [str(rng.random()) for _ in range(24)]
        other = changed(words, set(rng.sample(range(24), 3)))
        missed += op.Tests([1], [" ".join(words)]).best(op.words([" ".join(other).encode()])[0]) is None
    assert missed <= 20


def brute(same, least):
    """(words at least, most equal words) of the stretches that meet the rule, by trying all."""
    all_ = [sum(same[i:j]) for i in range(len(same)) for j in range(i + least, len(same) + 1) if sum(same[i:j]) >= 0.75 * (j - i)]
    return max(all_, default=0)


def test_stretch_is_the_stated_rule():
    """Every stretch of 13 words with 75 % equal counts, wherever its substitutions are, and nothing else does."""
    for trial in range(600):
        n = rng.randint(0, 45)
        same = [rng.random() < rng.choice([0.5, 0.75, 0.9]) for _ in range(n)]
        words, equal = op._stretch(op.np.array(same, bool), 13)
        assert equal == brute(same, 13), (trial, same)
        assert words == 0 if not equal else words >= 13 and equal >= 0.75 * words


def test_substitutions_near_the_ends():
    """13 of 15 words equal, one substitution among the first three and one among the last three."""
    words = [f"w{i}" for i in range(15)]
    tests = op.Tests([1], [" ".join(words)])
    for places in ({1, 13}, {2, 12}, {1, 12}):
        h = op.words([" ".join(filler(9) + changed(words, places) + filler(9)).encode()])[0]
        assert tests.best(h) == (13, 15, 1), places


def test_hits_before_a_verified_stretch():
    """Words 0 to 16 with every fourth replaced, which only later masks hit, before 8 verbatim words that mask 0 hits."""
    words = [f"w{i}" for i in range(60)]
    tests = op.Tests([1], [" ".join(words)])
    h = op.words([" ".join(changed(words, {3, 7, 11, 15, *range(17, 22), *range(30, 60)})).encode()])[0]
    places = [[at for at in range(17) if (op.spaced(h, m, t + 1) == op.spaced(tests.words[0], m, t + 1))[at]] for t, m in enumerate(op.MASKS)]
    assert not places[0] and any(places[1:])
    assert tests.best(h) == (13, 17, 1)


def test_against_brute_force():
    """All diagonals of all pairs, seeds compared word by word: the operator finds these overlaps and no others."""
    few = VOCAB[:40]
    items = [[rng.choice(few) for _ in range(rng.choice([4, 11, 14, 25]))] for _ in range(12)]
    docs = []
    for _ in range(60):
        own = rng.choice(items)
        part = changed(own, set(rng.sample(range(len(own)), rng.randint(0, len(own) // 3))))
        docs.append([rng.choice(few) for _ in range(rng.randint(0, 12))] + part + [rng.choice(few) for _ in range(rng.randint(0, 12))])
    tests = op.Tests(list(range(len(items))), [" ".join(x) for x in items])
    for doc in docs:
        want = None
        for i, item in enumerate(items):
            for diagonal in range(-len(item) + 1, len(doc)):
                a, b = max(0, diagonal), max(0, -diagonal)
                same = [x == y for x, y in zip(doc[a:], item[b:], strict=False)]
                span = min(len(item), 11)
                masks = op.MASKS if len(item) >= 11 else ["1" * span]
                seeded = any(all(same[p + k] for k, c in enumerate(m) if c == "1") for m in masks for p in range(len(same) - span + 1))
                equal = brute(same, min(13, len(item))) if seeded else 0
                if equal:
                    want = max(want or (0, 0), (equal, -i))
        got = tests.best(op.words([" ".join(doc).encode()])[0])
        assert (got and (got[0], -got[2])) == want, doc
        assert bool(tests.best(op.words([" ".join(doc).encode()])[0], first=True)) == bool(want)


def test_long_text_in_segments(monkeypatch):
    text = " ".join(filler(3000) + ["x" * 500] + ITEM + filler(3000)).encode()
    whole = op.words([text, b"", text[:50]])
    monkeypatch.setattr(op.kernels, "SEGMENT", 64)
    parts = op.words([text, b"", text[:50]])
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
