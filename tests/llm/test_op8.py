"""Mixing against a plain computation."""

import random
import re

import pytest

from millrace.llm import op8_mixing as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(t):
    return len(WORD.findall(t or ""))


def targets(rows):
    """Rounds of resharing by weight until no source is above its cap."""
    own = {}
    for _, s, t in rows:
        own[s] = own.get(s, 0) + size(t)
    order = sorted(own, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, free = dict.fromkeys(own, 0.0), 1.5 * sum(own.values()), set(own)
    while left > 1e-9 and free:
        whole, share = sum(weight[s] for s in free), left
        left = 0.0
        for s in list(free):
            out[s] += share * weight[s] / whole
            if out[s] >= 2 * own[s]:
                left += out[s] - 2 * own[s]
                out[s] = 2.0 * own[s]
                free.discard(s)
    return own, out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, rng.choice(["b", "b", "b", "a", "é", "Z", None, "one"]), " ".join("w" * rng.randint(1, 30) for _ in range(rng.choice([0, 3, 40])))) for i in range(300)]
    return out + [(1000, "solo", "x " * 5000), (1001, "a", None), (None, "b", "a b c"), (5, "b", "same same"), (5, "b", "same same"), (1002, "nil", None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, source string, text string, size int, key string")


def test_targets_and_takes(spark, rows):
    own, want = targets(rows)
    got = op.plan_mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == own[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
    key = lambda r: (str(r["doc_id"]), r["key"], r["taken"])
    again = op.plan_mix(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions(spark, rows):
    """Positions invert the integral of each source's schedule, and each source fills [0, 1]."""
    for r in op.schedule(frame(spark, rows)).collect():
        t, a = r["position"], r["slope"]
        x = r["copy"] * r["source_size"] + r["place"]
        assert 0 <= t <= 1 and abs(r["target"] * ((1 - a) * t + a * t * t) - x) < 1e-6 * max(1, r["target"])


def test_mixed_documents(spark, rows):
    docs = frame(spark, rows)
    mixed = op.mixed_documents(docs)
    assert mixed.columns == docs.columns
    own, want = targets(rows)
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + size(r["text"])
    for s, t in want.items():
        assert abs(words.get(s, 0) - t) <= 0.5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert op.plan_mix(docs).count() == 0 and op.mixed_documents(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    assert op.plan_mix(blank).first()["taken"] == 0


def test_uncut(spark, rows):
    """Every text is as it was, and each source ends at most half a document from its target."""
    docs = [(1, "solo", "a\nb\tc  d\n" * 500), (2, "other", "x y\nz " * 900), *[(10 + i, "many", f"p{i} q\nr") for i in range(50)]]
    own, want = targets(docs)
    texts = {r[0]: r[2] for r in docs}
    words = {}
    for r in op.mixed_documents(frame(spark, docs), uncut=True).collect():
        assert r["text"] == texts[r["doc_id"]]
        words[r["source"]] = words.get(r["source"], 0) + size(r["text"])
    for s, t in want.items():
        assert abs(words.get(s, 0) - t) <= max(size(r[2]) for r in docs if r[1] == s) / 2 + 0.5
