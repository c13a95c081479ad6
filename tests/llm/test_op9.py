"""Suffix arrays, and exact removal against a table of all windows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import lyndon, op9_repeats as op


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50))
def test_suffix_array(text):
    text = [*text, 0]
    assert lyndon.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.integers(1, 200), max_size=120))
@settings(max_examples=50, deadline=None)
def test_suffix_array_many_symbols(text):
    text = [*text, *text[:40], 0]
    assert lyndon.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated():
    text = [2, 3, 4, 1, 2, 3, 5, 1, 2, 3, 4, 0]
    assert [sorted(g) for g in lyndon.repeated(text, {0, 4, 8}, 3)] == [[0, 8]]


def brute(rows):
    docs = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}, key=lambda d: d[0])
    seen, out = set(), {}
    for i, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[None if i == -(1 << 63) else i] = (len(raw), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, key int, file string")
    got = op.remove_repeats(docs, **options).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], (r, want[r["doc_id"]])


def rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (10, 30, 60, 25, 100)]
    out = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(shared)
            if rng.random() < 0.4:
                k = rng.randrange(len(passage))
                passage = passage[:k] + rng.choice(["", "z", prose(2)]) + passage[k + rng.randint(0, 3) :]
            parts += [prose(rng.randint(0, 30)), passage[rng.randint(0, 40) :]]
        out.append((i * 3 % 70, "".join(parts)))
    return out


@pytest.mark.parametrize("hot", [op.HOT, 3])
def test_against_all_windows(spark, hot):
    check(spark, rows(hot), hot=hot)


def test_odd_rows(spark):
    text = "".join(random.Random(1).choice("xyz ") for _ in range(300))
    check(spark, [(1, None), (2, ""), (3, "a" * 350), (4, "a" * 99), (5, "a" * 100), (6, "ab" * 200), (7, text), (8, text), (None, text), (8, text), (9, text[:99]), (10, text[1:101]), (11, "é" * 120)])


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 128)
    check_rows = rows(11)[:12]
    found = {}
    for seg in (128, 1 << 22):
        monkeypatch.setattr(op, "SEGMENT", seg)
        a, _, text, first, last, at = op.anchors([t.encode() for _, t in check_rows])
        found[seg] = {(int(t), w, int(p)) for t, f, e, p in zip(text, first, last, at, strict=True) for w in range(f, e + 1)}
    assert found[128] == found[1 << 22]


def test_empty(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
