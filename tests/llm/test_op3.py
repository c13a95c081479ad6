"""Line dedup against all pairs."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import op3_lines as op

BLANK = " \t\r\x0b\x0c"


def points(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé", min_size=6, max_size=30), st.text("abé", min_size=6, max_size=30)), min_size=1, max_size=20), st.integers(1, 3))
def test_distances(pairs, edits):
    got = op.distances([(points(a), points(b)) for a, b in pairs], edits).tolist()
    assert got == [min(edits + 1, edit(a, b)) for a, b in pairs]


def test_every_near_pair_shares_a_key():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(24, 60)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        b = "".join(b)
        if len(b) < 24 or edit(a, b) > 2:
            continue
        lines = op.Lines([a, b])
        line, key, index = op.keys_of(lines.prefix, lines.start, lines.end)
        of = lambda n, i: set(key[(line == n) & (index == i)].tolist())
        assert of(0, True) & of(1, False) or of(1, True) & of(0, False), (a, b)


def brute(rows, edits=2, least=24):
    """doc_id: (lines, removed, hash) by all pairs of distinct lines."""
    docs = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}, key=lambda d: d[0])
    lines = sorted({x.strip(BLANK) for _, t in docs for x in t.split("\n") if x.strip(BLANK)})
    up = {x: x for x in lines}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edit(a, b) <= edits:
                up[top(a)] = top(b)
    seen, out = set(), {}
    for i, t in docs:
        kept, n, gone, spans = [], 0, 0, t.split("\n")
        for k, x in enumerate(spans):
            s = x.strip(BLANK)
            n += bool(s)
            if s and top(s) in seen:
                gone += 1
                continue
            seen |= {top(s)} if s else set()
            kept.append(x + ("\n" if k < len(spans) - 1 else ""))
        out[None if i == -(1 << 63) else i] = (n, gone, hashlib.sha256("".join(kept).encode()).hexdigest())
    return out


def check(spark, rows, schema="doc_id long, text string, line string"):
    got = [(r["doc_id"], (r["n_lines"], r["n_removed"], r["kept_sha256"])) for r in op.dedup_lines(spark.createDataFrame(rows, schema)).collect()]
    want = brute([r[:2] for r in rows])
    assert len(got) == len(rows) and all(want[i] == v for i, v in got), ([g for g in got if want[g[0]] != g[1]], want)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 50))).strip() or "x" for _ in range(12)]

    def changed(s):
        b = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i] = rng.choice("xyz")
        return "".join(b)

    rows = [(i, "\n".join(rng.choice(["", "  ", "ü"]) if rng.random() < 0.1 else changed(rng.choice(base)) for _ in range(6)), "l") for i in range(60)]
    rows += [(100, None, "l"), (101, "", "l"), (102, "\n\n", "l"), (103, "a\na\n a \nb", "l"), (None, base[0], "l"), (104, "x" * 3000 + "\n" + "x" * 3001, "l"), (0, rows[0][1], "l")]
    check(spark, rows)


def test_empty(spark):
    assert op.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
