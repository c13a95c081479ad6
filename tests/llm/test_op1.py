"""Neighbours against brute force."""

import numpy as np

from millrace.llm import op1_neighbours as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def search(spark, rows, k=5, schema=SCHEMA, query=lambda i: i % 50 == 0):
    out = {}
    for r in op.nearest(spark.createDataFrame(rows, schema), query, k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def brute(rows, q, k=5):
    x = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    cos = sorted(((-float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), i) for i in x if i != q))[:k]
    return [i for _, i in cos], [-c for c, _ in cos]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 24))
    rows = [(i, [float(v) for v in (centres[i % 6] if i % 2 else 0) + rng.standard_normal(24) * 0.6], 0) for i in range(1500)]
    got = search(spark, rows)
    assert sorted(got) == list(range(0, 1500, 50))
    hit = 0
    for q, found in got.items():
        ids, scores = brute(rows, q)
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        hit += len({v for _, v, _ in found} & set(ids))
        for _, v, s in found:
            if v in ids:
                assert abs(s - scores[ids.index(v)]) < 1e-12
    assert hit >= 0.9 * 5 * len(got)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0, 2.0], 0) for i in range(120)] + [(200, [0.0, 1.0, 0.0], 0)]
    got = search(spark, rows)
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for _, v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [v for _, v, _ in got[200]] == [0, 1, 2, 3, 4]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 1.0], 0), (50, None, 0), (100, [0.0, 0.0], 0), (150, [None, 1.0], 0), (1, [float("nan"), 1.0], 0), (2, [float("inf"), 1.0], 0), (3, [1.0, 0.5], 0), (4, [], 0), (5, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (0, [1.0, 1.0], 0)]
    assert [(q, [v for _, v, _ in f]) for q, f in search(spark, rows).items()] == [(0, [3])]


def test_empty_and_extra_columns(spark):
    assert search(spark, []) == {}
    rows = [(i, [1.0, float(i)], 0, "x", 1) for i in range(3)]
    assert search(spark, rows, schema=SCHEMA + ", vec string, score int")[0][0][1] == 1


def test_stopping_value():
    assert abs(op.chi_square_cdf(op.critical(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(op.critical(0.95, 8) - 15.507) < 1e-2


def test_many_leaves_blocks_and_stopping(spark):
    """16 leaves or more, several blocks a leaf, far fewer points verified than there are, and recall against brute force."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32)) * 2
    x = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 32)) * 0.5).astype(np.float32)
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)
    rows = op.nearest(table, lambda i: i % 50 == 0, leaf_rows=128, block_bytes=64 * 8 * (32 + op.PROJECTED)).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 4000, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        hit += len({r["vec_id"] for r in rows if r["query_id"] == q} & set(np.argsort(-cos, kind="stable")[:5].tolist()))
    assert hit >= 0.9 * 5 * 80
    verified = {r["query_id"]: r["verified"] for r in rows}
    assert len(verified) == 80 and sum(verified.values()) < 0.3 * 80 * 4000


def test_a_search_stops():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32))
    x[:50] = x[0] + rng.standard_normal((50, 32)) * 0.05
    block = op.Block([[i] for i in range(2000)], x, 24)
    found, verified = block.search(x[0], op.project(x[:1], 24)[0], 6, -1.0, op.critical(0.95, 24))
    assert {i for _, i in found} <= set(range(50)) and verified <= 200
