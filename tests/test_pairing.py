"""Pairs in blocks against brute force, and the report without lists of pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import candidates as C
from millrace.operators import channels as H
from millrace.operators import pairing as P
from millrace.operators.normalize import normalize
from millrace.sources.staging import staged


@pytest.mark.parametrize("most", [None, 3])
def test_blocks(monkeypatch, most):
    monkeypatch.setattr(P, "PASSING", 7)
    rng = np.random.default_rng(5)
    make = lambda n: [np.unique(rng.integers(0, 60, rng.integers(0, 9)) * rng.integers(1, 3) * 8 + rng.integers(0, 7)) for _ in range(n)]
    asks, targets = make(40), make(200)
    ids = [f"{i:03}" for i in range(200)]
    flat = lambda lists: (np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]))
    queries = P.Queries(pa.array([str(i) for i in range(40)]), *flat(asks), most)
    got = [r for i in range(0, 200, 70) for r in queries.meet(pa.array(ids[i : i + 70]), *flat(targets[i : i + 70]))]
    got = [(int(q), t, int(f)) for r in (got if most is None else queries.kept()) for q, t, f in zip(r[0].to_pylist(), r[1].to_pylist(), r[2], strict=True)]
    every = [(i, ids[j], sum({1 << int(k & 7) for k in set(a.tolist()) & set(b.tolist())})) for i, a in enumerate(asks) for j, b in enumerate(targets)]
    every = [p for p in every if p[2]]
    if most is not None:
        ranked = sorted(every, key=lambda p: (p[0], -int(P.scores()[p[2]]), p[1]))
        assert queries.n.tolist() == [sum(p[0] == i for p in every) for i in range(40)]
        every = [p for i in range(40) for p in [p for p in ranked if p[0] == i][:most]]
    assert sorted(got) == sorted(every) and len(every) > 50


def test_report_lists_no_pairs(spark, monkeypatch):
    raw = [(str(i), f"s{1 + i % 3}", "wren heron ltd" if i % 4 else f"moss {i} tern", "9 Elm St, Peoria, IL 61602", "US") for i in range(120)]
    records = staged(normalize(spark.createDataFrame(raw, "entity_id string, src string, business_name string, business_address string, country string")))
    config = P.Config(max_candidates=20)
    s1, targets = C.parts(records)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    plain = rows(C.report(s1, C.cap(C.union_hits(C.all_hits(s1, targets, config)), config), config))

    def listed(*_):
        raise AssertionError("a list of pairs")

    for label in "ABCDG":
        monkeypatch.setitem(H.CHANNELS, label, listed)
    assert rows(C.run_blocking(records, config)) == plain and {r[2] for r in plain} == {20}


def test_targets_are_not_copied(spark, monkeypatch):
    """Many blocks of queries: the rows that are shuffled are the queries, and the targets are stored once."""
    monkeypatch.setattr(P, "HELD", 5)
    raw = [(str(i), f"s{1 + i % 3}", f"wren{i % 5} heron{i % 7} é{i % 2}", "", "US" if i % 4 else "Côte d'Ivoire / x=1") for i in range(150)]
    records = staged(normalize(spark.createDataFrame(raw, "entity_id string, src string, business_name string, business_address string, country string")))
    config = P.Config(max_candidates=6)
    s1, targets = C.parts(records)
    labels = ("B", "D", "G")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for by in (["country_key"], ["country_key", "src"]):
        keys = P.entity_keys(s1, targets, config, labels, by)
        asked = keys.where("side = 0").count()
        assert P.blocks(keys, by).count() == asked and P.blocks(keys, by).select(*by, "block").distinct().count() > 8
        assert spark.read.parquet(P.stored_targets(keys, by)).count() == keys.where("side = 1").count()
    union = C.union_hits(C.all_hits(s1, targets, config, labels))
    names = union.columns
    assert rows(P.all_pairs(s1, targets, config, labels).select(*names)) == rows(union) != []
    best = C.cap(union, config)
    assert rows(P.best_pairs(s1, targets, config, labels).select(*best.columns)) == rows(best)


def test_grams_and_weights(spark):
    words = ["a", "é", "wren", "ab", "नगर", "o-ne"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, x string").select("i", H.char_grams(F.col("x"), 2, 4).alias("g")).orderBy("i").collect()
    assert [sorted(r["g"]) for r in rows] == [sorted(H.word_grams(w, 2, 4)) for w in words]
    weights = H.Weights([" a", "ab"], np.array([5, 9]), np.array([2.0, 1.0]))
    ids, grams, w, sizes = weights.of(["p", "q", "r"], [["ab ab"], ["zz"], ["a", "c"]], H.Config())
    assert (ids, grams.tolist(), sizes.tolist()) == (["p", "r"], [5, 9, 5], [2, 1])
    assert np.allclose(w, [2 / 5**0.5, 1 / 5**0.5, 1])
