"""Union, cap and measures over all seven channels, against brute force on a small fixture."""

import json
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.functions import phonetic
from millrace.operators import candidates as C
from millrace.operators import channels as H
from millrace.operators.normalize import normalize
from millrace.sources.staging import staged

NAMES = {"1": "smith", "2": "smyth", "3": "knight", "4": "juniper energy", "5": "phox", "6": "smith", "7": "nite", "8": "faks", "9": "night", "10": "", "11": "smyth", "12": "schmidt"}


def test_all_channels(spark):
    raw = [(i, f"s{1 + (int(i) > 5) + (int(i) > 9)}", n, "", "US") for i, n in NAMES.items()]
    records = staged(normalize(spark.createDataFrame(raw, "entity_id string, src string, business_name string, business_address string, country string")))
    s1, targets = C.parts(records)
    codes = {i: {c for t in n.split() for c in phonetic.codes(t)} for i, n in NAMES.items()}
    a, b = [i for i in NAMES if int(i) <= 5], [i for i in NAMES if int(i) > 5]
    sound = {(x, y) for x, y in product(a, b) if codes[x] & codes[y]}
    votes: dict = {}
    for label in H.LABELS:
        found = {(r["s1_id"], r["target_id"]) for r in H.CHANNELS[label](s1, targets, C.Config()).collect()}
        assert label != "D" or found == sound
        for pair in found:
            votes[pair] = votes.get(pair, 0) + 1
    assert any(votes[p] == 1 for p in sound)  # found by sound only
    union = C.union_hits(C.all_hits(s1, targets))
    assert {(r["s1_id"], r["target_id"]): r["agreement"] for r in union.collect()} == votes
    report = C.run_blocking(records).collect()
    listed = {(r["source1_entity_id"], t) for r in report for t in r["candidate_entity_ids"].split(",") if t}
    assert listed == set(votes) and sum(json.loads(r["channel_tags"])["D"] for r in report) == len(sound)
    two = C.run_blocking(records, sample=2)
    assert {r["source1_entity_id"] for r in two.collect()} == {"1", "2"}


@pytest.mark.parametrize("empty", ["s1", "targets"])
def test_empty_sides(spark, empty):
    records = staged(normalize(spark.createDataFrame([("1", "s2" if empty == "s1" else "s1", "smith", "9 Elm St, Peoria, IL 61602", "US")], "entity_id string, src string, business_name string, business_address string, country string")))
    s1, targets = C.parts(records)
    assert all(H.CHANNELS[label](s1, targets, C.Config()).count() == 0 for label in H.LABELS)
    assert C.run_blocking(records).agg(F.sum("n_candidates")).first()[0] in (0, None)
