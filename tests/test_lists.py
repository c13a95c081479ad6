"""Channels whose result is a list of pairs: pairs are made in tasks and leave as lists of targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import candidates as C
from millrace.operators import channels as H
from millrace.operators import pairing as P
from millrace.operators.normalize import normalize
from millrace.sources.staging import staged


@pytest.fixture(scope="module")
def sides(spark):
    raw = [(str(i), f"s{1 + i % 3}", f"wren{i % 5} heron{i % 7} é{i % 2} tern{i}", "", "US" if i % 4 else "Côte d'Ivoire / x=1") for i in range(150)]
    return C.parts(staged(normalize(spark.createDataFrame(raw, "entity_id string, src string, business_name string, business_address string, country string"))))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def shuffles_pairs(df):
    """Whether anything is moved or joined once pairs are made in tasks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" not in plan or any(x in plan.split("MapInArrow")[0] for x in ("Exchange", "Join", "HashAggregate"))


def by_key(q, t, on):
    return q.join(t, ["country_key", *on]).select(*H.PAIR).distinct()


def test_channel_c(sides):
    q, t, names = H.names_and_bands(*sides, H.Config())
    names = names.select("name", F.inline("bands"))
    found = H.channel_c(*sides)
    assert not shuffles_pairs(found)
    assert rows(found) == rows(by_key(q.join(names, "name"), t.join(names, "name"), ["band", "key"])) != []


@pytest.mark.parametrize("n", [2, 3])
def test_gram_codes(spark, n):
    names = ["a", "ab", "wren é", "नगर x", "𝒳yz w"]
    codes, starts = H.gram_codes(names, n)
    s = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").select("i", H.windows(F.replace("x", F.lit(" "), F.lit("_")), n).alias("g")).orderBy("i").collect()
    want = []
    for r in s:
        for g in r["g"]:
            code = 0
            for k in range(n):
                code = (code * 1114112 + (ord(g[k]) if k < len(g) else 0)) % H.PRIME
            want.append(code)
    assert codes.tolist() == want and starts.tolist() == np.cumsum([0, *(len(r["g"]) for r in s[:-1])]).tolist()


def test_channel_b(sides):
    config = H.Config(idf_floor=1.5)
    q, t = H.sides(*sides, lambda df: [F.explode(H.name_tokens(df)).alias("token")])
    rare = H.token_weights(sides[1]).where(f"idf >= {config.idf_floor}").select("country_key", "src", "token")
    found = H.channel_b(*sides, config)
    assert not shuffles_pairs(found)
    assert rows(found) == rows(by_key(q, t.join(rare, ["country_key", "src", "token"]), ["token"])) != []
    twice = q.join(t.join(rare, ["country_key", "src", "token"]), ["country_key", "token"]).groupBy(*H.PAIR).count().where("count > 1").select(*H.PAIR)
    assert rows(H.channel_b(*sides, H.Config(idf_floor=1.5, min_overlap=2))) == rows(twice) != []


def test_lists_of_targets(sides, monkeypatch):
    """Few large groups are many tasks, and a row is a query with all it finds by the same channels."""
    monkeypatch.setattr(P, "LISTING", 5)
    keys = P.entity_keys(*sides, H.Config(), ("B", "G"), ["country_key"])
    assert P.blocks(keys, ["country_key"], P.LISTING).select("country_key", "block").distinct().count() > 8
    lists = P.scored(keys, ["country_key"], None)
    pairs = [(*r[:2], t, r["found"]) for r in lists.collect() for t in r["target_ids"]]
    assert rows(P.listed(lists).select("country_key", "s1_id", "target_id", "found")) == sorted(pairs)
    assert lists.count() * 2 < len(pairs) == len(set(p[:3] for p in pairs))
