"""Components by both ways, and bucket resolution, against disjoint sets."""

import random

import pytest

from millrace.llm.components import Union, components


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    rng = random.Random(4)
    nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(120)]
    edges = [(nodes[i], nodes[rng.randrange(max(0, i - 3), i)]) for i in range(1, 120) if i % 10] + [(nodes[0], nodes[0])]
    up = Union(range(120))
    for a, b in edges:
        up.join(nodes.index(a), nodes.index(b))
    groups = {}
    for i, n in enumerate(nodes):
        groups.setdefault(up.top(i), []).append(n)
    want = {n: min(g) for g in groups.values() if len(g) > 1 for n in g}
    got = components(spark.createDataFrame(edges, "a long, b long"), few).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0
