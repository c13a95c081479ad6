"""Approximate nearest neighbours by low-dimensional stable projections.

A Gaussian (2-stable) map takes unit vectors to ``PROJECTED`` dimensions, where the squared projected distance of two
points over their squared true distance follows a chi-square law.  The projections are indexed by a kd-tree.  A query
meets projected points nearest first, point by point, and verifies each by its true cosine; it stops when the chi-square
test says that a point nearer than the worst of its k best would have been met by now with probability ``CONFIDENCE`` at
least.  Nothing else ends a search: there is no cap on candidates.  The column ``verified`` counts the verified classes.

The tree has two levels.  Its top is fitted on a bounded sample (projections of ``SAMPLE`` vectors) and cuts the space
into leaves of about ``LEAF`` rows, ``LEAVES`` at most; every vector is put into its leaf, and leaves are dealt into
blocks of at most about ``BYTES`` by a hash, so that a crowded leaf is many tasks.  A block builds a small kd-tree of its
own rows.  First each query searches one block of its own leaf, for a bound; then it searches every block whose leaf's
box (bounds of all its rows) passes the stopping test.  Queries meet blocks in groups of at most about ``QUERIES`` rows.
The boxes are broadcast: at most ``LEAVES`` rows.  Where neighbours are far (as in data of high intrinsic dimension) few
boxes are ruled out, and the work is then a share of queries times vectors, which the README gives.

Equal vectors are one class, of which only the k + 1 least ids can be among anyone's k nearest; classes are reduced to
these before any search, and equal queries are searched once.  Ties go to the smaller id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another length
than the most frequent one; rows with null ids neither.  A repeated id counts once, with its least vector in array
order.  With no other candidates a query has fewer than k rows, or none.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

PROJECTED, CONFIDENCE = 24, 0.95
SAMPLE, LEAVES, LEAF, QUERIES = 65_536, 16_384, 16_384, 1024
#: Bytes of a block's vectors and projections in memory.
BYTES = 1 << 25
LOCAL = 32


def chi_square_cdf(x: float, m: int) -> float:
    """Of m degrees of freedom, m even."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def critical(confidence: float, m: int) -> float:
    """The x where the distribution reaches ``confidence``."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < confidence else (low, mid)
    return high


def projector(dim: int, m: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def project(x: np.ndarray, m: int) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ projector(x.shape[1], m)


def fit(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and value of each inner node of a full kd-tree of 2**depth leaves, in heap order."""
    dims, values = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    part = {0: points}
    for node in range((1 << depth) - 1):
        own = part.pop(node)
        if len(own):
            dims[node] = np.argmax(own.max(0) - own.min(0))
            values[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] > values[node]
        part[2 * node + 1], part[2 * node + 2] = own[~right], own[right]
    return dims, values


def leaf_of(p: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dims, values = tree
    node = np.zeros(len(p), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (p[np.arange(len(p)), dims[node]] > values[node])
    return node - len(dims)


class Block:
    """The vectors of one block with a kd-tree of their projections: ranges of ``LOCAL`` points and their boxes."""

    def __init__(self, ids: list[list[int]], x: np.ndarray, m: int):
        p = project(x, m)
        parts = [np.arange(len(p))]
        while len(parts[0]) > LOCAL:
            nxt = []
            for part in parts:
                own = p[part]
                d = np.argmax(own.max(0) - own.min(0))
                half = len(part) // 2
                order = np.argpartition(own[:, d], half)
                nxt += [part[order[:half]], part[order[half:]]]
            parts = nxt
        order = np.concatenate(parts)
        self.ids, self.x = [ids[i] for i in order], x[order]
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.ends = np.cumsum([len(q) for q in parts])
        self.starts = self.ends - [len(q) for q in parts]
        self.p = p = p[order]
        self.low, self.high = np.minimum.reduceat(p, self.starts), np.maximum.reduceat(p, self.starts)

    def search(self, q: np.ndarray, pq: np.ndarray, k: int, worst: float, stop: float) -> tuple[list[tuple[float, int]], int]:
        """Up to k (cosine, id) of this block that matter, best first, and how many points were verified.

        worst: the k-th best cosine known.  Points come in the order of projected distance; their ranges' boxes rule out
        most of those that the first bound excludes.
        """
        reach = lambda w: stop * max(0.0, 2 - 2 * w) + 1e-12
        gap = np.maximum(0, np.maximum(self.low - pq, pq - self.high))
        close = np.flatnonzero((gap * gap).sum(1) < reach(worst))
        if not len(close):
            return [], 0
        rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in close]) if len(close) < len(self.ends) else np.arange(len(self.p))
        d = ((self.p[rows] - pq) ** 2).sum(1)
        within = d < reach(worst)
        rows, d = rows[within], d[within]
        order = np.argsort(d, kind="stable")
        rows, d = rows[order], d[order]
        best: list[tuple[float, int]] = []
        norm, at, step = math.sqrt(float(q @ q)), 0, 64
        while at < len(rows) and d[at] < reach(worst):
            own = rows[at : at + step]
            cos = (self.x[own] * q).sum(1) / (self.norm[own] * norm)
            floor = max(worst, best[-1][0]) if len(best) == k else worst
            hit = np.flatnonzero(cos >= floor)
            if len(hit) > k:
                hit = hit[cos[hit] >= np.partition(cos[hit], len(hit) - k)[len(hit) - k]]
            best = sorted({(float(cos[i]), v) for i in hit for v in self.ids[own[i]]} | set(best), key=lambda s: (-s[0], s[1]))[:k]
            worst = max(worst, best[-1][0]) if len(best) == k else worst
            at, step = at + len(own), min(step * 2, 1024)
        return best, at


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    ok = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(ok)
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (common[0]["n"] if common else 0))


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def nearest(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", m: int = PROJECTED, confidence: float = CONFIDENCE, leaf_rows: int = LEAF, block_bytes: int = BYTES
) -> DataFrame:
    """query_id, rank, id, score, verified: the k rows of greatest cosine found for each row whose id passes ``is_query``."""
    spark, keep, stop = vectors.sparkSession, k + 1, critical(confidence, m)
    rows = usable(vectors, id_col, vec_col)
    rows = store.materialise(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    least = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= keep)
    classes = store.materialise(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    total = classes.count()
    depth = max(0, min(LEAVES, total // leaf_rows).bit_length() - 1)

    def projected(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"p": list(project(matrix(f["vec"]), m)), "h": f["h"]})

    sample = classes.select("vec", F.xxhash64("vec").alias("h")).mapInPandas(projected, "p array<double>, h long") if depth else None
    tree = fit(matrix(sample.orderBy("h").limit(SAMPLE).toPandas()["p"]), depth) if depth else (np.zeros(0, np.int64), np.zeros(0))

    def placed(frames):
        for f in frames:
            if len(f):
                p = project(matrix(f["vec"]), m)
                yield f.assign(leaf=leaf_of(p, tree), p=list(p))

    classes = store.materialise(classes.mapInPandas(placed, "vec array<double>, ids array<long>, leaf long, p array<double>"), "leaves")
    sides = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(m) for n, f in (("low", F.min), ("high", F.max))]
    boxes = classes.groupBy("leaf").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), *sides).orderBy("leaf").toPandas()
    low, high = (boxes[[f"{side}{i}" for i in range(m)]].to_numpy(np.float64) for side in ("low", "high"))
    block = max(LOCAL, block_bytes // (8 * (int(boxes["dim"].max()) + m))) if total else LOCAL
    leaves, subs = boxes["leaf"].to_numpy(np.int64), np.maximum(1, -(-boxes["n"].to_numpy(np.int64) // block))
    sub_of = dict(zip(leaves.tolist(), subs.tolist(), strict=True))
    shared = spark.sparkContext.broadcast((leaves, subs, low, high, sub_of))

    asked = rows.where(is_query(F.col("id")))
    queries = asked.groupBy("vec").agg(F.min("id").alias("query"))
    members = store.materialise(asked.join(queries, "vec").select("id", "query"), "members")
    queries = store.materialise(queries, "queries")

    def start(frames):
        for f in frames:
            if len(f):
                p = project(matrix(f["vec"]), m)
                leaf = leaf_of(p, tree)
                own = shared.value
                known = np.isin(leaf, own[0])
                gap = np.stack([(np.maximum(0, np.maximum(own[2] - x, x - own[3])) ** 2).sum(1).argmin() for x in p])
                leaf = np.where(known, leaf, own[0][gap])
                sub = [int(q) % own[4][int(i)] for q, i in zip(f["query"], leaf, strict=True)]
                yield pd.DataFrame({"query": f["query"], "worst": -1.0, "leaf": leaf, "sub": sub})

    asks_schema = "query long, worst double, leaf long, sub long"
    found_schema = "query long, ids array<long>, scores array<double>, verified long"

    def meet(asks: DataFrame) -> DataFrame:
        """Search each ask (query, worst, leaf, sub) in its block; one row an ask.  Vectors join asks here only."""
        counts = asks.groupBy("leaf", "sub").count().select("leaf", "sub", F.ceil(F.col("count") / QUERIES).cast("int").alias("groups"))
        sized = spark.createDataFrame(list(zip(leaves.tolist(), subs.tolist(), strict=True)), "leaf long, subs long")
        blocks = classes.join(F.broadcast(sized), "leaf").withColumn("sub", F.pmod(F.xxhash64("ids"), F.col("subs")))
        blocks = blocks.join(counts, ["leaf", "sub"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        asks = asks.join(counts, ["leaf", "sub"]).withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).join(queries, "query")
        keys = ["leaf", "sub", "group"]

        def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": a["query"], "ids": [[] for _ in a.index], "scores": [[] for _ in a.index], "verified": 0})
            block, q = Block([list(x) for x in b["ids"]], matrix(b["vec"]), m), matrix(a["vec"])
            found = [block.search(x, p, keep, w, stop) for x, p, w in zip(q, project(q, m), a["worst"].tolist(), strict=True)]
            return pd.DataFrame({"query": a["query"], "ids": [[v for _, v in r] for r, _ in found], "scores": [[s for s, _ in r] for r, _ in found], "verified": [n for _, n in found]})

        return asks.groupBy(*keys).cogroup(blocks.select(*keys, "ids", "vec").groupBy(*keys)).applyInPandas(both, found_schema)

    opening = store.materialise(queries.mapInPandas(start, asks_schema), "asks")
    first_found = store.materialise(meet(opening), "found")
    bound = F.when(F.size("scores") >= keep, F.element_at("scores", -1)).otherwise(-1.0)
    second = opening.drop("worst").join(first_found.select("query", bound.alias("worst")), "query").join(queries, "query")

    def further(frames):
        for f in frames:
            own = shared.value
            out = []
            for q, worst, leaf, sub, p in zip(f["query"], f["worst"], f["leaf"], f["sub"], project(matrix(f["vec"]), m) if len(f) else [], strict=True):
                gap = np.maximum(0, np.maximum(own[2] - p, p - own[3]))
                for i in np.flatnonzero((gap * gap).sum(1) < stop * max(0.0, 2 - 2 * worst) + 1e-12):
                    out += [(q, worst, int(own[0][i]), s) for s in range(int(own[1][i])) if (own[0][i], s) != (leaf, sub)]
                if len(out) >= 100_000:
                    yield pd.DataFrame(out, columns=["query", "worst", "leaf", "sub"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["query", "worst", "leaf", "sub"])

    asks = store.materialise(second.mapInPandas(further, asks_schema), "asks")
    found = store.materialise(first_found.unionByName(meet(asks)), "found")
    verified = found.groupBy("query").agg(F.sum("verified").alias("verified"))
    hits = found.select("query", F.explode(F.arrays_zip("scores", "ids")).alias("hit"))
    hits = hits.select("query", F.col("hit.scores").alias("score"), F.col("hit.ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")
    pairs = members.join(hits, "query").join(verified, "query").where("vec_id <> id")
    ranked = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return pairs.select(F.col("id").alias("query_id"), "rank", "vec_id", "score", "verified")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
