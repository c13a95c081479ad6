"""Connected components, of an edge table or of buckets of candidates, without bringing links or components to the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least node among u and its neighbours (``edges`` holds both directions)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


#: Edges up to which components are found in one task: 16 MB of ids.
FEW = 1 << 20


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b).

    At most ``few`` edges, by count, go through disjoint sets in one task.  More go through alternating large-star and
    small-star steps, each of which ends in a table in the shared folder: the number of rounds is logarithmic in the
    size of a component, and a hub's neighbours meet in a partial aggregate and a join, never in one group.
    """
    edges = store.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    return _in_one_task(edges) if edges.count() <= few else store.stored(_in_rounds(edges), "components")


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        pairs = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches if b.num_rows]
        if pairs:
            nodes, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
            union = Union(range(len(nodes)))
            for i, j in at.reshape(2, -1).T.tolist():
                union.join(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[union.labels()])], names=["node", "component"])

    return store.stored(edges.coalesce(1), "components", run, "node long, component long")


def _in_rounds(edges: DataFrame) -> DataFrame:
    stamp = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
    seen = stamp(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        new = store.stored(small.where("u > v").distinct(), "edges")
        now = stamp(new)
        store.drop(edges)
        edges = new
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


#: Members of a group that are compared in one task; larger groups are compared block by block.
BLOCK = 2048
#: Members up to which buckets that overlap are compared as one group.
MERGED = 8 * BLOCK


def resolve(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], test: Callable[[DataFrame], DataFrame], solve: Callable) -> DataFrame:
    """node, component of the links among members of one bucket; ``rows`` has doc, bucket and the bucket's size n.

    First each bucket is a star: the member that shares most buckets with others is its centre, and ``test`` takes the
    edges (centre, member) and returns a table of those that hold as (a, b).  Copies of one text end here, at one test a copy.
    Buckets that still span several components are open; all their pairs are compared, but inside tasks: open buckets
    that overlap are one group (or, beyond ``MERGED`` members, each bucket is one), groups are dealt in blocks of
    ``BLOCK``, and solve(payloads, components) returns only links that join components, as index pairs.
    ``payload`` adds the column value to rows by their doc.
    """
    score = rows.groupBy("doc").agg(F.sum("n").alias("score"))
    rows = store.stored(rows.select("doc", "bucket").join(score, "doc"), "buckets")
    best = rows.groupBy("bucket").agg(F.max(F.struct("score", F.bitwise_not("doc").alias("inverse"))).alias("top"))
    best = best.select("bucket", F.bitwise_not("top.inverse").alias("centre"))
    edges = rows.join(best, "bucket").where("doc <> centre").select("centre", F.col("doc").alias("member")).distinct()
    found = test(edges)
    comps = components(found)
    held = rows.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "bucket", F.coalesce("component", "doc").alias("own"))
    spread = held.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n"), F.min("doc").alias("least"))
    wide = spread.where(F.col("low") < F.col("high")).where("n > 2").select("bucket", "least")
    held = store.stored(held.join(wide, "bucket"), "open")
    if held.isEmpty():
        return comps
    groups = components(held.select(F.col("doc").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    merged = held.select("doc", "own").distinct().join(groups, "doc")
    sizes = merged.groupBy("group").agg(F.count("*").alias("n"))
    small = merged.join(sizes.where(F.col("n") <= MERGED), "group")
    large = held.join(groups.join(sizes.where(F.col("n") > MERGED), "group").select("doc").distinct(), "doc", "left_semi")
    by_bucket = large.groupBy("bucket").agg(F.count("*").alias("n"))
    large = large.join(by_bucket, "bucket").select("doc", "own", F.col("bucket").alias("group"), "n")
    more = compared(small.select("doc", "own", "group", "n").unionByName(large), payload, solve)
    return components(found.unionByName(more))


#: Bytes of a block's payloads.
HELD = 1 << 24
#: Parts in which a group meets its number of blocks, so that a hot group's payloads aren't one task.
SALTS = 64


def compared(members: DataFrame, payload: Callable[[DataFrame], DataFrame], solve: Callable) -> DataFrame:
    """A table of the links (a, b) found by ``solve`` in each pair of blocks of each group; members: group, doc, own, n (the group's size).

    A block has at most about ``BLOCK`` members and ``HELD`` bytes.  Members of groups of several blocks are written to a
    table partitioned by block; a task of a pair of blocks gets their names and loads the two.  So a group of many blocks
    multiplies rows of names and reads, not shuffled payloads.
    """
    spark = members.sparkSession
    rows = payload(members.select("group", "doc", "own")).withColumn("bytes", F.length("value"))
    rows = store.stored(rows, "members")  # payloads are shuffled once
    size = rows.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / HELD)).cast("int").alias("blocks"))
    large = size.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(large, ["group", "salt"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    few, several = rows.where("blocks is null"), rows.where("blocks is not null")
    path = store.new_path(spark, "block-files")
    pairs = None
    if not several.isEmpty():
        name = F.xxhash64("group", "block").alias("name")
        store.write_parts(several.select("doc", "own", "value", name).repartition("name").sortWithinPartitions("name"), path, by="name")
        one = several.select("group", "block").distinct()
        other = one.select(F.col("group").alias("g"), F.col("block").alias("b"))
        both = one.join(other, (F.col("group") == F.col("g")) & (F.col("block") <= F.col("b")))
        pairs = both.select(F.xxhash64("group", "block").alias("i"), F.xxhash64("g", "b").alias("j")).repartition("i", "j")
    few = few.select("group", "doc", "own", "value").repartition("group").sortWithinPartitions("group", "doc")

    def found(held: list[tuple]):
        import pyarrow as pa

        links = solve([v for _, _, v in held], [o for _, o, _ in held]) if len({o for _, o, _ in held}) > 1 else []
        a, b = ([held[p[k]][0] for p in links] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def within(batches):
        key, held = None, []
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != key:
                    if held:
                        yield found(held)
                    key, held = group, []
                held.append(tuple(row))
        if held:
            yield found(held)

    def across(batches):
        def block(name: int) -> list[tuple]:
            from pyarrow import dataset

            files, top = store.filesystem(path)
            table = dataset.dataset(f"{top}/name={name}", filesystem=files, format="parquet").to_table(columns=["doc", "own", "value"])
            return sorted(zip(*(table.column(c).to_pylist() for c in ("doc", "own", "value")), strict=True))

        for batch in batches:
            for i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield found(block(i) if i == j else block(i) + block(j))

    links = store.stored(few, "links", within, "a long, b long")
    return links if pairs is None else links.unionByName(store.stored(pairs, "links", across, "a long, b long"))


class Union:
    """Disjoint sets over 0 .. n - 1, started from component labels."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> list[int]:
        return [self.top(i) for i in range(len(self.up))]
