"""MinHash near-dedup with min-max hashing.

A document's set is its distinct word shingles.  Under each of ``BANDS * ROWS / 2`` permutations both the least and the
greatest hash of the set are kept: half the hash evaluations for as many values, each an unbiased similarity sign.  The
values are banded (``BANDS`` bands of ``ROWS``; a band never holds both values of one permutation).  At similarity 0.8
two sets share no band with probability 3e-6.

Documents with equal sets are one class, found by a 128-bit fingerprint, and only its first document goes on.  Classes
are numbered as their table is written, so a class needs no id of its own.  Classes that share a band value form a bucket.  The member that shares most values with others is a bucket's centre, and all
members are tested against it, so a group of copies costs one test a copy.  Where buckets still span several
components, all their pairs are compared inside tasks, in blocks, by exact counts of shared shingles
(``components.resolve``); only links that join components leave a task.  Tests compare the full sets: members travel
to (centre, salt) groups of bounded size and are streamed past the centre's set.

A document is a doc_id with a text, told apart by a 128-bit hash of the text: rows that repeat an id with different texts
are documents of their own, rows that repeat both are one document, and each such row is returned.  A null doc_id is
an id that comes last; a component without any other id is null.  Within an id the least hash of the text comes first.
Texts without words, and null texts, have an empty set, are linked with nothing and are all kept.  A very long text is
hashed in segments, and its set is 8 bytes a shingle.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels, store
from .components import Union, resolve

BANDS, ROWS = 32, 5
#: Members that one group tests against a centre.
GROUP = 512
SIGNED = "doc_id long, key struct<a: long, b: long>, n_shingles long, fp binary, bands array<long>"


def min_max(sets: list[np.ndarray], seed: int = 5, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes (set x band) of non-empty sets."""
    half = bands * rows // 2
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least, most = np.empty((half, len(sets)), np.uint64), np.empty((half, len(sets)), np.uint64)
    for i, a in enumerate(kernels.seeds(half, seed)):
        h = flat * a
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least[i], most[i] = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
    values = np.concatenate((least, most)).reshape(bands, rows, len(sets))
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, len(sets))).copy()
    for r in range(rows):
        out = kernels.mix(out * np.uint64(kernels.BASE) + values[:, r])
    return out.T


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, fp (fingerprint of the set), bands (null for empty sets) of every row."""
    store.arrow_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, prints, bands = [], [], []
            group, held = [], 0

            def flush():
                full = [s for s in group if len(s)]
                rows = iter(min_max(full).astype(np.int64)) if full else iter(())
                bands.extend(next(rows) if len(s) else None for s in group)
                group.clear()

            for s in kernels.shingle_sets(batch.column(1).to_pylist(), shingle):
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                group.append(s)
                held += len(s)
                if held > 1 << 17:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInArrow(run, SIGNED)


def text_key() -> F.Column:
    """128 bits that tell the texts of an id apart, and order them."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def tested(edges: DataFrame, with_text: Callable[[DataFrame], DataFrame], shingle: int, percent: int) -> DataFrame:
    """The edges (centre, member) whose full sets have 100 * shared >= percent * union."""
    counts = edges.groupBy("centre").count().select("centre", F.ceil(F.col("count") / GROUP).cast("int").alias("groups"))
    members = edges.join(counts, "centre").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("groups")).cast("int"))
    members = members.select("centre", "salt", F.lit(1).alias("side"), F.col("member").alias("doc"))
    centres = counts.select("centre", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("centre").alias("doc"))
    rows = with_text(members.unionByName(centres)).select("centre", "salt", "side", "doc", "value")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "side")

    def run(batches):
        import pyarrow as pa

        centre, own = None, np.empty(0, np.uint64)
        for batch in batches:
            head, side, doc, texts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            out: list[tuple[int, int]] = []
            for c, s, d, x in zip(head, side, doc, kernels.shingle_sets(texts, shingle), strict=True):
                if s == 0:
                    centre, own = c, x
                    continue
                assert c == centre
                shared = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(x) - shared):
                    out.append((c, d))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return store.stored(rows, "links", run, "a long, b long")


def links(classes: DataFrame, with_text: Callable[[DataFrame], DataFrame], shingle: int, percent: int) -> DataFrame:
    """node, component over ``classes`` (node, bands); nodes without a link are left out.

    ``with_text`` adds value, the text of the class doc, to rows.
    """
    rows = classes.select(F.col("node").alias("doc"), F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")

    def solve(texts: list, owners: list) -> list[tuple[int, int]]:
        return joining_pairs(list(kernels.shingle_sets(texts, shingle)), owners, percent)

    return resolve(rows.join(sizes, "bucket"), with_text, lambda edges: tested(edges, with_text, shingle, percent), solve)


def joining_pairs(sets: list[np.ndarray], owners: list, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets at ``percent`` similarity or more that join the owners' components; every pair is compared.

    Intersections are counted exactly: shingles that many sets hold by a product of 0/1 matrices, the others by the
    pairs of sets that hold them.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    times = np.diff([*starts.tolist(), len(flat)])
    shared = np.zeros((n, n), np.float32)
    common = np.flatnonzero(times > 32)
    for c in range(0, len(common), 1024):
        part = common[c : c + 1024]
        ones = np.zeros((n, len(part)), np.float32)
        for k, p in enumerate(part.tolist()):
            ones[row[starts[p] : starts[p] + times[p]], k] = 1
        shared += ones @ ones.T
    for t in np.unique(times[(times > 1) & (times <= 32)]).tolist():
        at = starts[times == t]
        members = row[at[:, None] + np.arange(t)]
        for i in range(t):
            for j in range(i + 1, t):
                np.add.at(shared, (members[:, i], members[:, j]), 1)
                np.add.at(shared, (members[:, j], members[:, i]), 1)
    size = np.array([len(s) for s in sets], np.float64)
    union, out = Union(owners), []
    for i in range(n):
        near = np.flatnonzero(100 * shared[i, i + 1 :].astype(np.float64) >= percent * (size[i] + size[i + 1 :] - shared[i, i + 1 :])) + i + 1
        out += [(i, j) for j in near.tolist() if union.join(i, j)]
    return out


def _is(doc_id: str, key: str) -> F.Column:
    """Whether the document (doc_id, key) of a row is that of two other columns."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("key") == F.col(key))


def judged(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id, kept of every row."""
    rows = store.materialise(signatures(docs, shingle), "signatures")
    worded = rows.where("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = worded.groupBy("fp", "n_shingles").agg(F.min(F.struct(first.alias("first"), "bands")).alias("s"))
    classes = classes.select("fp", "s.first", "s.bands", F.monotonically_increasing_id().alias("node"))
    classes = store.materialise(classes, "classes")  # the numbers are read from the table from here on

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    repeated = worded.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    if not repeated.isEmpty():  # of rows that repeat id and text one text is enough
        again = texts.join(repeated, _is("d", "k"), "left_semi").dropDuplicates(["doc_id", "key"])
        texts = texts.join(repeated, _is("d", "k"), "left_anti").unionByName(again)
    names = classes.select(F.col("node").alias("doc"), F.col("first.doc_id").alias("d"), F.col("first.key").alias("k"))

    def with_text(some: DataFrame) -> DataFrame:
        return some.join(names, "doc").join(texts.withColumnRenamed("text", "value"), _is("d", "k")).drop("d", "k", "doc_id", "key")

    comps = links(classes, with_text, shingle, percent)
    of_class = classes.select("node", "fp", "first").join(comps, "node", "left")
    tops = of_class.where("component is not null").groupBy("component").agg(F.min("first").alias("top"))
    of_class = of_class.join(tops, "component", "left").select(F.col("fp").alias("f"), F.coalesce("top", "first").alias("top"))
    out = rows.join(of_class, F.col("fp") == F.col("f"), "left")
    component = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), (F.col("top").isNull() | _is("top.doc_id", "top.key")).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: components of the links at ``percent`` similarity or more."""
    return judged(docs, shingle, percent).drop("key")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, with their own columns; of rows that repeat id and text one stays.

    Rows without words all stay.
    """
    kept = judged(docs, shingle, percent).where("kept").groupBy(F.col("doc_id").alias("_millrace_id"), F.col("key").alias("_millrace_kept"))
    kept = store.materialise(kept.agg(F.count_if(F.col("n_shingles") > 0).alias("times")), "kept")
    again = kept.where("times > 1")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_millrace_id")) & (F.col("_millrace_key") == F.col("_millrace_kept"))
    rows = docs.withColumn("_millrace_key", text_key()).join(kept, own, "left_semi")
    if not again.isEmpty():  # only repeated rows are ranked
        order = Window.partitionBy("doc_id", "_millrace_key").orderBy(F.xxhash64(F.to_json(F.struct("*"))))
        one = rows.join(again, own, "left_semi").withColumn("_millrace_n", F.row_number().over(order)).where("_millrace_n = 1").drop("_millrace_n")
        rows = rows.join(again, own, "left_anti").unionByName(one)
    return rows.drop("_millrace_key")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at 80 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
