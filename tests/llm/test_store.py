"""Tables that Python workers write."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.llm import op3_lines, store


def files_below(top):
    return [os.path.join(d, x) for d, _, names in os.walk(top) for x in names]


def test_op3_writes_no_table_by_hadoop(spark, tmp_path, monkeypatch):
    """Hadoop's local files have a checksum file beside them, and a process is started for each to set its mode."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(8)]
    rows = [(i, "\n".join(rng.choice(base)[: rng.randint(37, 40)] for _ in range(5))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{shared}")
    assert op3_lines.op3_lines(spark, f"file://{tmp_path}").agg(F.sum("n_removed")).first()[0] > 100
    found = files_below(shared)
    assert len(found) > 5 and not [x for x in found if not x.endswith(".parquet")]


def test_types_nulls_and_row_groups(spark, monkeypatch):
    monkeypatch.setattr(store, "GROUP_ROWS", 7)
    df = spark.range(0, 50, 1, 3).select(
        "id", F.col("id").cast("int").alias("i"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 3 > 0, F.array("id", F.lit(None))).alias("a"), F.struct(F.lit("é").alias("x"), "id").alias("t"), F.lit(b"\x00\xff").alias("b"),
    )
    got = store.stored(df, "types")
    assert got.dtypes == df.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert store.stored(df.where("id < 0"), "none").count() == 0


def test_folders(spark):
    path = store.new_path(spark, "folders")
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(13)).alias("k"), "id")
    store.write_parts(df.repartition(3, "k").sortWithinPartitions("k"), path, by="k")
    assert sorted(spark.read.parquet(path).select("k", "id").collect()) == sorted(df.collect())
    assert len({os.path.basename(os.path.dirname(x)) for x in files_below(path.removeprefix("file://"))}) == 13


def test_only_attempts_that_succeed_count(spark):
    """What a lost attempt has written is not in the table, and a step that fails is an error."""
    path = store.new_path(spark, "attempts")

    def lost(batches):
        from pyarrow import parquet, table

        files, top = store.filesystem(f"{path}-attempts")
        parquet.write_table(table({"id": [-1]}), f"{top}/{uuid.uuid4().hex}.parquet", filesystem=files)
        yield from batches

    store.write_parts(spark.range(20), path, lost)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == list(range(20))

    def broken(batches):
        yield from batches
        raise ValueError("broken step")

    with pytest.raises(Exception, match="broken step"):
        store.write_parts(spark.range(20), store.new_path(spark, "broken"), broken)
