"""Mixing sources to target weights by a time-varying curriculum.

Each source i has a target of T_i words and a weight schedule over training time t in [0, 1], linear with slope
a_i in [-1, 1]: w_i(t) = T_i * (1 - a_i + 2 * a_i * t).  Its integral D_i(t) = T_i * ((1 - a_i) * t + a_i * t**2) is
the cumulative demand.  A source's documents stand in the order of a seeded hash and form a stream of words, read
again from the start when it ends; a document whose copy starts at word x of the stream gets position
t = D_i^-1(x), and the schedule is range-sorted by position.  The stream ends at T_i: the last copy is cut there,
so the words taken from a source differ from its target by rounding only.

The place of a document in its stream is a prefix sum in two steps, so that a source with a third of all rows is
no single task: sums of hash ranges of a source, whose number grows with the rows (``BUCKET_ROWS`` each, if one source
had all), then sums within a range.  The only table of one task has a row
for each source.  All of it is DataFrame operations.

Null text has size 0 and is never taken.  A null source is a source of its own, ordered last.  Repeated rows are
documents of their own, and equal keys are ordered by doc_id.  Words of a very long text are counted in the JVM.
Other columns, clashing names included, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (0.5, 0.0, -0.5)
#: Rows of a hash range, and the least number of ranges of a source as a power of two.
BUCKET_ROWS, BUCKET_BITS = 1 << 16, 10


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle(values, rank) -> F.Column:
    """values[rank % len(values)]"""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, slope: the demand ``share`` x all sizes, split by weight, at most ``cap`` x own size.

    Resharing the excess until no source is above its cap ends where every target is min(cap_i, level * w_i).  With
    the sources in order of cap_i / w_i the level is found by prefix sums.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("rank", F.row_number().over(every) - 1)
    out = out.withColumn("weight", cycle(weights, F.col("rank"))).withColumn("slope", cycle(slopes, F.col("rank")))
    out = out.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("demand", F.sum("source_size").over(whole) * F.lit(float(share)))
    level = (F.col("demand") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level)
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(whole)
    out = out.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return out.select("source", "source_size", F.least("most", target).alias("target"), "slope")


def time_of(x, target, slope) -> F.Column:
    """The t with D(t) = x: the root of slope * t^2 + (1 - slope) * t - x / target, in a form stable near slope 0."""
    u, b = x / target, 1 - slope
    return F.least(F.lit(1.0), 2 * u / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * slope * u))))


def mix_key(seed: int) -> F.Column:
    """The seeded hash that orders a source's documents."""
    return F.xxhash64(F.col("doc_id"), F.lit(seed), F.col("text"))


def plan_mix(docs: DataFrame, seed: int = 8, **targets) -> DataFrame:
    """doc_id and source of ``docs`` with key, size, source_size, target, slope, place (first word's place in the
    source's stream), whole (full copies) and taken (words taken from all copies)."""
    size, key = F.col("size"), F.col("key")
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(seed).alias("key"))
    base = store.materialise(base, "mix")
    targets_df = source_targets(base.select("source", "size"), **targets).withColumnRenamed("source", "s")
    bits = max(BUCKET_BITS, (base.count() // BUCKET_ROWS).bit_length())
    bucket = F.shiftright(key, 64 - bits)
    sums = base.groupBy("source", bucket.alias("bucket")).agg(F.sum(size).alias("sum"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(order), F.lit(0)).alias("before"))
    sums = sums.join(targets_df.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    rows = base.withColumn("bucket", bucket)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.col("before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    words, own = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.withColumn("words", words).withColumn("whole", F.expr("words div greatest(source_size, 1)"))
    rest = F.least(size, F.greatest(F.lit(0), F.col("words") - F.col("whole") * own - F.col("place")))
    return rows.withColumn("rest", rest).withColumn("taken", F.col("whole") * size + rest).drop("bucket", "before")


def schedule(docs: DataFrame, **options) -> DataFrame:
    """One row for each copy that is taken: the columns of ``plan_mix``, copy, copy_words (taken from it) and position."""
    rows = plan_mix(docs, **options).where("taken > 0")
    copies = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))
    rows = rows.withColumn("copy", F.explode(copies))
    rows = rows.withColumn("copy_words", F.when(F.col("copy") < F.col("whole"), F.col("size")).otherwise(F.col("rest")))
    start = F.col("copy") * F.col("source_size") + F.col("place")
    return rows.withColumn("position", time_of(start, F.col("target"), F.col("slope")))


def mixed_documents(docs: DataFrame, seed: int = 8, uncut: bool = False, **options) -> DataFrame:
    """The documents as the mix takes them, range-sorted by position, with their own columns: a document taken twice is
    two rows, and a copy that the mix cuts holds its first words only.  uncut: such a copy is taken whole, or not at all
    if that is nearer to the source's target; all texts then are as they were.

    Copies are planned on sizes alone and meet the texts once, by doc_id and key; rows that repeat both are told apart
    by a number that is only computed where there are any.
    """
    columns = docs.columns
    plan = schedule(docs, seed=seed, **options).select("doc_id", "key", "source", "place", "copy", "copy_words", "size", "position")
    if uncut:
        plan = plan.where("2 * copy_words >= size").withColumn("copy_words", F.col("size"))
    plan = store.materialise(plan, "schedule")
    rows = docs.select(F.col("doc_id").alias("_id"), mix_key(seed).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    if not plan.groupBy("doc_id", "key", "copy").count().where("count > 1").isEmpty():
        mine = Window.partitionBy("_id", "_key").orderBy(F.col("_row.source"), F.xxhash64("_row"))
        theirs = Window.partitionBy("doc_id", "key", "copy").orderBy("source", "place")
        rows, plan = rows.withColumn("_n", F.row_number().over(mine)), plan.withColumn("n", F.row_number().over(theirs))
        same = same & (F.col("_n") == F.col("n"))
    rows = rows.join(plan, same)
    text = F.when(F.col("copy_words") >= F.col("size"), F.col("_row.text")).otherwise(first_words(F.col("_row.text"), F.col("copy_words")))
    rows = rows.withColumn("_text", text).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")
    return rows.select(*[F.col("_text" if c == "text" else f"_row.`{c}`").alias(c) for c in columns])


def first_words(text, n) -> F.Column:
    """The first n words, joined by single blanks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, range-sorted by each document's first position (documents not taken come last)."""
    rows = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.when(F.col("taken") > 0, time_of(F.col("place"), F.col("target"), F.col("slope")))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(first, F.lit(2.0)).alias("position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")

