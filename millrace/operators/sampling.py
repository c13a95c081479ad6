"""Proportional samples by country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def country_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("country", F.lit(MISSING)).alias("country")).agg(F.count("*").alias("n"))


def sample_targets(counts: DataFrame, sample_size: int) -> DataFrame:
    """country, target: largest-remainder shares of the sample; ties by name, zero shares left out."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = counts.withColumn("total", F.sum("n").over(whole))
    size = F.least(F.lit(sample_size), F.col("total"))
    rows = rows.withColumns({"raw": F.col("n") / F.col("total") * size, "size": size}).withColumn("base", F.floor("raw"))
    rows = rows.withColumn("left", F.col("size") - F.sum("base").over(whole))
    order = Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), "country")
    target = F.col("base") + (F.row_number().over(order) <= F.col("left")).cast("long")
    return rows.select("country", target.cast("long").alias("target")).where("target > 0")


def stratified_sample(df: DataFrame, sample_size: int, id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """``df`` cut to each country's share, by the order of a seeded hash: the same rows on every run.

    A country's rows below a bound on the hash, chosen so that about twice its share and 64 rows pass, are ranked; only
    where fewer than the share pass (by chance, or with many equal ids) are all its rows.  So no task sorts a country.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    rows = df.withColumns({"_c": F.coalesce("country", F.lit(MISSING)), "_h": key})
    counts = country_counts(df)
    targets = sample_targets(counts, sample_size).join(counts, "country")
    share = F.least(F.lit(1.0), (2 * F.col("target") + 64) / F.col("n"))
    bounds = targets.select(F.col("country").alias("_c"), F.col("target").alias("_target"), F.lpad(F.hex(F.floor(share * F.lit(float(1 << 48))).cast("long")), 13, "0").alias("_bound"))
    near = rows.join(bounds, "_c").withColumn("_p", F.concat(F.lit("0"), F.upper(F.substring("_h", 1, 12))))
    passed = near.where(F.col("_p") < F.col("_bound"))
    short = passed.groupBy("_c").agg(F.count("*").alias("_n"))
    short = bounds.join(short, "_c", "left").where(F.coalesce("_n", F.lit(0)) < F.col("_target")).select("_c")
    rest = near.where(F.col("_p") >= F.col("_bound")).join(short, "_c", "left_semi")
    order = Window.partitionBy("_c").orderBy("_h", id_col)
    kept = passed.unionByName(rest).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_target"))
    return kept.select(*df.columns).orderBy(F.md5(F.col(id_col).cast("string")))
