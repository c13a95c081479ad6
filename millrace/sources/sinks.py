"""Sinks: TSV, the partitioned layout of normalised records, its summaries, and candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.normalize import COLUMNS

FLAGS = ["entity_id", "country", "script_type", "is_domain_name", "has_address"]


def save_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; booleans as True and False."""
    out = df.select(*[F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])
    out.write.option("sep", "\t").option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def partition_summary(records: DataFrame) -> DataFrame:
    """Rows by split and country, one column a source."""
    country = F.when(F.col("country") == "", F.lit("__unknown__")).otherwise(F.col("country")).alias("country")
    return records.groupBy("split", country).pivot("src", ["s1", "s2", "s3"]).count().fillna(0, ["s1", "s2", "s3"])


def summary_json(records: DataFrame) -> DataFrame:
    """One row a split: split and a JSON object of the counts by country and source."""
    rows = partition_summary(records)
    entry = F.struct("country", F.struct("s1", "s2", "s3"))
    return rows.groupBy("split").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("summary"))


def subgroup_flags(records: DataFrame) -> DataFrame:
    """The flags of every record with the name of its source file."""
    return records.select(*FLAGS, F.concat_ws("_", "split", "src").alias("source_file"))


def subgroup_counts(flags: DataFrame) -> DataFrame:
    """One row: records that are not Latin, lack an address, or have a domain for a name."""
    return flags.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("script_type") != "latin").alias("n_non_latin"),
        F.count_if(~F.col("has_address")).alias("n_missing_address"),
        F.count_if("is_domain_name").alias("n_domain"),
    )


def script_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("script_type").agg(F.count("*").alias("n"))


def save_stage0(records: DataFrame, truth: DataFrame | None, root: str) -> None:
    """stage0: normalised records of each source of each split, before the split by country, and the ground truth, as TSV."""
    for split in ("train", "test"):
        for n in (1, 2, 3):
            rows = records.where((F.col("split") == split) & (F.col("src") == f"s{n}"))
            save_tsv(rows.select(*COLUMNS), f"{root}/stage0/{split}_source{n}")
    if truth is not None:
        save_tsv(truth, f"{root}/stage0/train_ground_truth")


def save_processed(records: DataFrame, root: str, truth: DataFrame | None = None) -> None:
    """stage0, stage1 (partitioned by split, country_key and src), and under meta the summary, the flags and their counts.

    ``records`` is a stored table: it is read several times.  Partitions are balanced at run time, so that a large country
    is several tasks and files.
    """
    save_stage0(records, truth, root)
    balanced = records.hint("rebalance", "split", "country_key", "src")
    balanced.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("split", "country_key", "src").parquet(f"{root}/stage1")
    summary_json(records).coalesce(1).write.mode("overwrite").json(f"{root}/meta/partition_summary")
    save_tsv(subgroup_flags(records), f"{root}/meta/subgroup_flags")


def save_candidates(report: DataFrame, path: str) -> None:
    """The candidate list and, beside it, the list with counts and tags; their names always differ."""
    save_tsv(report.select("source1_entity_id", "candidate_entity_ids"), f"{path}/candidate_pairs")
    save_tsv(report, f"{path}/candidate_pairs_debug")
