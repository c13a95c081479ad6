"""Union of channels, the ranked cap, the candidate report, and its quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.constants import CHANNEL_PRIORITY, Config
from millrace.operators import pairing
from millrace.operators.channels import CHANNELS, LABELS


def all_hits(s1: DataFrame, targets: DataFrame, config: Config = Config(), channels: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """PAIR and channel for every channel's hits."""
    out = None
    for label in channels:
        hits = CHANNELS[label](s1, targets, config).withColumn("channel", F.lit(label))
        out = hits if out is None else out.unionByName(hits)
    return out


def union_hits(hits: DataFrame) -> DataFrame:
    """country_key, s1_id, target_id, has_A .. has_G, agreement, priority; both target sources together."""
    flags = [F.max((F.col("channel") == c).cast("int")).alias(f"has_{c}") for c in LABELS]
    out = hits.groupBy("country_key", "s1_id", "target_id").agg(*flags)
    first = F.lit(0)
    for i, c in enumerate(reversed(CHANNEL_PRIORITY), 1):
        first = F.when(F.col(f"has_{c}") == 1, i).otherwise(first)
    return out.withColumns({"agreement": sum(F.col(f"has_{c}") for c in LABELS), "priority": first})


def cap(union: DataFrame, config: Config = Config()) -> DataFrame:
    """The best ``max_candidates`` of each entity by (agreement, priority, id), with rank and n (candidates before the cap)."""
    entity = Window.partitionBy("country_key", "s1_id")
    best = entity.orderBy(F.desc("agreement"), F.desc("priority"), "target_id")
    sizes = union.groupBy("country_key", "s1_id").agg(F.count("*").alias("n"))
    kept = union.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.max_candidates)
    return kept.join(sizes, ["country_key", "s1_id"])


def report(s1: DataFrame, kept: DataFrame, config: Config = Config()) -> DataFrame:
    """One row an S1 record: candidate ids by comma, their number, and how many of them each channel found, as JSON.

    Lists within the cap are in order of id; those that were cut are in order of rank.
    """
    order = F.when(F.col("n") <= config.max_candidates, F.lit(0)).otherwise(F.col("rank"))
    counts = [F.sum(f"has_{c}").alias(c) for c in LABELS]
    lists = kept.groupBy("country_key", "s1_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "target_id"))).alias("list"), *counts)
    rows = s1.select("country_key", F.col("entity_id").alias("s1_id")).join(lists, ["country_key", "s1_id"], "left")
    ids = F.coalesce(F.col("list.target_id"), F.array().cast("array<string>"))
    tags = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in LABELS]))
    return rows.select(F.col("s1_id").alias("source1_entity_id"), F.array_join(ids, ",").alias("candidate_entity_ids"), F.size(ids).cast("long").alias("n_candidates"), tags.alias("channel_tags"))


def parts(records: DataFrame, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(S1 records, targets).  sample: the first so many S1 records of each country."""
    s1 = records.where("src = 's1'")
    if sample is not None:
        first = Window.partitionBy("country_key").orderBy("entity_id")
        s1 = s1.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample).drop("_n")
    return s1, records.where("src <> 's1'")


def run_blocking(records: DataFrame, config: Config = Config(), sample: int | None = None, channels: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """The report over normalised records (src s1, s2, s3), read from a table or staged: every channel scans them.

    sample: the first so many S1 records of each country.
    """
    s1, targets = parts(records, sample)
    return report(s1, pairing.best_pairs(s1, targets, config, channels), config)


def blocking_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("n_candidates") == 0).alias("n_empty"),
        F.round(F.avg("n_candidates"), 6).alias("avg_candidates"),
        F.max("n_candidates").alias("max_candidates"),
    )


def listed_pairs(rows: DataFrame, ids: str) -> DataFrame:
    """Distinct (s1_id, target_id) of a table with comma lists."""
    split = F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ","))
    pairs = rows.select(F.trim("source1_entity_id").alias("s1_id"), split.alias("target_id")).withColumn("target_id", F.trim("target_id"))
    return pairs.where("target_id <> ''").distinct()


def completeness(rows: DataFrame, truth: DataFrame, n_targets: DataFrame) -> DataFrame:
    """One row: pairs_completeness, reduction_ratio, true_pairs, covered_pairs, missed_pairs; null ratios without truth.

    n_targets: one row with n, the target records of all countries.
    """
    true, found = listed_pairs(truth, "matched_entity_ids"), listed_pairs(rows, "candidate_entity_ids")
    hit = true.join(found.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    a = hit.agg(F.count("*").alias("true_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("covered_pairs"))
    b = found.agg(F.count("*").alias("found"))
    c = rows.agg(F.count("*").alias("n_s1"))
    one = a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(n_targets.select(F.col("n").alias("n_targets"))))
    return one.select(
        F.round(F.col("covered_pairs") / F.nullif("true_pairs", F.lit(0)), 9).alias("pairs_completeness"),
        F.round(1 - F.col("found") / F.greatest(F.col("n_s1") * F.col("n_targets"), F.lit(1)), 9).alias("reduction_ratio"),
        "true_pairs",
        "covered_pairs",
        (F.col("true_pairs") - F.col("covered_pairs")).alias("missed_pairs"),
    )


def missed_pairs(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs that no list holds."""
    return listed_pairs(truth, "matched_entity_ids").join(listed_pairs(rows, "candidate_entity_ids"), ["s1_id", "target_id"], "left_anti")


def recall_report(rows: DataFrame, truth: DataFrame, order: str) -> DataFrame:
    """One row: entities, matched entities, true and found pairs, recall.  Of rows that repeat an entity the last counts,
    by the column ``order``."""

    def last(df: DataFrame, ids: str) -> DataFrame:
        key = F.trim("source1_entity_id")
        return df.groupBy(key.alias("source1_entity_id")).agg(F.max_by(ids, order).alias(ids))

    true, found = listed_pairs(last(truth, "matched_entity_ids"), "matched_entity_ids"), listed_pairs(last(rows, "candidate_entity_ids"), "candidate_entity_ids")
    hit = true.join(found.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    a = hit.agg(F.countDistinct("s1_id").alias("n_matched_entities"), F.count("*").alias("true_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found_pairs"))
    n = truth.agg(F.countDistinct(F.trim("source1_entity_id")).alias("n_entities"))
    return a.join(F.broadcast(n)).select("n_entities", "n_matched_entities", "true_pairs", "found_pairs", F.round(F.col("found_pairs") / F.nullif("true_pairs", F.lit(0)), 9).alias("recall"))
