"""Command line: python -m millrace.cli normalize | block | evaluate | validate."""

from __future__ import annotations

import argparse
import contextlib
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import candidates, quality, sampling
from millrace.operators.normalize import normalize
from millrace.sources import readers, sinks
from millrace.sources.staging import staged


@contextlib.contextmanager
def timed(label: str):
    """Print how long a step took."""
    began = time.perf_counter()
    yield
    print(f"{label}: {time.perf_counter() - began:.1f} s", flush=True)


def do_normalize(spark: SparkSession, args) -> int:
    """Raw TSV files to the partitioned layout; --sample takes a proportional sample of each source."""
    raw, truth = readers.load_sources(spark, args.train_dir, args.test_dir)
    if args.sample:
        parts: DataFrame | None = None
        for split in ("train", "test"):
            for n in (1, 2, 3):
                part = sampling.stratified_sample(raw.where((F.col("split") == split) & (F.col("src") == f"s{n}")), args.sample)
                parts = part if parts is None else parts.unionByName(part)
        raw = parts
    with timed("normalize"):
        records = staged(normalize(raw, ocr=args.ocr))
    with timed("save"):
        sinks.save_processed(records, args.out, truth)
    return 0


def do_block(spark: SparkSession, args) -> int:
    records = spark.read.parquet(f"{args.root}/stage1").where(F.col("split") == args.split)
    config, hits = candidates.Config(), None
    s1, targets = candidates.parts(records, args.sample)
    for label in candidates.LABELS:
        with timed(f"channel {label}"):
            own = staged(candidates.all_hits(s1, targets, config, (label,)))
        hits = own if hits is None else hits.unionByName(own)
    with timed("cap and report"):
        report = staged(candidates.report(s1, candidates.cap(candidates.union_hits(hits), config), config))
    sinks.save_candidates(report, args.out)
    candidates.blocking_stats(report).show()
    if args.truth:
        n = records.where("src <> 's1'").agg(F.count("*").alias("n"))
        truth = readers.read_tsv(spark, args.truth, readers.TRUTH)
        candidates.completeness(report, truth, n).show()
        candidates.missed_pairs(report, truth).orderBy("s1_id", "target_id").show(5)
    return 0


def do_evaluate(spark: SparkSession, args) -> int:
    rows = [readers.read_tsv(spark, p).withColumn("row", F.monotonically_increasing_id()) for p in (args.candidates, args.truth)]
    candidates.recall_report(rows[0], rows[1], "row").show()
    return 0


def do_validate(spark: SparkSession, args) -> int:
    """Unit tests of the functions; then, of a stored layout, the rules on every partition, coverage and the meta files."""
    if args.unit_only:
        import pytest

        return int(pytest.main(["-q", str(Path(__file__).parent.parent / "tests" / "test_names.py"), str(Path(__file__).parent.parent / "tests" / "test_addresses.py")]))
    records = spark.read.parquet(f"{args.root}/stage1")
    reports = [quality.quality_report(records, ("split", "country_key", "src"))]
    for split in readers.partition_names(spark, f"{args.root}/stage1", "split"):
        whole = None
        for n in (1, 2, 3):
            part = readers.read_tsv(spark, f"{args.root}/stage0/{split}_source{n}", ["entity_id"])
            whole = part if whole is None else whole.unionByName(part)
        gaps = quality.coverage(whole, records.where(F.col("split") == split))
        bad = F.inline(F.array(*[F.struct(F.lit(f"q17_{c}").alias("check"), F.col(c).alias("n_bad"), F.when(F.col(c) > 0, s).otherwise("pass").alias("severity")) for c, s in (("n_missing", "fail"), ("n_extra", "warn"))]))
        reports.append(gaps.select(bad).withColumn("split", F.lit(split)))
    reports.append(quality.meta_report(spark, args.root))
    report = reports[0]
    for more in reports[1:]:
        report = report.unionByName(more, allowMissingColumns=True)
    report = staged(report)
    report.where("severity <> 'pass'").orderBy("check", "split", "country_key", "src").show(100, truncate=False)
    report.groupBy("severity").count().show()
    return quality.verdict(report)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, run, options in (
        ("normalize", do_normalize, (("--train-dir", {}), ("--test-dir", {}), ("--out", {}), ("--sample", {"type": int}), ("--ocr", {"action": "store_true"}))),
        ("block", do_block, (("--root", {}), ("--split", {"default": "test"}), ("--out", {}), ("--sample", {"type": int}), ("--truth", {}))),
        ("evaluate", do_evaluate, (("--candidates", {}), ("--truth", {}))),
        ("validate", do_validate, (("--root", {}), ("--unit-only", {"action": "store_true"}))),
    ):
        part = sub.add_parser(name)
        part.set_defaults(run=run)
        for flag, more in options:
            part.add_argument(flag, **more)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.appName("millrace").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
