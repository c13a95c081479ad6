"""Data-quality rules over normalised records, as one aggregate, and coverage between two tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.constants import SCRIPTS, SUFFIX_REMOVE
from millrace.functions.names import ASCII, tokens
from millrace.operators.normalize import COLUMNS

#: What script_type may be.
SCRIPT_TYPES = ["latin", "mixed", *SCRIPTS]


def broken() -> dict[str, tuple[str, Column]]:
    """rule: (severity when broken, whether a record breaks it)."""
    legal = F.array(*[F.lit(s) for s in SUFFIX_REMOVE])
    words, latin = tokens(F.col("name_no_suffix")), F.col("script_type") == "latin"
    has, only = F.arrays_overlap(words, legal), F.size(F.array_except(words, legal)) == 0
    ordered = tokens(F.col("name_sorted"))
    country = F.lower(F.col("country"))
    return {
        "q04_name_sorted_order": ("fail", F.array_sort(ordered) != ordered),
        "q05_first2_length": ("fail", F.size(tokens(F.col("name_first2"))) > 2),
        "q06_suffix_survivors": ("fail", latin & has & ~only),
        "q06_suffix_only_names": ("warn", latin & has & only),
        "q07_ascii_transliterated": ("fail", ~F.col("name_transliterated").rlike(ASCII)),
        "q08_ascii_transliterated_no_suffix": ("fail", ~F.col("name_transliterated_no_suffix").rlike(ASCII)),
        "q09_indic_sorted_empty": ("fail", ~latin & (F.col("name_sorted") == "")),
        "q10_locality_ascii_tokens": ("fail", ~F.col("locality_tokens").rlike(ASCII)),
        "q11_has_address_domain": ("fail", ~F.lower(F.col("has_address").cast("string")).isin("true", "false") | F.col("has_address").isNull()),
        "q12_pin_format": ("fail", (country == "india") & (F.col("pin_code") != "") & ~F.col("pin_code").rlike(r"^[1-9]\d{5}$")),
        "q13_zip_format": ("fail", (country == "us") & (F.col("zip_code") != "") & ~F.col("zip_code").rlike(r"^\d{5}(?:-\d{4})?$")),
        "q14_script_enum": ("fail", ~F.coalesce(F.col("script_type"), F.lit("")).isin(SCRIPT_TYPES)),
        "q15_name_full_separators": ("fail", F.col("name_full").rlike("[|,]")),
        "q16_ascii_address": ("fail", ~F.col("address_transliterated").rlike(ASCII)),
    }


def quality_report(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """check, n_bad, severity (pass, warn, fail) and sample (the least and the greatest id of the offenders) of every rule,
    for each group ``by``; one pass over the records, and one for repeated ids."""
    missing = [c for c in COLUMNS if c not in records.columns]
    checks = broken() if not missing else {}
    hit = {n: F.coalesce(c, F.lit(False)) for n, (_, c) in checks.items()}
    number = {n: F.count_if(c) for n, c in hit.items()}
    if hit:
        odd = F.size(F.filter(tokens(F.col("locality_tokens")), lambda t: ~t.rlike(ASCII)))
        number["q10_locality_ascii_tokens"] = F.coalesce(F.sum(odd), F.lit(0))
    lists = {n: extreme_ids(F.when(c, F.col("entity_id"))) for n, c in hit.items()}
    aggs = [F.count("*").cast("long").alias("q02_rows"), *[c.cast("long").alias(n) for n, c in number.items()], *[c.alias(f"{n}_sample") for n, c in lists.items()]]
    wide = records.groupBy(*by).agg(*aggs)
    if hit:
        twice = records.where("entity_id is not null").groupBy(*by, "entity_id").agg(F.count("*").alias("n"))
        twice = twice.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("q03_duplicate_ids"), extreme_ids(F.when(F.col("n") > 1, F.col("entity_id"))).alias("q03_sample"))
        wide = wide.join(twice, list(by), "left") if by else wide.join(F.broadcast(twice))
    none = F.array().cast("array<string>")

    def entry(name: str, bad: Column, when: str, sample: Column = none) -> Column:
        bad = F.coalesce(bad.cast("long"), F.lit(0).cast("long"))
        return F.struct(F.lit(name).alias("check"), bad.alias("n_bad"), F.when(bad > 0, F.lit(when)).otherwise(F.lit("pass")).alias("severity"), F.coalesce(sample, none).alias("sample"))

    rows = [entry("q01_missing_columns", F.lit(len(missing)), "fail", F.array(*[F.lit(c) for c in missing]).cast("array<string>")), entry("q02_no_rows", (F.col("q02_rows") == 0).cast("long"), "warn")]
    if hit:
        rows.append(entry("q03_duplicate_ids", F.col("q03_duplicate_ids"), "fail", F.col("q03_sample")))
    rows += [entry(n, F.col(n), s, F.col(f"{n}_sample")) for n, (s, _) in checks.items()]
    return wide.select(*by, F.inline(F.array(*rows)))


def extreme_ids(key: Column) -> Column:
    """The least and the greatest id of the offenders: two values a buffer, however many there are."""
    return F.array_distinct(F.array_compact(F.array(F.min(key), F.max(key))))


def coverage(left: DataFrame, right: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row: keys of ``left`` missing on the right, and keys of ``right`` that the left doesn't have."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    missing, extra = a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
    return missing.agg(F.count("*").alias("n_missing")).join(F.broadcast(extra.agg(F.count("*").alias("n_extra"))))


def verdict(report: DataFrame) -> int:
    """Exit code: 1 if any rule fails."""
    return int(not report.where("severity = 'fail'").isEmpty())


def meta_report(spark: SparkSession, root: str) -> DataFrame:
    """Whether the files below ``root``/meta can be read: check, n_bad, severity, sample (what was found or went wrong)."""
    rows = []
    for name, path, read in (
        ("partition_summary", f"{root}/meta/partition_summary", lambda p: spark.read.schema("split string, summary string").option("mode", "FAILFAST").json(p)),
        ("subgroup_flags", f"{root}/meta/subgroup_flags", lambda p: spark.read.option("sep", "\t").option("header", True).csv(p)),
    ):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            rows.append((f"q19_{name}", 1, "warn", [f"not found: {path}"]))
            continue
        try:
            table = read(path)
            n = table.count() if name != "partition_summary" else len([json.loads(r["summary"]) for r in table.collect()])  # a row a split
            rows.append((f"q19_{name}", 0, "pass", [f"{n} rows", *table.columns]))
        except Exception as error:  # any unreadable file is a finding
            rows.append((f"q19_{name}", 1, "fail", [str(error).splitlines()[0]]))
    return spark.createDataFrame(rows, "check string, n_bad long, severity string, sample array<string>")
