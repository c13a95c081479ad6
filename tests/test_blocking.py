"""Channels, cap, measures, sampling and quality rules on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.constants import Config
from millrace.operators import candidates as C
from millrace.operators import channels as H
from millrace.operators import quality, sampling
from millrace.operators.normalize import COLUMNS, normalize
from millrace.sources import readers, sinks
from millrace.sources.staging import staged

FIELDS = ["entity_id", "src", "country_key", "name_no_suffix", "name_sorted", "name_first2", "name_transliterated_no_suffix", "pin_code", "zip_code", "street_num", "locality_tokens", "state_token", "address_transliterated", "has_address"]


def table(spark, *rows):
    return spark.createDataFrame([tuple({"country_key": "us", "src": "s2", "has_address": "True"}.get(f, "") if f not in r else r[f] for f in FIELDS) for r in rows], ", ".join(f"{f} string" for f in FIELDS))


def name(i, n, **more):
    return {"entity_id": i, "name_no_suffix": n, "name_transliterated_no_suffix": n, "name_sorted": " ".join(sorted(set(n.split()))), "name_first2": " ".join(n.split()[:2]), **more}


def found(df):
    return {(r["s1_id"], r["target_id"]) for r in df.collect()}


def test_channel_a(spark):
    target = table(spark, {"entity_id": "A1", "pin_code": "422001", "street_num": "5", "locality_tokens": "kothrud nagar"})
    s1 = table(spark, {"entity_id": "p", "pin_code": "422001"}, {"entity_id": "s", "street_num": "5", "locality_tokens": "Kothrud main"}, {"entity_id": "f", "locality_tokens": "kothrud x"}, {"entity_id": "n", "pin_code": "422001", "has_address": "False"}, {"entity_id": "o", "pin_code": "422001", "country_key": "fr"})
    strong = H.channel_a_strong(s1, target)
    assert found(strong) == {("p", "A1"), ("s", "A1")}
    assert found(H.channel_a_fallback(s1, target, strong)) == {("f", "A1")}


def test_channel_b(spark):
    target = table(spark, name("X1", "heron mill paper"), name("X2", "heron coast"), *[name(f"d{i}", f"filler entry {i}") for i in range(10)])
    s1 = table(spark, name("q", "heron mill"))
    assert found(H.channel_b(s1, target)) == {("q", "X1")}
    few = table(spark, name("X1", "heron mill paper"))
    assert found(H.channel_b(s1, few)) == set()


def test_similar_channels(spark):
    target = table(spark, name("M1", "juniper gale dynamo"), name("P1", "smith lumber"), name("F1", "marlin harbor ferry"), name("G1", "alder wren"))
    s1 = table(spark, name("c", "juniper gale dynamos"), name("d", "smyth quarry"), name("e", "marlin harbor boats"), name("g", "wren alder"), name("z", "quite unlike"))
    assert ("c", "M1") in found(H.channel_c(s1, target))
    assert ("d", "P1") in found(H.channel_d(s1, target))
    assert {("e", "F1"), ("c", "M1"), ("g", "G1")} <= found(H.channel_e(s1, target))
    assert found(H.channel_g(s1, target)) == {("g", "G1")}


def test_char_grams(spark):
    row = spark.createDataFrame([("ab c",)], "x string").select(H.char_grams(F.col("x"), 2, 4).alias("g")).first()
    assert sorted(row["g"]) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def hits(spark, rows):
    return spark.createDataFrame([("us", "s2", "q", t, c) for t, c in rows], "country_key string, src string, s1_id string, target_id string, channel string")


def test_cap(spark):
    union = C.union_hits(hits(spark, [("E1", "A"), ("E2", "A"), ("E1", "B"), ("E3", "B"), ("E2", "C"), ("E1", "E"), ("E1", "G")]))
    s1 = spark.createDataFrame([("us", "q"), ("us", "lonely")], "country_key string, entity_id string")
    for most, ids in ((2, "E1,E2"), (80, "E1,E2,E3")):
        config = Config(max_candidates=most)
        rows = {r["source1_entity_id"]: r for r in C.report(s1, C.cap(union, config), config).collect()}
        assert rows["q"]["candidate_entity_ids"] == ids
        assert (rows["lonely"]["candidate_entity_ids"], rows["lonely"]["n_candidates"]) == ("", 0)
        assert json.loads(rows["q"]["channel_tags"]) == {"A": 2, "B": 1 + (most > 2), "C": 1, "D": 0, "E": 1, "F": 0, "G": 1}


def test_measures(spark):
    rows = spark.createDataFrame([("s1", "t1,t9"), ("s2", "")], "source1_entity_id string, candidate_entity_ids string")
    truth = spark.createDataFrame([("s1", "t1,t2"), ("s3", "")], "source1_entity_id string, matched_entity_ids string")
    n = spark.createDataFrame([(10,)], "n long")
    got = C.completeness(rows, truth, n).first()
    assert tuple(got) == (0.5, 0.9, 2, 1, 1)
    assert found(C.missed_pairs(rows, truth)) == {("s1", "t2")}
    twice = truth.unionByName(spark.createDataFrame([(" s1", "t9")], truth.schema))
    number = lambda df: df.coalesce(1).withColumn("row", F.monotonically_increasing_id())
    assert C.recall_report(number(rows), number(twice), "row").first()["recall"] == 1.0
    assert C.completeness(rows, truth.limit(0), n).first()["pairs_completeness"] is None


def test_sampling(spark):
    df = spark.createDataFrame([(str(i), "us" if i < 70 else "in" if i < 95 else None) for i in range(100)], "entity_id string, country string")
    targets = {r["country"]: r["target"] for r in sampling.sample_targets(sampling.country_counts(df), 10).collect()}
    assert targets == {"us": 7, "in": 3} or targets == {"us": 7, "in": 2, "__MISSING__": 1}
    rows = sampling.stratified_sample(df, 10)
    assert rows.count() == 10 and sorted(r[0] for r in rows.collect()) == sorted(r[0] for r in rows.collect())
    assert sampling.stratified_sample(df, 1000).count() == 100
    assert sampling.stratified_sample(df.limit(0), 10).count() == 0


@pytest.fixture(scope="module")
def records(spark):
    raw = spark.createDataFrame(
        [("1", "Heron Mill Pvt. Ltd.", "52 Elm St, Peoria, IL 61602", "us", "s1"), ("2", "राम स्टील", "Nashik, Maharashtra 422009", "India", "s2"), (" 3 ", None, None, None, "s3")],
        "entity_id string, business_name string, business_address string, country string, src string",
    )
    return staged(normalize(raw.withColumn("split", F.lit("train"))))


def test_records(records):
    rows = {r["entity_id"]: r for r in records.collect()}
    assert set(COLUMNS) <= set(records.columns)
    assert (rows["1"]["name_no_suffix"], rows["1"]["zip_code"], rows["1"]["country_key"]) == ("heron mill", "61602", "us")
    assert (rows["2"]["script_type"], rows["2"]["name_full"], rows["2"]["name_ascii"]) == ("devanagari", "राम स्टील", "")
    assert rows["2"]["name_no_suffix"].isascii() and rows["2"]["name_no_suffix"].startswith("rama")
    assert (rows["3"]["name_full"], rows["3"]["has_address"], rows["3"]["country_key"]) == ("", False, "unknown")


def test_layout(spark, records, tmp_path):
    root = f"file://{tmp_path}/out"
    sinks.save_processed(records, root)
    assert readers.load_partition(spark, f"{root}/stage1", "train", "India").count() == 1
    summary = json.loads(spark.read.json(f"{root}/meta/partition_summary").first()["summary"])
    assert summary["us"] == {"s1": 1, "s2": 0, "s3": 0} and summary["__unknown__"]["s3"] == 1
    flags = readers.read_tsv(spark, f"{root}/meta/subgroup_flags")
    assert {r["is_domain_name"] for r in flags.collect()} == {"False"}
    report = C.run_blocking(records)
    sinks.save_candidates(report, f"{root}/cands")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{root}/cands/candidate_pairs_debug").count() == 1


def test_similar_blocks():
    rng = __import__("numpy").random.default_rng(3)
    np = __import__("numpy")
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    dense[:, 0] = rng.random(60)  # a gram that all have
    dense[7] = dense[3]
    parts = lambda m: [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in m]
    flat = lambda p: (np.concatenate([g for g, _ in p]), np.concatenate([w for _, w in p]), np.array([len(g) for g, _ in p]))
    ids = [f"{i:02d}" for i in range(40)]
    g, w, n = flat(parts(dense[:40]))
    held = H.Held([(ids, g, w, n)])
    row, col, sim = held.best(*flat(parts(dense[40:])), 5)
    truth = np.round(dense[40:] @ dense[:40].T, 9)
    want = [(q, int(t), truth[q, t]) for q in range(20) for t in np.lexsort((np.arange(40), -truth[q]))[:5] if truth[q, t] > 0]
    assert [(int(a), int(b)) for a, b in zip(row, col)] == [x[:2] for x in want] and np.allclose(sim, [x[2] for x in want])


def test_lsh_parameters():
    assert H.lsh_parameters(0.25, 64) == (18, 2)
    bands, rows = H.lsh_parameters(0.8, 64)
    assert bands * rows <= 64 and rows > 4


def test_quality(records):
    checks = {r["check"]: r["severity"] for r in quality.quality_report(records).collect()}
    assert "fail" not in checks.values(), checks
    bad = records.withColumn("pin_code", F.lit("012345")).withColumn("name_sorted", F.lit("b a"))
    report = quality.quality_report(bad)
    checks = {r["check"]: r["severity"] for r in report.collect()}
    assert {r["check"]: r["sample"] for r in report.collect()}["q12_pin_format"] == ["2"]
    assert checks["q12_pin_format"] == checks["q04_name_sorted_order"] == "fail" and quality.verdict(report) == 1
    assert {r["check"]: r["severity"] for r in quality.quality_report(records.drop("zip_code")).collect()}["q01_missing_columns"] == "fail"


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("entity_id \tcountry\n1\tNA\n2\t\n3\tus\n")
    rows = readers.read_tsv(spark, f"file://{tmp_path}/a.tsv", ["entity_id", "country", "business_name"])
    assert [tuple(r) for r in rows.orderBy("entity_id").collect()] == [("1", "", ""), ("2", "", ""), ("3", "us", "")]
