"""The command line, end to end, over small files."""

import pytest

from millrace import cli
from millrace.operators import quality
from millrace.sources import readers


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    for split in ("train", "test"):
        (base / split).mkdir()
        for n in (1, 2, 3):
            rows = [f"{split[1]}{n}{i}\tHeron Mill {i} Ltd\t{i} Elm St, Peoria, IL 6160{i}\t{'US' if i < 3 else 'India'}" for i in range(1, 5)]
            (base / split / f"{split}_source{n}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *rows]) + "\n")
    (base / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nr11\tr21,r31\n")
    assert cli.main(["normalize", "--train-dir", f"file://{base}/train", "--test-dir", f"file://{base}/test", "--out", f"file://{base}/out"]) == 0
    return base


def test_layout(spark, root):
    assert readers.partition_names(spark, f"file://{root}/out/stage1/split=train", "country_key") == ["india", "us"]
    assert readers.read_tsv(spark, f"file://{root}/out/stage0/test_source2").count() == 4
    assert readers.read_tsv(spark, f"file://{root}/out/stage0/train_ground_truth").count() == 1
    with pytest.warns(UserWarning, match="no partition"):
        assert readers.load_partition(spark, f"file://{root}/out/stage1", "train", "Norway").count() == 0


def test_block_and_evaluate(spark, root, capfd):
    out = f"file://{root}/cands"
    assert cli.main(["block", "--root", f"file://{root}/out", "--split", "train", "--out", out, "--truth", f"file://{root}/train/train_ground_truth.tsv"]) == 0
    assert "channel D" in capfd.readouterr().out
    assert readers.read_tsv(spark, f"{out}/candidate_pairs").count() == 4
    assert cli.main(["evaluate", "--candidates", f"{out}/candidate_pairs", "--truth", f"file://{root}/train/train_ground_truth.tsv"]) == 0


def test_validate(spark, root):
    assert cli.main(["validate", "--root", f"file://{root}/out"]) == 0
    meta = {r["check"]: r["severity"] for r in quality.meta_report(spark, f"file://{root}/out").collect()}
    assert set(meta.values()) == {"pass"}
    assert {r["severity"] for r in quality.meta_report(spark, f"file://{root}/none").collect()} == {"warn"}
    (root / "bad" / "meta" / "partition_summary").mkdir(parents=True)
    (root / "bad" / "meta" / "partition_summary" / "x.json").write_text("{no json\n")
    assert {r["check"]: r["severity"] for r in quality.meta_report(spark, f"file://{root}/bad").collect()}["q19_partition_summary"] == "fail"
