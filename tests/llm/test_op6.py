"""Language ID: held-out accuracy, rejection and odd rows."""

import random

import pytest

from millrace.llm import op6_language as op

SYLLABLES = {"aa": ["ka", "mo", "ti", "ra"], "bb": ["sch", "ün", "ber", "keit"], "cc": ["ción", "lla", "que", "ez"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return op.train([(text(rng, lang, rng.randint(5, 80)), lang) for lang in SYLLABLES for _ in range(60)])


def test_held_out(model):
    rng = random.Random(2)
    cases = [(text(rng, lang, rng.randint(5, 60)), lang) for lang in SYLLABLES for _ in range(60)]
    langs, scores, rejected = model.predict([t for t, _ in cases])
    assert sum(a == b for a, (_, b) in zip(langs, cases, strict=True)) >= 0.95 * len(cases)
    assert all(0 <= s <= 1 for s in scores) and rejected.mean() < 0.05


def test_odd_texts(model):
    long = text(random.Random(3), "bb", 60_000)
    langs, scores, rejected = model.predict([None, "", "12 3!?", "a", long, "中"])
    assert langs[:3] == ["und"] * 3 and list(scores[:3]) == [0, 0, 0] and rejected[:3].all()
    assert langs[4] == "bb" and langs[3] in SYLLABLES and langs[5] in SYLLABLES
    assert op.train([]).predict(["x"])[0] == ["und"]


def test_tables(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, 20), lang, "z") for i, lang in enumerate(list(SYLLABLES) * 40)] + [(None, "ka mo", "aa", "z"), (500, None, "bb", "z"), (501, "12", None, "z"), (0, "ka ti", "aa", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    rows = op.sample(docs, per_language=30)
    assert len(rows) <= 90 and rows == op.sample(docs.repartition(3), per_language=30)
    model = op.train(rows)
    out = op.predict(docs, model).collect()
    assert len(out) == docs.count() and {r["lang_pred"] for r in out if r["doc_id"] in (500, 501)} == {"und"}
    kept = op.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({500, 501}) and kept.count() >= 115
    assert op.predict(docs.limit(0), model).count() == 0


def test_grams_stay_within_words():
    assert len(op.grams(op.normal("ab"))[0]) == 3 and [len(g) for g in op.grams(op.normal("a b"))] == [4, 2, 0]


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", op.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_rejects_what_it_has_not_learned(model):
    """Texts of another language and junk are rejected; texts of the learned ones of all lengths are not."""
    rng = random.Random(8)
    other = ["".join(rng.choice(["yö", "pää", "hkä", "lu", "ssa", "nne"]) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    foreign = [" ".join(rng.sample(other, n)) for n in (20, 60, 200) for _ in range(20)]
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n)) for n in (60, 300, 900) for _ in range(20)]
    assert model.predict(foreign)[2].mean() > 0.9 and model.predict(junk)[2].mean() > 0.9
    clean = [text(rng, lang, n) for lang in SYLLABLES for n in (3, 10, 40, 300, 1000) for _ in range(20)]
    assert model.predict(clean)[2].mean() < 0.03


def test_whole_texts_are_learned():
    """What only the end of a long labelled text shows is learned."""
    rng = random.Random(9)
    rows = [(text(rng, lang, 60), lang) for lang in ("aa", "bb") for _ in range(30)]
    rows += [(text(rng, "aa", 6000) + " " + " ".join(["zuvo"] * 3000), "aa") for _ in range(3)]
    assert op.train(rows).predict(["zuvo zuvo zuvo"])[0] == ["aa"]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "ka mo", None)], "doc_id long, text string, lang string")
    assert op.sample(docs) == [] and op.keep_identified(docs, op.train([])).count() == 0
