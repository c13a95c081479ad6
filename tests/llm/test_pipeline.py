"""The pipeline's stages on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocab = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(2, 4))) for _ in range(300)] for lang, s in (("aa", ["ka", "mo", "ti"]), ("bb", ["sch", "ün", "ber"]))}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    item = prose("aa", 40)
    rows = [(i, prose("ab"[i % 2] * 2, 60), "ab"[i % 2] * 2, f"s{i % 3}", 0) for i in range(80)]
    rows += [(100, rows[0][1], "aa", "s0", 0), (101, rows[1][1] + " x", "bb", "s0", 0), (102, "12 34 !!", "aa", "s1", 0), (103, prose("aa", 20) + " " + item, "aa", "s1", 0), (104, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        seen.append({r["doc_id"] for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {102, 104} & seen[0] == set() and seen[0] >= set(range(80))
    assert {100, 101} & seen[1] == set() and 0 in seen[1] and 103 in seen[1]
    assert 103 not in seen[2] and seen[2] >= set(range(80))
    assert corpus_pipeline.run(spark, sf).count() == docs.count() > 0


def staged(spark, docs, folder, stages=corpus_pipeline.STAGES):
    for k, (_, stage) in enumerate(stages):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        yield docs


def test_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's output, redone in plain Python."""
    import zlib
    from collections import Counter

    import numpy as np
    from millrace.llm import op4_decontaminate, op6_language, op7_tokens
    from tokenizers import Tokenizer

    rng = random.Random(5)
    vocab = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(2, 4))) for _ in range(200)] for lang, s in (("aa", ["ka", "mo", "ti"]), ("bb", ["sch", "ün", "ber"]))}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    items = {1: prose("aa", 30), 2: prose("bb", 9)}
    texts = {i: prose("ab"[i % 2] * 2, rng.randint(5, 80)) for i in range(60)}
    for i in range(60, 90):
        words = texts[rng.randrange(60)].split()
        words[rng.randrange(len(words))] = "zz"
        texts[i] = " ".join(words * (1 if i % 2 else 2))
    texts |= {90: prose("aa", 10) + " " + items[1], 91: items[2] + " " + prose("bb", 10), 92: "99 !!", 93: " ".join(items[1].split()[:13])}
    folder = f"file://{tmp_path}"
    rows = [(i, t, "ab"[i % 2] * 2, f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [[(r["doc_id"], r["text"]) for r in d.collect()] if k < 4 else d.collect() for k, d in enumerate(staged(spark, docs, folder))]

    model = op6_language.train(op6_language.sample(docs))
    assert {i for i, _ in out[0]} == {i for i, t in texts.items() if not model.predict([t])[2][0]} and 92 not in dict(out[0])

    sets = {}
    for i, t in out[0]:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert {i for i, _ in out[1]} == {i for i in sets if top(i) == i}

    def dirty(text):
        words = op4_decontaminate.words([text.encode()])[0].tolist()
        for item in items.values():
            w = op4_decontaminate.words([item.encode()])[0].tolist()
            n = min(13, len(w))
            runs = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                return True
        return False

    assert {i for i, _ in out[2]} == {i for i, t in out[1] if not dirty(t)} and not {90, 91, 93} & set(dict(out[2]))

    size = {i: len(t.split()) for i, t in out[2]}
    source = lambda i: i % 3
    own = {s: sum(n for i, n in size.items() if source(i) == s) for s in range(3)}
    demand, weight = 1.5 * sum(own.values()), {0: 3, 1: 1, 2: 2}
    target, open_ = {}, {0, 1, 2}
    while True:
        left = demand - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * own[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * own[s] for s in over}
        open_ -= over
        if not open_:
            break
    copies = Counter(i for i, _ in out[3])
    assert set(dict(out[3])) <= set(size) and max(copies.values()) <= 2 and all(dict(out[2])[i] == t for i, t in out[3])
    for s in range(3):
        assert abs(sum(n * size[i] for i, n in copies.items() if source(i) == s) - target[s]) <= max(size.values())

    tokenizer = Tokenizer.from_file(op7_tokens.tokenizer_path())
    encoded = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for i, t in out[3]]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out[4]) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    starts = sorted((r["start"], r["n_tokens"]) for r in out[4])
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key long, bands string, n int"


def test_odd_rows(spark, tmp_path):
    """Null, empty, long and repeated rows, ties, and extra columns with the operators' own names."""
    rng = random.Random(6)
    words = ["".join(rng.choice(["ka", "mo", "ti", "sch"]) for _ in range(3)) for _ in range(90)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    extra = (True, 7, "x", 1)
    rows = [(i, prose(30), "aa", "s0", 0, *extra) for i in range(40)]
    rows += [(None, prose(20), "aa", None, None, *extra)] * 2 + [(50, None, "aa", "s1", 0, *extra), (51, "", "aa", "s1", 0, *extra), (52, prose(60_000), "aa", "s1", 0, *extra)]
    rows += [rows[0]] * 3 + [(1, prose(25), "aa", "s2", 0, None, None, None, None)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    out = list(staged(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    for d in out[:4]:
        assert d.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in out]
    assert not {50, 51} & set(ids[0]) and 52 in ids[0] and ids[0].count(0) == 4 and ids[0].count(None) == 2
    assert ids[1].count(0) == 1 and ids[1].count(1) == 2 and ids[1].count(None) == 1 and sorted(map(str, ids[2])) == sorted(map(str, ids[1]))
    assert len(ids[4]) == len(ids[3]) > 0


def test_empty_and_unlabelled(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "ka mo ti ka", None, "s", 0)], SCHEMA.split(", kept")[0])
    assert corpus_pipeline.STAGES[0][1](spark, docs, "").count() == 1
    docs.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [d.count() for d in staged(spark, spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}")] == [0] * 5
