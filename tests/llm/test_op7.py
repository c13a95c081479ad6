"""Token files: exact round trip against whole-text encoding."""

import random
import zlib

import numpy as np
import pytest

from millrace.llm import op7_tokens as op, store

ODD = ["it's don't I'LL 'S", "x'sy !'s ''s", "İstanbul ﬁ ½ ª º µ ×", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c\xa0d", "é ́a Å", "中文 テスト 123٣", "", "  \n\t", "12a3 4'd'"]


def test_pieces_equal_whole_texts():
    e = op.Encoder(op.tokenizer_path(), True)
    rng = random.Random(1)
    alphabet = "aB'sStTdDmMrelLvV 0192!-_.\n\t́éÉßÀ×ª中<|>\x1c"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert e.by_piece
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, name):
    path = op.tokenizer_path(name)
    rows = [(7, "Some words here.", 1), (3, None, 2), (None, "no id", 3), (5, "long " * 20000, 4), (3, "again", 5), (-4, "", 6)] + [(100 + i, t, i) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = store.new_path(spark, "test")
    shards = op.write_tokens(docs, out, path, by_word=name.startswith("word"), partitions=4)
    dtype = op.encoder(path, False).dtype.str
    got = sorted(op.read_tokens(spark, out, shards, dtype).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    whole, at = op.Encoder(path, False), 0
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(np.frombuffer(whole.encode([t or ""])[0], whole.dtype).tolist() + [2])
    for r in got:
        ids = next(x for x in texts[r["doc_id"]] if len(x) == r["n_tokens"])
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty(spark):
    assert op.token_output(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cache_keeps_frequent_keys(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 4)
    cache = op.Cache()
    for i in range(50):
        for k in cache.need({"the", f"w{i}", f"v{i}"}):
            cache.young[k] = b"x"
        assert cache.young["the"] == b"x" and len(cache.young) <= 8
