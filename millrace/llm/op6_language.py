"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's lower-cased letters, with one blank between words, give character n-grams (2 to 4, none across words); each
is hashed to one of 2**16 embeddings, their mean goes through a linear layer and a softmax.  The embeddings and the
layer are trained by stochastic gradient descent in numpy on the driver, on a bounded sample of labelled rows:
``PER_LANGUAGE`` rows a language in the order of a seeded hash, no more than ``SAMPLE`` in all, among texts of at most
``LONGEST`` characters.  A sampled text is learned whole, in pieces of ``PIECE`` characters, so that short texts are
learned too.  Every document is predicted from its whole text.

A fifth of the sample is never trained on.  It sets the softmax temperature (least log loss) and two rejection levels.
The score level is the score below which no more than ``REJECT`` of these texts fall, and never over one half.  The
other level is for texts in no learned language: the share of a text's n-grams that training never met.  For texts of
each size class it lies a third of the way from what all but ``REJECT`` of the held-out texts and their pieces stay
below to the median of the same pieces with their letters shuffled.  A document is rejected when its score is below its
level, its share of new n-grams above its own, or it has no letter.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  Without labelled rows every text is
``und`` and rejected.  Of equal scores the language least by code point is predicted.  A very long text is summed up in
parts.  Repeated rows and null ids each give a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels, store

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
PER_LANGUAGE, SAMPLE, LONGEST = 400, 20_000, 1 << 20
REJECT = 0.001
PIECE = 240
#: Languages whose counts are broadcast.
LANGUAGES = 10_000
#: Numbers of n-grams that part the size classes of texts.
SIZES = (48, 192, 768)
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean, {key}"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normal(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, one blank (0) between, before and after words; empty without letters."""
    if not text:
        return np.empty(0, np.uint64)
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[x]
    if not keep.any():
        return np.empty(0, np.uint64)
    x = np.concatenate(([0], np.where(keep, x, 0), [0])).astype(np.uint64)
    return x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]


def grams(x: np.ndarray) -> list[np.ndarray]:
    """For each order the buckets of the n-grams of normalised text, those across a word's edge left out."""
    out = []
    h, inner = x, None
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint64(kernels.BASE) + x[n - 1 :]
        inner = np.ones(len(x) - 1, bool) if n == 2 else inner[:-1] & (x[n - 2 : -1] != 0)
        if n in ORDERS:
            out.append((kernels.mix(h[inner]) >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x (language, 1 if training never met it): the embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    level: float = 0.0
    strange: tuple[float, ...] = (1.0,) * (len(SIZES) + 1)  # greatest share of new n-grams by size class

    def logits(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, number of n-grams and share of new ones."""
        out, size = np.zeros((len(texts), len(self.langs) + 1)), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            total, n = 0.0, 0
            for g in grams(normal(text)):
                for j in range(0, len(g), 1 << 18):
                    counts = np.bincount(g[j : j + (1 << 18)], minlength=BUCKETS) if len(g) > BUCKETS else None
                    total = total + (counts @ self.table if counts is not None else self.table.take(g[j : j + (1 << 18)], 0).sum(0))
                n += len(g)
            if n:
                out[i], size[i] = total / n, n
        return out[:, :-1] + self.bias * (size > 0)[:, None], size, out[:, -1]

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        z, size, new = self.logits(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        some = size > 0
        p = softmax(z / self.temperature)
        score = np.where(some, p.max(1), 0.0)
        foreign = new > np.array(self.strange)[np.searchsorted(SIZES, size, "right")]
        return [self.langs[k] if ok else "und" for k, ok in zip(p.argmax(1), some, strict=True)], score, ~some | foreign | (score < self.level)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def pieces(text: str) -> list[str]:
    """Consecutive pieces of a whole text, the last one with what is left."""
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [text]


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.5, seed: int = 6) -> Model:
    """Fit on (text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0))
    held = [zlib.crc32(text.encode("utf-8", "surrogatepass")) % 5 == 0 for text, _ in rows]
    fit = [(t, k) for (t, k), h in zip(rows, held, strict=True) if not h] or rows
    check = [(t, k) for (t, k), h in zip(rows, held, strict=True) if h] or rows
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    examples = []
    for text, lang in fit:
        for part in pieces(text):
            if g := grams(normal(part)):
                ids, counts = np.unique(np.concatenate(g), return_counts=True)
                examples.append((ids, (counts / counts.sum()).astype(np.float32), place[lang]))
    share = np.bincount([k for _, _, k in examples], minlength=len(langs)) if examples else np.ones(len(langs))
    weight = (share.sum() / np.maximum(share, 1) / len(langs)).astype(np.float32)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, w, k = examples[i]
            mean = w @ embed[ids]
            error = softmax(mean @ layer + bias)
            error[k] -= 1
            error *= min(3.0, weight[k]) * rate * (1 - step / steps)
            back = layer @ error
            layer -= np.outer(mean, error)
            bias -= 0.1 * error
            embed[ids] -= (w * 20)[:, None] * back
            step += 1
    new = np.ones((BUCKETS, 1), np.float32)
    for ids, _, _ in examples:
        new[ids] = 0
    model = Model(langs, np.concatenate(((embed @ layer).astype(np.float32), new), axis=1), bias.astype(np.float64))
    z, size, _ = model.logits([t for t, _ in check])
    truth = np.array([place[k] for _, k in check])[size > 0]
    z = z[size > 0]
    if len(z):
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        model.level = float(min(0.5, np.quantile(softmax(z / model.temperature).max(1), REJECT)))
        model.strange = strangeness(model, [t for t, _ in check], rng)
    return model


def strangeness(model: Model, texts: list[str], rng) -> tuple[float, ...]:
    """The level of new n-grams of each size class, from texts, their pieces of several lengths, and these shuffled."""
    parts = [p for t in texts for n in (PIECE // 8, PIECE // 2, PIECE, 4 * PIECE, len(t)) for p in (t[i : i + n] for i in range(0, min(len(t), 4 * n), max(1, n)))]
    shuffled = ["".join(np.array(list(p))[rng.permutation(len(p))].tolist()) for p in parts]
    (_, size, new), (_, size2, junk) = model.logits(parts), model.logits(shuffled)
    out, last = [], 1.0
    for c in range(len(SIZES) + 1):
        own, other = new[(np.searchsorted(SIZES, size, "right") == c) & (size > 0)], junk[(np.searchsorted(SIZES, size2, "right") == c) & (size2 > 0)]
        if len(own) and len(other):
            usual, odd = float(np.quantile(own, 1 - REJECT)), float(np.median(other))
            last = usual + (odd - usual) / 3 if odd > usual else 1.0
        out.append(last)
    return tuple(out)


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, lang) rows a language and ``most`` in all, in the order of a hash.

    Languages are counted first; only rows whose hash is below a bound that about twice as many pass are ranked, so no
    task gets the rows of a language.
    """
    rows = labelled.where("lang is not null and text is not null").where(F.length("text") <= longest)
    rows = rows.select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    near = F.col("key") / F.lit(float(1 << 63)) <= 2 * (2 * F.lit(per_language) + 64) / F.col("n") - 1
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    counts = F.broadcast(counts) if counts.limit(LANGUAGES + 1).count() <= LANGUAGES else counts
    ranked = rows.select("lang", "key", "doc_id").join(counts, "lang").where(near).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    chosen = ranked.orderBy("r", "key").limit(most).select("key", "lang").distinct()
    found = rows.join(F.broadcast(chosen), ["key", "lang"], "left_semi").select("text", "lang").distinct()
    return sorted((r.text, r.lang) for r in found.collect())


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected and the columns ``keep`` of every document.

    The model is closed over: its table has 2**16 rows of one float a language.
    """
    store.arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    fields = [rows.schema[c] for c in ("doc_id", *keep)]

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            lang, score, rejected = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", *keep, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(run, out)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    columns = docs.columns
    store.arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rejected = shared.value.predict(batch.column(at).to_pylist())[2]
            yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema).filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 modulo 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(sample(docs.where(~held_out("doc_id"))))
    rows = predict(docs, model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
