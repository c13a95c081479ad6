"""Benchmark decontamination by spaced-seed hashing.

Texts are sequences of lower-cased words without punctuation at their edges.  A mask marks which positions of a window
of ``SPAN`` words count and which are ignored; each window is hashed under every mask, so that a hash of a test item
and one of a document agree although words at ignored positions were substituted.  Both texts are compared
word by word along the hit's whole diagonal, and an overlap is any stretch of it that has ``LEAST`` words or more, or
covers an item shorter than that, with ``IDENTITY`` of its words equal at least.  A document with an overlap is
contaminated; the one with the most equal words is reported.

Test items shorter than a window are hashed whole, without ignored positions.  Items are dealt by a hash of their text
to slices of about ``SLICE`` window hashes, which are tables in the shared folder; neither the driver nor a broadcast
holds them.  A task loads one slice at a time and takes its documents past it, in runs of about ``RUN`` characters where
there are several slices; so memory stays bounded however many items there are.  Documents never move: hashing, joining
and verifying are one pass over the rows.  A hash that many items share is met once a diagonal.

Null or empty texts are clean, and null or word-less items match nothing.  Items of one text are one item, the least.
Repeated rows and null ids each keep a row; of equal overlaps the least item_id is reported.  A very long text is hashed
in segments; a worker holds its words as 8 bytes each.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, store

#: 1 counts, 0 is ignored.  Each has 7 positions that count within 11 words.
MASKS = ("11111110000", "11011010101", "10110110011", "11101000111")
LEAST, IDENTITY = 13, 0.75
SLICE = 1_000_000
#: Characters of documents that are held against each of several slices.
RUN = 1 << 24
#: Window pairs that are listed at once.
PAIRS = 1 << 20
FOUND = "doc_id long, n_words long, contaminated boolean, item_id long, overlap long, matched long"
EDGE = b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())


def _blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(EDGE)] = True
    out[[32, *range(9, 14)]] = True
    return out


BLANK = _blank()


def words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every text and where each text's words start; ASCII punctuation counts as white space."""
    return kernels.word_hashes(run, BLANK)


def spaced(h: np.ndarray, mask: str, tag: int) -> np.ndarray:
    """Hash of each window of words under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, tag, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(kernels.BASE) + h[i : i + n]
    return kernels.mix(out)


class Tests:
    """Test items: their words, and all their window hashes, sorted, with item and place."""

    def __init__(self, ids: list[int], texts: list):
        self.ids = ids
        self.words: list[np.ndarray] = []
        for _, run in kernels.chunks(texts):
            h, at = words(run)
            self.words += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < len(MASKS[0])})
        parts = [(x, i) for i, w in enumerate(self.words) for x in self.seeds(w)]
        hashes = [x for (_, x), _ in parts]
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.concatenate([np.full(len(x), i) for (_, x), i in parts]) if parts else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if parts else np.empty(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], item[order], place[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def seeds(self, w: np.ndarray):
        """(tag, hashes) of one item."""
        if len(w) >= len(MASKS[0]):
            return [(tag, spaced(w, mask, tag + 1)) for tag, mask in enumerate(MASKS)]
        return [(99, spaced(w, "1" * len(w), 99))] if len(w) else []

    def diagonals(self, h: np.ndarray):
        """(item, place in h less place in the item) of each diagonal with a window that both share, once."""
        masks = [(m, t + 1) for t, m in enumerate(MASKS)] + [("1" * n, 99) for n in self.short]
        seen = np.empty(0, np.int64)
        for mask, tag in masks:
            own = spaced(h, mask, tag)
            maybe = np.flatnonzero(self.sieve[(own >> np.uint64(44)).astype(np.int64)])
            low, high = (np.searchsorted(self.hash, own[maybe], side) for side in ("left", "right"))
            some = high > low
            at, low, count = maybe[some], low[some], (high - low)[some]
            ends = np.cumsum(count)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                n = count[i:j]
                entry = np.repeat(low[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = np.unique((self.item[entry] << 40) + (np.repeat(at[i:j], n) - self.place[entry] + (1 << 39)))
                key = key[~np.isin(key, seen)]
                seen = np.concatenate((seen, key))
                for k in key.tolist():
                    yield k >> 40, (k & ((1 << 40) - 1)) - (1 << 39)
                i = j

    def overlap(self, h: np.ndarray, item: int, diagonal: int) -> tuple[int, int]:
        """(words, equal words) of the stretch with the most equal words that counts, on a whole diagonal; zeros if none does."""
        w = self.words[item]
        a, b = max(0, diagonal), max(0, -diagonal)
        n = min(len(h) - a, len(w) - b)
        return _stretch(h[a : a + n] == w[b : b + n], min(LEAST, len(w)))

    def best(self, h: np.ndarray, first: bool = False) -> tuple[int, int, int] | None:
        """(equal words, words, least such item) of the best overlap that counts; first: of any."""
        top = None
        for item, diagonal in self.diagonals(h):
            n, equal = self.overlap(h, item, diagonal)
            if n:
                top = max(top or (0, 0, 0), (equal, n, -self.ids[item]))
                if first:
                    break
        return top and (top[0], top[1], -top[2])


def _stretch(same: np.ndarray, least: int) -> tuple[int, int]:
    """(words, equal words) of the stretch with the most equal words among those of ``least`` words or more with
    ``IDENTITY`` of them equal, without the unequal words at its ends that it can do without; zeros if there is none."""
    if len(same) < least:
        return 0, 0
    total = np.concatenate(([0], np.cumsum(same)))
    score = total - IDENTITY * np.arange(len(total))
    low = np.minimum.accumulate(score)
    ends = np.flatnonzero(score[least:] >= low[:-least]) + least
    if not len(ends):
        return 0, 0
    starts = np.searchsorted(-low, -score[ends])
    k = int(np.argmax(total[ends] - total[starts]))
    a, b = int(starts[k]), int(ends[k])
    kept = np.flatnonzero(same[a:b])
    return max(int(kept[-1] - kept[0]) + 1, least), len(kept)


def sliced(items: DataFrame) -> tuple[str, int]:
    """(path, number) of the slices of the test items, written as a table partitioned by slice."""
    size = F.greatest(F.lit(1), F.size(F.split("text", r"\s+"))) * len(MASKS)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    rows = store.materialise(rows.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")
    n = -(-int(rows.agg(F.sum(size)).first()[0] or 0) // SLICE)
    path = store.new_path(items.sparkSession, "slices")
    if n:
        rows.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).repartition("slice").write.partitionBy("slice").parquet(path)
    return path, n


_held: dict[str, tuple[int, Tests | None]] = {}


def tests_of(path: str, number: int) -> Tests | None:
    """The slice's items and hashes; a worker holds one slice of one path at a time."""
    if _held.get(path, (-1, None))[0] != number:
        from pyarrow import dataset, fs

        _held.clear()
        files, top = store.filesystem(path)
        found = None
        if files.get_file_info(f"{top}/slice={number}").type == fs.FileType.Directory:
            table = dataset.dataset(f"{top}/slice={number}", filesystem=files, format="parquet").to_table()
            found = Tests(table.column("item_id").to_pylist(), table.column("text").to_pylist())
        _held[path] = number, found
    return _held[path][1]


def judged(texts: list, path: str, n: int, first: bool = False):
    """(number of words, best overlap or None) of each text against all slices."""
    sizes, tops, whole = [], [], []
    for _, run in kernels.chunks(texts):
        h, at = words(run)
        whole += [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    sizes, tops = [len(h) for h in whole], [None] * len(whole)
    for number in range(n):
        tests = tests_of(path, number)
        for i, h in enumerate(whole if tests else ()):
            if not (first and tops[i]):
                found = tests.best(h, first)
                tops[i] = max((x for x in (tops[i], found) if x), key=lambda x: (x[0], x[1], -x[2]), default=None)
    return list(zip(sizes, tops, strict=True))


def runs(batches, column: int, n: int):
    """Lists of batches: each by itself with one slice, else about ``RUN`` characters together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if n < 2 or size >= RUN:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, contaminated, and the best overlap's item_id, words and equal words."""
    store.arrow_batches(docs.sparkSession)
    path, n = sliced(items)

    def run(batches):
        import pyarrow as pa

        for held in runs(batches, 1, n):
            found = iter(judged([x for b in held for x in b.column(1).to_pylist()], path, n))
            for batch in held:
                out = [(size, top is not None, *((top[2], top[1], top[0]) if top else (None, 0, 0))) for size, top in (next(found) for _ in range(batch.num_rows))]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "contaminated", "item_id", "overlap", "matched"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The clean documents with their own columns."""
    store.arrow_batches(docs.sparkSession)
    path, n = sliced(items)
    column = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for held in runs(batches, column, n):
            found = iter(judged([x for b in held for x in b.column(column).to_pylist()], path, n, first=True))
            for batch in held:
                keep = [next(found)[1] is None for _ in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
