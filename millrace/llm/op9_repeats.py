"""Suffix-array dedup: exact removal of byte strings that occur earlier.

A string of ``LENGTH`` bytes is a window.  Each window has an anchor, its ``GRAM``-byte gram of least hash (the leftmost
of equals): equal windows have equal anchors at equal places.  Neighbouring windows with the same anchor form a context,
the bytes they span.  So windows are compared within anchors only, in steps that shrink the data before any suffix is
sorted:

1. Anchors that occur once in the corpus are out: hashes, distinct in each piece of input, meet in hash buckets.
2. Contexts of the other anchors are compared as wholes, by a 128-bit digest of their bytes (blake2b): all but the first
   occurrence are repeats throughout.
3. First occurrences of different contexts of one anchor may share some windows.  A sieve of window hashes finds the
   contexts that do; these are cut to the shared stretch, the stretch that all of them contain becomes one symbol, and
   the suffix array of the group is built by linear grouping along Lyndon prefixes (``lyndon``).  Windows that are
   neighbours in it with equal text are one string; its first occurrence stays.
4. Repeated windows are joined to runs, and documents are cut.

Order is by document (doc_id, then a hash of the text), then place.  No text is ever shuffled: each step scans the
documents again and looks up what it needs in a table of the shared folder that is partitioned by input file, so
neither lost executors nor other splits change anything.  An anchor with more than ``HOT`` different contexts (a very
common passage) is no single task: its windows are compared by a 128-bit digest of their bytes in an aggregate that
combines before the shuffle.  The polynomial hashes only sort out what can't be equal.

Null and empty texts have no bytes and keep the hash of the empty string.  Rows that repeat both doc_id and text are
one document and get the same result.  A null doc_id comes first in the order.  Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, lyndon, store
from .files import NO_ID, Lookup, bucket_number, buckets_of, by_file, concatenated, file_runs, member, occurrence, scanned

LENGTH, GRAM = 100, 40
HOT = 16_384
PLACE = (1 << 28) - 1
#: Bytes of texts that are hashed together, and of a text that is hashed at once.
CHUNK, SEGMENT = 1 << 18, 1 << 22
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(run: list[bytes]):
    """Of a run of texts: anchor hash, context hash, text number, first window, last window, anchor place (in bytes of the text).

    A very long text goes in segments that share ``LENGTH`` - 1 bytes, so that each window is in one of them.
    """
    if max(map(len, run), default=0) <= SEGMENT:
        return _anchors(run)
    parts = []
    for i, raw in enumerate(run):
        for s in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
            a, c, text, *places = _anchors([raw[s : s + SEGMENT + LENGTH - 1]])
            parts.append((a, c, text + i, *(p + s for p in places)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(run: list[bytes]):
    data, starts = kernels.joined(run)
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 4))
    if len(data) <= LENGTH:
        return none
    prefix = kernels.prefix_hash(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = kernels.range_hash(prefix, places, places + GRAM)
    low = (grams & ~np.uint64(PLACE)) | places.astype(np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: span - width], low[width - span :])
    low = (low & np.uint64(PLACE)).astype(np.int64)  # of the window at each byte
    text = np.repeat(np.arange(len(run)), np.diff(starts))[: len(low)]
    window = np.flatnonzero(np.arange(len(low)) + LENGTH < starts[1:][text])
    if not len(window):
        return none
    at, text = low[window], text[window]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    first, last = window[new], window[np.concatenate((new[1:] - 1, [len(window) - 1]))]
    text, at = text[new], at[new]
    base = starts[text]
    return grams[at], kernels.range_hash(prefix, first, last + LENGTH), text, first - base, last - base, at - base


def runs_of(batch):
    """(file, doc ids, keys, texts as bytes) for runs of rows of one file."""
    doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    texts = batch.column(3).to_pylist()
    for file, part in file_runs(batch):
        for first, run in kernels.chunks(texts[part], CHUNK):
            rows = slice(part.start + first, part.start + first + len(run))
            yield file, doc[rows], key[rows], run


def common_anchors(rows: DataFrame, n: int) -> str:
    """Table of the anchor hashes (a) that occur twice or more in the corpus, for each file that has them."""

    def emit(batches):
        import pyarrow as pa

        held, count, file = [], 0, None

        def flush():
            values, n_of = np.unique(np.concatenate(held), return_counts=True)
            out = list(buckets_of([values, (n_of > 1).astype(np.uint8)], values, n))
            held.clear()
            kinds = (pa.int32(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            return pa.RecordBatch.from_arrays([columns[0], pa.array([file] * len(out), pa.int64()), *columns[1:]], names=["bucket", "file", "hashes", "twice"])

        for batch in batches:
            for f, _, _, run in runs_of(batch):
                if held and (f != file or count > 1 << 22):
                    yield flush()
                    count = 0
                file = f
                held.append(anchors(run)[0])
                count += len(held[-1])
        if held:
            yield flush()

    def meet(frame):
        import pandas as pd

        values = concatenated(frame["hashes"], np.uint64)
        twice = concatenated(frame["twice"], bool)
        owner = np.repeat(np.arange(len(frame)), [len(x) // 8 for x in frame["hashes"]])
        _, back, n_of = np.unique(values, return_inverse=True, return_counts=True)
        often = n_of > 1
        often[back[twice]] = True
        keep = often[back]
        files = frame["file"].to_numpy()[owner[keep]]
        return pd.DataFrame({"file": files, "a": values[keep].astype(np.int64)}).drop_duplicates()

    found = rows.mapInArrow(emit, "bucket int, file long, hashes binary, twice binary").repartition(n, "bucket")
    return by_file(found.groupBy("bucket").applyInPandas(meet, "file long, a long"), "anchors")


def digests(strings) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit digest of each byte string."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in strings]), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def firsts_of(x: np.ndarray, x2: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Indices of the first occurrence of each different (x, x2)."""
    order = np.lexsort((place, key, doc, x2, x))
    if not len(order):
        return order
    return order[np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (x2[order][1:] != x2[order][:-1])))]


def first_contexts(rows: DataFrame, common: str, n: int) -> DataFrame:
    """file, a, y: the anchor and the occurrence hash of the first occurrence of every context of a common anchor."""

    def emit(batches):
        import pyarrow as pa

        look, held, count, file = Lookup(common), [], 0, None
        names = ["bucket", "file", "a", "x", "x2", "doc", "key", "place"]

        def flush():
            a, x, x2, doc, key, place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = firsts_of(x, x2, doc, key, place)
            parts = [p[order] for p in (a, x, x2, doc, key, place.astype(np.int32))]
            out = list(buckets_of(parts, parts[1], n))
            kinds = (pa.int32(), *[pa.binary()] * 6)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            return pa.RecordBatch.from_arrays([columns[0], pa.array([file] * len(out), pa.int64()), *columns[1:]], names=names)

        for batch in batches:
            for f, doc, key, run in runs_of(batch):
                if held and (f != file or count > 1 << 21):
                    yield flush()
                    count = 0
                file = f
                a, _, text, first, last, _ = anchors(run)
                keep = member(a, look.sorted(f, "a"))
                a, text, first, last = a[keep], text[keep], first[keep], last[keep]
                x, x2 = digests(run[t][s : e + LENGTH] for t, s, e in zip(text.tolist(), first.tolist(), last.tolist(), strict=True))
                held.append((a, x, x2, doc[text], key[text], first))
                count += len(a)
        if held:
            yield flush()

    def meet(frame):
        import pandas as pd

        a, x, x2 = (concatenated(frame[c], np.uint64) for c in ("a", "x", "x2"))
        doc, key, place = concatenated(frame["doc"], np.int64), concatenated(frame["key"], np.int64), concatenated(frame["place"], np.int32)
        file = np.repeat(frame["file"].to_numpy(), [len(b) // 8 for b in frame["x"]])
        order = firsts_of(x, x2, doc, key, place)
        y = occurrence(doc[order], key[order], place[order])
        out = pd.DataFrame({"file": file[order], "a": a[order].astype(np.int64), "y": y.astype(np.int64)})
        # a document that stands in several files is first in each of them
        same = pd.DataFrame({"file": file, "y": occurrence(doc, key, place).astype(np.int64), "a": a.astype(np.int64)})
        more = same[np.isin(same["y"], out["y"])]
        return pd.concat([out, more[["file", "a", "y"]]]).drop_duplicates()

    schema = "bucket int, file long, a binary, x binary, x2 binary, doc binary, key binary, place binary"
    found = rows.mapInArrow(emit, schema).repartition(n, "bucket")
    return found.groupBy("bucket").applyInPandas(meet, "file long, a long, y long")


class Marker:
    """Looks up, for runs of texts, which contexts of common anchors are first occurrences."""

    def __init__(self, common: str, firsts: str):
        self.common, self.firsts, self.file = Lookup(common), Lookup(firsts), None

    def marked(self, file: int, doc: np.ndarray, key: np.ndarray, run: list[bytes]):
        """(anchors' columns of the common ones, kind of each: -1 repeated, else what its first occurrence needs)."""
        if file != self.file:
            self.file = file
            self.a = self.common.sorted(file, "a")
            table = self.firsts.of(file)
            y = table.get("y", np.empty(0, np.int64)).view(np.uint64)
            order = np.argsort(y)
            self.y, self.kind = y[order], table.get("kind", np.empty(0, np.int32))[order]
        found = anchors(run)
        keep = member(found[0], self.a)
        found = [c[keep] for c in found]
        text, first = found[2], found[3]
        y = occurrence(doc[text], key[text], first)
        at = np.minimum(np.searchsorted(self.y, y), max(0, len(self.y) - 1))
        kind = np.where(self.y[at] == y, self.kind[at], -1) if len(self.y) else np.full(len(y), -1)
        return found, kind


def shared_contexts(rows: DataFrame, common: str, firsts: str) -> tuple[DataFrame, DataFrame]:
    """The bytes of first contexts whose anchor has other contexts (kind 1); the window digests of those of hot anchors (kind 2)."""

    def emit(batches):
        import pyarrow as pa

        mark = Marker(common, firsts)
        for batch in batches:
            for file, doc, key, run in runs_of(batch):
                (a, _, text, first, last, at), kind = mark.marked(file, doc, key, run)
                k = np.flatnonzero(kind == 1)
                own = [run[t][f : e + LENGTH] for t, f, e in zip(text[k].tolist(), first[k].tolist(), last[k].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[k].astype(np.int64), np.full(len(k), file), doc[text[k]], key[text[k]], first[k], at[k] - first[k])] + [pa.array(own, pa.binary())], names=["a", "file", "doc", "key", "first", "at", "bytes"])

    def emit_hot(batches):
        import pyarrow as pa

        mark = Marker(common, firsts)
        for batch in batches:
            for file, doc, key, run in runs_of(batch):
                (a, _, text, first, last, _), kind = mark.marked(file, doc, key, run)
                k = np.flatnonzero(kind == 2)
                n = last[k] - first[k] + 1
                owner = np.repeat(k, n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)
                w, w2 = digests(run[t][p : p + LENGTH] for t, p in zip(text[owner].tolist(), place.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (w.astype(np.int64), w2.astype(np.int64), np.full(len(w), file), doc[text[owner]], key[text[owner]], place)], names=["w", "w2", "file", "doc", "key", "first"])

    plain = rows.mapInArrow(emit, "a long, file long, doc long, key long, first long, at long, bytes binary")
    return plain, rows.mapInArrow(emit_hot, "w long, w2 long, file long, doc long, key long, first long")


def group_repeats(contexts: list[tuple]) -> list[tuple[int, int, int]]:
    """(context number, first window, windows) of the repeated runs among contexts of one anchor.

    contexts: (order, start, anchor offset, bytes, low, high); order sorts documents, and only windows low to high
    (offsets in bytes) may be shared.
    """
    core_from = min(at - high for _, _, at, _, _, high in contexts)  # the core: bytes around the anchor ...
    core_to = min(LENGTH + low - at for _, _, at, _, low, _ in contexts)  # ... that every shared window holds
    core: dict[bytes, int] = {}
    text: list[int] = []
    windows: dict[int, tuple[int, int]] = {}
    for c, (_, _, at, data, low, high) in enumerate(contexts):
        a, b = at - core_from, at + core_to
        base = len(text)
        windows.update((base + w - low, (c, w)) for w in range(low, high + 1))
        text += [x + 2 for x in data[low:a]]
        text.append(258 + core.setdefault(data[a:b], len(core)))
        text += [x + 2 for x in data[b : high + LENGTH]]
        text.append(1)
    text.append(0)
    marks: dict[int, list[int]] = {}
    for same in lyndon.repeated(text, windows, LENGTH - (core_from + core_to) + 1):
        found = sorted((*contexts[windows[i][0]][:1], contexts[windows[i][0]][1] + windows[i][1], *windows[i]) for i in same)
        lead = found[0][:2]
        for order, place, c, w in found:
            if (order, place) != lead:
                marks.setdefault(c, []).append(w)
    out = []
    for c, places in marks.items():
        places = np.unique(places)
        cut = np.flatnonzero(np.concatenate(([True], np.diff(places) > 1)))
        for a, b in itertools.pairwise([*cut.tolist(), len(places)]):
            out.append((c, contexts[c][1] + int(places[a]), b - a))
    return out


def sieved(a: list[int], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last offset of windows that another one of its anchor may share; -1 for none."""
    joined, starts = kernels.joined(data)
    n = np.array([len(x) - LENGTH + 1 for x in data])
    owner = np.repeat(np.arange(len(data)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = starts[owner] + place
    w = kernels.mix(kernels.range_hash(kernels.prefix_hash(joined), base, base + LENGTH) + np.array(a, np.int64).view(np.uint64)[owner])
    _, back, times = np.unique(w, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[back] > 1)
    low, high = np.full(len(data), -1), np.full(len(data), -1)
    high[owner[often]] = place[often]
    low[owner[often[::-1]]] = place[often[::-1]]
    return low, high


def repeats_in_contexts(contexts: DataFrame) -> DataFrame:
    """file, doc, key, first, windows: the repeated runs within contexts, anchor by anchor."""
    rows = contexts.repartition("a").sortWithinPartitions("a")

    def run(batches):
        import pyarrow as pa

        def solved(held):
            low, high = sieved([r[0] for r in held], [r[6] for r in held])
            for _, group in itertools.groupby(range(len(held)), key=lambda i: held[i][0]):
                own = [i for i in group if low[i] >= 0]
                if len(own) > 1:
                    for c, first, n in group_repeats([((held[i][2], held[i][3]), held[i][4], held[i][5], held[i][6], int(low[i]), int(high[i])) for i in own]):
                        yield (*held[own[c]][1:4], first, n)

        def packed(held):
            out = list(zip(*solved(held), strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["file", "doc", "key", "first", "windows"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) > 4000 and row[0] != held[-1][0]:
                    yield packed(held)
                    held = []
                held.append(row)
        if held:
            yield packed(held)

    return rows.mapInArrow(run, "file long, doc long, key long, first long, windows long")


def cut(rows: DataFrame, common: str, firsts: str, inner: str) -> DataFrame:
    """Remove the repeated bytes of every document."""

    def run(batches):
        import pyarrow as pa

        mark, look = Marker(common, firsts), Lookup(inner)
        file_seen, table = None, {}
        for batch in batches:
            out = []
            for file, doc, key, texts in runs_of(batch):
                if file != file_seen:
                    file_seen, table = file, {}
                    found = look.of(file)
                    if found:
                        order = np.lexsort((found["key"], found["doc"]))
                        columns = [found[c][order].tolist() for c in ("doc", "key", "first", "windows")]
                        for d, k, f, n in zip(*columns, strict=True):
                            table.setdefault((d, k), []).append((f, n))
                (_, _, text, first, last, _), kind = mark.marked(file, doc, key, texts)
                again = kind == -1
                text, first, last = text[again], first[again], last[again]
                at = np.searchsorted(text, np.arange(len(texts) + 1))
                for i, raw in enumerate(texts):
                    spans = list(zip(first[at[i] : at[i + 1]].tolist(), (last[at[i] : at[i + 1]] + LENGTH).tolist(), strict=True))
                    spans += [(f, f + n - 1 + LENGTH) for f, n in table.get((int(doc[i]), int(key[i])), ())]
                    out.append((int(doc[i]) if doc[i] != NO_ID else None, len(raw), *removed(raw, spans)))
            kinds = (*[pa.int64()] * 4, pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, CUT)


def removed(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, and the hash of what is left."""
    kept, at, n = hashlib.sha256(), 0, 0
    total = 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            n += 1
            kept.update(raw[at:a])
        if b > end:
            total += b - max(a, end)
            at = end = b
    kept.update(raw[at:])
    return total, n, kept.hexdigest()


def remove_repeats(docs: DataFrame, stored: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    stored: ``docs`` is a plain scan of files; otherwise it is first written to the shared folder.
    """
    spark = docs.sparkSession
    store.arrow_batches(spark)
    rows = scanned(docs, stored)
    n = bucket_number(rows)
    common = common_anchors(rows, n)
    firsts = store.materialise(first_contexts(rows, common, n), "contexts")
    several = firsts.select("a", "y").distinct().groupBy("a").count().where("count > 1")
    kind = F.when(F.col("count") > hot, 2).when(F.col("count") > 1, 1).otherwise(0).cast("int").alias("kind")
    first_path = by_file(firsts.join(several, "a", "left").select("file", "y", kind), "firsts")
    plain, hot_windows = shared_contexts(rows, common, first_path)
    inner = repeats_in_contexts(plain)
    if not several.where(F.col("count") > hot).isEmpty():
        hot_windows = store.materialise(hot_windows, "windows")
        best = hot_windows.groupBy("w", "w2").agg(F.min(F.struct("doc", "key", "first")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = hot_windows.join(best, ["w", "w2"]).where(F.struct("doc", "key", "first") != F.col("best"))
        inner = inner.unionByName(again.select("file", "doc", "key", "first", F.lit(1).cast("long").alias("windows")))
    return cut(rows, common, first_path, by_file(inner, "runs"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 100-byte strings."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
