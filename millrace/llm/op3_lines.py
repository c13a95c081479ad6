"""Line dedup by a segment-partition edit join.

Lines (a text split at line feeds, ASCII white space stripped, empty ones ignored) are equal or near: both of ``LEAST``
characters or more and within ``EDITS`` insertions, deletions or substitutions of characters.  A line is removed unless
it is the first of its class, the component of equal and near lines; the order is doc_id, a hash of the text, place.

A line of length l is cut into EDITS + 1 even segments; a near line must hold one of them unchanged.  The index has
(l, segment number, segment) of every line; a line of length n probes, for each l from n - EDITS to n, only the
substrings whose place allows the rest to be matched within the threshold.  Keys are hashed.  A first scan deals the
keys, distinct in each piece of input, to buckets and keeps those that an index entry and a probe of different lines
share; a second scan brings the lines that hold such keys.  The lines of a key are resolved without listing their
pairs (``components.resolve``), and a pair is verified by banded bit-parallel edit distance, many pairs at a time.

Null and empty texts have no lines.  Rows that repeat both doc_id and text are one document with one result each; a
null doc_id comes first in the order.  Equal and near lines of one document are ties that the place settles.  A very
long text is one run of its own: a worker holds about 30 bytes for each of its characters.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, store
from .components import Union, resolve
from .files import NO_ID, Lookup, bucket_number, buckets_of, concatenated, file_runs, member, occurrence, scanned

EDITS, LEAST = 2, 24
GROUP = 512
CHUNK = 1 << 17
KEPT = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


class Lines:
    """The lines of a run of texts: text number, place, start and end in ``data`` (code points), hash."""

    def __init__(self, texts: list[str]):
        raw = "\n".join(texts) + "\n"
        data = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        text_end = np.cumsum([len(x) + 1 for x in texts]) - 1
        text = np.searchsorted(text_end, ends)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        solid = np.flatnonzero(~blank)
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = b > a
        self.text, self.data, self.raw = text[some], data, raw
        self.start, self.end = solid[a[some]], solid[b[some] - 1] + 1
        self.full = starts[some], ends[some]
        self.prefix = kernels.prefix_hash(data)
        self.hash = kernels.range_hash(self.prefix, self.start, self.end)
        self.place = np.arange(len(self.text)) - np.searchsorted(self.text, self.text)


def texts_of(batch):
    """(file, doc ids, keys, texts) for runs of rows of one file, about ``CHUNK`` characters each."""
    doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    texts = batch.column(3).to_pylist()
    for file, part in file_runs(batch):
        first, size = part.start, 0
        for i in range(part.start, part.stop):
            size += len(texts[i]) + 1
            if size >= CHUNK or i == part.stop - 1:
                yield file, doc[first : i + 1], key[first : i + 1], texts[first : i + 1]
                first, size = i + 1, 0


def segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of a segment of lines of these lengths; the last segments take what is left over."""
    base, more = length // (edits + 1), length % (edits + 1)
    longer = np.maximum(0, number - (edits + 1 - more))
    return number * base + longer, base + (number >= edits + 1 - more)


def keys_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int = EDITS, least: int = LEAST):
    """(line numbers, keys, whether of the index) of lines of at least ``least`` characters."""
    n = end - start
    out = []

    def add(lines, begin, size, length, number, index):
        tag = kernels.mix((length * (edits + 2) + number).astype(np.uint64))
        out.append((lines, kernels.mix(kernels.range_hash(prefix, start[lines] + begin, start[lines] + begin + size) + tag), index))

    own = np.flatnonzero(n >= least)
    for number in range(edits + 1):
        begin, size = segment(n[own], number, edits)
        add(own, begin, size, n[own], number, True)
        for shorter in range(edits + 1):
            lines = own[n[own] - shorter >= least]
            length = n[lines] - shorter
            begin, size = segment(length, number, edits)
            low, high = max(-number, shorter - (edits - number)), min(number, shorter + (edits - number))
            for shift in range(low, high + 1):
                at = begin + shift
                fits = (at >= 0) & (at + size <= n[lines])
                add(lines[fits], at[fits], size[fits], length[fits], number, False)
    return tuple(np.concatenate(x) for x in zip(*((a, k, np.full(len(a), i)) for a, k, i in out), strict=True))


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int = EDITS) -> np.ndarray:
    """Edit distance of each pair of code point arrays, edits + 1 if greater.

    The band of 2 * edits + 1 diagonals is the top of a 64-bit word that moves down the longer line with each
    character of the shorter one; vertical differences are its bits.  All pairs go through the same step together.
    """
    out = np.full(len(pairs), edits + 1)
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    order = [i for i in np.argsort([len(b) for _, b in pairs], kind="stable").tolist() if len(pairs[i][0]) - len(pairs[i][1]) <= edits]
    for s in range(0, len(order), 2048):
        own = order[s : s + 2048]
        out[own] = _banded([pairs[i][0] for i in own], [pairs[i][1] for i in own], edits)
    return out


def _banded(longer: list[np.ndarray], shorter: list[np.ndarray], edits: int) -> np.ndarray:
    one, band = np.uint64(1), 2 * edits + 1
    m, n = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    steps = int(n.max(initial=0))
    rows = np.full((steps + band + edits, len(m)), 0xFFFFFFFF, np.uint32)
    columns = np.full((steps, len(m)), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(longer, shorter, strict=True)):
        rows[edits : edits + len(x), k] = x
        columns[: len(y), k] = y
    plus = np.full(len(m), ((1 << (edits + 1)) - 1) << (63 - edits), np.uint64)
    minus = np.zeros(len(m), np.uint64)
    score = np.full(len(m), edits)
    for i in range(steps):
        match = np.zeros(len(m), np.uint64)
        for b in range(band):
            match |= (rows[i + b] == columns[i]).astype(np.uint64) << np.uint64(63 - 2 * edits + b)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(diagonal | plus), diagonal & plus
        tail = i - (m - edits)
        bit = one << (62 - np.clip(tail, 0, 62)).astype(np.uint64)
        change = np.where(tail < 0, (diagonal >> np.uint64(63)) == 0, ((up & bit) != 0).astype(np.int64) - ((down & bit) != 0))
        score = score + np.where(i < n, change, 0)
        shifted = diagonal >> one
        plus, minus = down | ~(shifted | up), shifted & up
    return np.minimum(score, edits + 1)


def first_pass(rows: DataFrame, n: int, edits: int, least: int) -> DataFrame:
    """kind 0: every line hash (h) of a file with its first occurrence there and how often; kind 1: shared keys (h) of a file."""
    names = ["kind", "bucket", "file", "h", "doc", "key", "place", "n"]
    kinds = "kind int, bucket int, file long, h binary, doc binary, key binary, place binary, n binary"

    def emit(batches):
        import pyarrow as pa

        held, keyed, count, file = [], [], 0, None

        def flush():
            out = []
            h, doc, key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, key, doc, h))
            first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.empty(0, np.int64)
            times, order = np.diff([*first.tolist(), len(h)]), order[first]
            parts = [x[order] for x in (h, doc, key)] + [place[order].astype(np.int32), times.astype(np.int32)]
            out += [(0, b, file, *blobs) for b, *blobs in buckets_of(parts, parts[0], n)]
            k, line, index = (np.concatenate(x) for x in zip(*keyed, strict=True))
            order = np.lexsort((line, index, k))
            k, line, index = k[order], line[order], index[order]
            same = (k[1:] == k[:-1]) & (index[1:] == index[:-1])
            new = np.concatenate(([True], ~same | (line[1:] != line[:-1]))) if len(k) else np.empty(0, bool)
            k, line, index = k[new], line[new], index[new]
            same = (k[2:] == k[:-2]) & (index[2:] == index[:-2])  # two lines of a key and kind tell all that is asked
            keep = np.concatenate((np.ones(min(2, len(k)), bool), ~same))
            parts = [k[keep], line[keep] << np.uint64(1) | index[keep]]  # 63 bits tell lines apart
            out += [(1, b, file, *blobs, None, None, None) for b, *blobs in buckets_of(parts, parts[0], n)]
            held.clear()
            keyed.clear()
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for f, doc, key, texts in texts_of(batch):
                if held and (f != file or count > 60_000):
                    yield flush()
                    count = 0
                file, lines = f, Lines(texts)
                held.append((lines.hash, doc[lines.text], key[lines.text], lines.place))
                line, k, index = keys_of(lines.prefix, lines.start, lines.end, edits, least)
                keyed.append((k, lines.hash[line], index))
                count += len(lines.hash)
        if held:
            yield flush()

    def meet(kind: int, file, h, doc, key, place, times):
        size = [len(x) // 8 for x in h]
        file, h = np.repeat(np.array(file, np.int64), size), concatenated(h, np.uint64)
        if kind == 0:
            columns = [concatenated(x, t).astype(np.int64) for x, t in ((doc, np.int64), (key, np.int64), (place, np.int32), (times, np.int32))]
            return [np.zeros(len(h), np.int32), file, h.astype(np.int64), *columns]
        mark = concatenated(doc, np.uint64)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        index, line = (mark[order] & np.uint64(1)).astype(bool), mark[order] >> np.uint64(1)
        low, high = np.minimum.reduceat(line, starts), np.maximum.reduceat(line, starts)
        shared = (low < high) & np.logical_or.reduceat(index, starts) & np.logical_or.reduceat(~index, starts)
        keep = np.zeros(len(h), bool)
        keep[order] = np.repeat(shared, np.diff([*starts.tolist(), len(h)]))
        file, h = file[keep], h[keep].astype(np.int64)
        order = np.lexsort((h, file))
        file, h = file[order], h[order]
        new = np.concatenate(([True], (file[1:] != file[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.empty(0, bool)
        file, h = file[new], h[new]
        return [np.ones(len(h), np.int32), file, h, *[np.zeros(len(h), np.int64)] * 4]

    def met(batches):
        import pyarrow as pa

        def found():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in meet(of[0], *zip(*held, strict=True))], names=["kind", *names[2:]])

        of, held = None, []
        for batch in batches:
            for kind, bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, bucket) != of:
                    if held:
                        yield found()
                    of, held = (kind, bucket), []
                held.append(row)
        if held:
            yield found()

    dealt = rows.mapInArrow(emit, kinds).repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return store.stored(dealt, "lines", met, "kind int, file long, h long, doc long, key long, place long, n long")


def candidates(rows: DataFrame, shared: str, edits: int, least: int) -> DataFrame:
    """line (hash), text, keys of the lines that hold shared keys; a line may come from several places."""

    def emit(batches):
        import pyarrow as pa

        look, seen, file = Lookup(shared), set(), None
        for batch in batches:
            out = []
            for f, _, _, texts in texts_of(batch):
                if f != file or len(seen) > 1 << 20:
                    seen, file = set(), f
                lines = Lines(texts)
                line, k, _ = keys_of(lines.prefix, lines.start, lines.end, edits, least)
                keep = member(k, look.sorted(f, "h"))
                line, k = line[keep], k[keep].astype(np.int64)
                order = np.argsort(line, kind="stable")
                line, k = line[order], k[order]
                for i, own in zip(*_grouped(line, k), strict=True):
                    h = int(lines.hash[i])
                    if h not in seen:
                        seen.add(h)
                        out.append((int(np.int64(lines.hash[i])), lines.raw[lines.start[i] : lines.end[i]], np.unique(own)))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64()))], names=["line", "text", "keys"])

    return store.stored(rows, "candidates", emit, "line long, text string, keys array<long>")


def _grouped(line: np.ndarray, k: np.ndarray):
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
    return line[starts].tolist(), np.split(k, starts[1:]) if len(line) else []


def near(edges: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The edges (centre, member) of lines within the threshold."""
    counts = edges.groupBy("centre").count().select("centre", F.ceil(F.col("count") / GROUP).cast("int").alias("groups"))
    members = edges.join(counts, "centre").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("groups")).cast("int"))
    members = members.select("centre", "salt", F.lit(1).alias("side"), F.col("member").alias("line"))
    centres = counts.select("centre", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("centre").alias("line"))
    rows = members.unionByName(centres).join(texts, "line").select("centre", "salt", "side", "line", "text")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "side")

    def run(batches):
        import pyarrow as pa

        own = np.empty(0, np.uint32)
        for batch in batches:
            head, side, line, text = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            pairs, ends = [], []
            for c, s, x, t in zip(head, side, line, text, strict=True):
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                if s == 0:
                    own = points
                else:
                    pairs.append((own, points))
                    ends.append((c, x))
            ok = distances(pairs, edits) <= edits if pairs else np.zeros(0, bool)
            found = [e for e, o in zip(ends, ok, strict=True) if o]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return store.stored(rows, "links", run, "a long, b long")


def joining_pairs(lines: list[str], owners: list, edits: int) -> list[tuple[int, int]]:
    """Pairs of lines within the threshold that join the owners' components.

    Every pair of different owners whose lengths differ by at most ``edits`` is met; one edit changes the counts of
    characters (by their last six bits) by two at most, which rules most pairs out before distances are computed.
    """
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in lines]
    size = np.array([len(p) for p in points])
    counts = np.stack([np.bincount(p & 63, minlength=64) for p in points]).astype(np.int16)
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], size[order] + edits, "right")
    union, out = Union(owners), []
    waiting: list[tuple[int, int]] = []

    def verify():
        pairs = [(i, j) for i, j in waiting if union.top(i) != union.top(j)]
        waiting.clear()
        for (i, j), d in zip(pairs, distances([(points[i], points[j]) for i, j in pairs], edits).tolist(), strict=True):
            if d <= edits and union.join(i, j):
                out.append((i, j))

    labels = np.array(union.labels())
    for k, i in enumerate(order.tolist()):
        later = order[k + 1 : ends[k]]
        later = later[labels[later] != labels[i]]
        if len(later):
            later = later[np.abs(counts[later] - counts[i]).sum(1) <= 2 * edits]
            waiting += [(i, j) for j in later.tolist()]
        if len(waiting) >= 4096:
            verify()
            labels = np.array(union.labels())
    verify()
    return out


def without_lines(rows: DataFrame, listed: str) -> DataFrame:
    """Cut every document.  listed: for each file the lines (h) of classes with several occurrences, and the occurrence (y) that stays."""

    def run(batches):
        import pyarrow as pa

        look = Lookup(listed)
        for batch in batches:
            out = []
            for file, doc, key, texts in texts_of(batch):
                lines = Lines(texts)
                stays = occurrence(doc[lines.text], key[lines.text], lines.place)
                gone = member(lines.hash, look.sorted(file, "h")) & ~member(stays, look.sorted(file, "y"))
                at = np.searchsorted(lines.text, np.arange(len(texts) + 1))
                drop = {t: [] for t in lines.text[gone].tolist()}
                for t, s, e in zip(lines.text[gone].tolist(), lines.full[0][gone].tolist(), lines.full[1][gone].tolist(), strict=True):
                    drop[t].append((s, e))
                base = 0
                for i, text in enumerate(texts):
                    kept = text if i not in drop else _without(text, [(s - base, e - base) for s, e in drop[i]])
                    sha = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((int(doc[i]) if doc[i] != NO_ID else None, int(at[i + 1] - at[i]), len(drop.get(i, ())), sha))
                    base += len(text) + 1
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True)], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return store.stored(rows, "cut", run, KEPT)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these lines and their line feeds."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e + 1
    return "".join(parts) + text[at:]


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, stored: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text without the removed lines) of every document."""
    spark = docs.sparkSession
    store.arrow_batches(spark)
    rows = scanned(docs, stored)
    n = bucket_number(rows)
    found = first_pass(rows, n, edits, least)
    lines = found.where("kind = 0").drop("kind")
    shared = store.new_path(spark, "keys")
    store.write_parts(found.where("kind = 1").select("file", "h").repartition("file").sortWithinPartitions("file"), shared, by="file")
    texts = candidates(rows, shared, edits, least)
    members = texts.select(F.col("line").alias("doc"), F.explode("keys").alias("bucket")).distinct()
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    one_text = texts.groupBy("line").agg(F.min("text").alias("text"))
    values = one_text.select(F.col("line").alias("doc"), F.col("text").alias("value"))
    solve = lambda own, owners: joining_pairs(own, owners, edits)
    classes = resolve(members.join(sizes, "bucket"), lambda some: some.join(values, "doc"), lambda edges: near(edges, one_text, edits), solve)
    owned = lines.join(classes.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("component", "h"))
    best = owned.groupBy("class").agg(F.min(F.struct("doc", "key", "place")).alias("best"), F.sum("n").alias("times")).where("times > 1")
    listed = owned.join(best, "class")
    first = F.struct("doc", "key", "place") == F.col("best")
    listed = listed.select("file", "h", "doc", "key", "place", first.alias("first"))

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            doc, key, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            y = occurrence(doc, key, place).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(b.column(5).to_numpy(zero_copy_only=False), y, 0))], names=["file", "h", "y"])

    stays = store.new_path(spark, "classes")
    store.write_parts(listed.repartition("file").sortWithinPartitions("file"), stays, hashed, "file")
    return without_lines(rows, stays)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated and near-repeated lines."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
