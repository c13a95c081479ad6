"""Steps that scan the documents again and look up what earlier steps found, without shuffling a text.

Scanned rows are (file, doc, key, text): a hash of the input file's name and of the run of ``UNIT`` rows in it, the
doc_id, a hash of the text, the text.  What a step finds for such a unit is a table in the shared folder that is
partitioned by ``file``; a task loads the parts of the units that it scans, whatever its splits are and however large
the files.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, store

NO_ID = -(1 << 63)
#: Rows of an input file, as a power of two, whose findings are one part; input bytes that one bucket of hashes is for.
UNIT, BUCKET = 14, 1 << 27


def scanned(docs: DataFrame, stored: bool) -> DataFrame:
    """file, doc, key, text of documents; null ids are the least integer, null texts empty.

    stored: ``docs`` is a plain scan of files; otherwise it is first written to the shared folder.
    """
    columns = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")]
    base = docs.select(*columns, "_metadata") if stored else store.materialise(docs.select(*columns), "documents")
    unit = F.xxhash64(F.col("_metadata.file_path"), F.shiftright(F.col("_metadata.row_index"), UNIT))
    return base.select(unit.alias("file"), "doc", F.xxhash64("text").alias("key"), "text")


def bucket_number(rows: DataFrame) -> int:
    """How many buckets hashes of these rows are dealt to: it grows with the input, so a bucket doesn't."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def occurrence(doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One hash for each (doc_id, key, place)."""
    h = kernels.mix(doc.astype(np.uint64) * np.uint64(kernels.BASE) + key.astype(np.uint64))
    return kernels.mix(h * np.uint64(kernels.BASE) + place.astype(np.uint64))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


class Lookup:
    """What a step has found for one input file, from a table partitioned by ``file``."""

    def __init__(self, path: str):
        self.path, self.file, self.table = path, None, {}

    def of(self, file: int) -> dict:
        """The columns of the file's rows as arrays."""
        if file != self.file:
            from pyarrow import dataset, fs

            files, top = store.filesystem(self.path)
            place = f"{top}/file={file}"
            self.file, self.table = file, {}
            if files.get_file_info(place).type == fs.FileType.Directory:
                table = dataset.dataset(place, filesystem=files, format="parquet").to_table()
                self.table = {c: table.column(c).to_numpy() for c in table.column_names}
        return self.table

    def sorted(self, file: int, column: str) -> np.ndarray:
        """A column of the file's rows as sorted hashes."""
        table = self.of(file)
        if ("sorted", column) not in table:
            table["sorted", column] = np.sort(table.get(column, np.empty(0, np.int64)).view(np.uint64))
        return table["sorted", column]


def by_file(df: DataFrame, name: str) -> str:
    """Write ``df``, partitioned by its column ``file``; the path."""
    path = store.new_path(df.sparkSession, name)
    df.repartition("file").write.partitionBy("file").parquet(path)
    return path


def file_runs(batch):
    """(file, rows) for runs of rows of one file."""
    file = batch.column(0).to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
    for a, b in itertools.pairwise(cut):
        if a < b:
            yield int(file[a]), slice(a, b)


def buckets_of(parts: list[np.ndarray], key: np.ndarray, n: int):
    """(bucket, blob of each array) with the rows dealt by ``key``."""
    which = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[order], np.arange(n + 1))
    parts = [p[order] for p in parts]
    for b in range(n):
        if cut[b] < cut[b + 1]:
            yield (b, *(p[cut[b] : cut[b + 1]].tobytes() for p in parts))


def concatenated(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)
