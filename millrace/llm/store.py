"""Places that all executors share.

Intermediate tables and token files go below ``spark.checkpoint.dir``, the folder that the cluster names.  Where
the setting is absent (tests, a laptop) a temporary folder of the driver is used, which only local mode can share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return (found if "://" in found else "file://" + found).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that a worker holds before it writes a row group.
GROUP_ROWS, GROUP_BYTES = 1 << 17, 1 << 24


def write_parts(df: DataFrame, path: str, step: Callable | None = None, by: str | None = None) -> None:
    """Write ``df``, or what ``step`` (as for mapInArrow) makes of it, as Parquet files that Python workers write.

    Spark's own writer starts a process (chmod) up to four times for each file of a folder that Hadoop reaches without
    its native library, and until that process runs it shares, and is counted with, the whole memory of the executor.
    by: a column by whose runs of equal values each task's rows are parted into folders.  Attempts write elsewhere; the
    driver moves the files of those that succeeded, so a task that runs twice leaves its rows once.
    """
    draft = f"{path}-attempts"
    for place in (draft, path):
        files, top = filesystem(place)
        files.create_dir(top)

    def run(batches):
        import pyarrow as pa
        from pyarrow import parquet

        files, top = filesystem(draft)
        names: list[tuple[str, str]] = []
        held: list = []
        writer, value = None, None

        def flush():
            nonlocal writer
            if held:
                if writer is None:
                    names.append(("" if by is None else f"{by}={value}", f"{uuid.uuid4().hex}.parquet"))
                    writer = parquet.ParquetWriter(f"{top}/{names[-1][1]}", held[0].schema, filesystem=files)
                writer.write_table(pa.Table.from_batches(held))
                held.clear()

        def close():
            nonlocal writer
            flush()
            if writer is not None:
                writer.close()
                writer = None

        rows = size = 0
        for batch in step(batches) if step else batches:
            for x, part in [(None, batch)] if by is None else _runs(batch, by):
                if not part.num_rows:
                    continue
                if x != value:
                    close()
                    value, rows, size = x, 0, 0
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows >= GROUP_ROWS or size >= GROUP_BYTES:
                    flush()
                    rows = size = 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n[i] for n in names], pa.string()) for i in (0, 1)], names=["folder", "name"])

    written = df.mapInArrow(run, "folder string, name string").collect()
    (files, source), (_, target) = filesystem(draft), filesystem(path)
    for folder in {r["folder"] for r in written} - {""}:
        files.create_dir(f"{target}/{folder}")
    for folder, name in written:
        files.move(f"{source}/{name}", f"{target}/{folder}/{name}" if folder else f"{target}/{name}")
    files.delete_dir(source)


def _runs(batch, by: str):
    """(value, rows without that column) for runs of rows with one value of ``by``."""
    values, rest = batch.column(batch.schema.get_field_index(by)).to_pylist(), batch.drop_columns([by])
    cut = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
    for a, b in zip(cut, [*cut[1:], len(values)], strict=True):
        yield values[a], rest.slice(a, b - a)


def stored(df: DataFrame, name: str, step: Callable | None = None, schema: str | None = None) -> DataFrame:
    """``materialise`` by ``write_parts``; schema: of what ``step`` makes of the rows."""
    path = new_path(df.sparkSession, name)
    write_parts(df, path, step)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialise`` or ``stored`` wrote; no later plan may read it."""
    session = df.sparkSession
    files = df.inputFiles()
    if files:
        path = session._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 25) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes, so that long documents don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; also works in a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
