"""Tables kept in the shared folder, and rows grouped inside a partition."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.ship import ship

#: Rows in one Arrow batch: texts can be very long, so few.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that Python workers get to a few rows, and let the workers import this package.

    The setting stays, since plans are made when they run; a smaller one of the caller's is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "0"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir, deleted when the driver's JVM ends.

    Only a local session may do without the setting, as tests do; elsewhere executors couldn't see the driver's own folder.
    """
    context = spark.sparkContext
    held = getattr(context, "_quern_folder", None)
    if held:
        return held
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif context.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="quern-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    held = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(held)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    context._quern_folder = held
    return held


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of equal keys over batches that come sorted by them: (key, columns as lists of pieces)."""
    now, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        at = 0
        while at < len(marks):
            end = at + 1
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            part = batch.slice(at, end - at)
            if marks[at] != now:
                if held is not None:
                    yield now, held
                now, held = marks[at], []
            held.append(part)
            at = end
    if held is not None:
        yield now, held


def column(parts: list[pa.RecordBatch], name: str) -> pa.ChunkedArray:
    return pa.chunked_array([p.column(p.schema.get_field_index(name)) for p in parts])
