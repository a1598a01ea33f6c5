"""JSON text in and out: framing of records, output layouts and the report of a run."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reader import Reader
from ..functions.values import dumps, truthy
from .ship import ship


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records a line, the files in the order given: value, and input_filename."""
    frames = [spark.read.option("lineSep", "\n").text(p).select(F.lit(i).alias("file_no"), F.monotonically_increasing_id().alias("record_no"), F.lit(p).alias("input_filename"), "value") for i, p in enumerate(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The values of files in any layout (pretty-printed, concatenated), one row a value, as compact JSON text."""
    ship(spark)

    def split(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [dumps(v) for v in Reader(text).values()]}, schema=pa.schema([("value", pa.string())]))

    return spark.read.text(path, wholetext=True).mapInArrow(split, "value string")


def rendered(df: DataFrame, indent: int | str | None = None, sort_keys: bool = False, raw: bool = False, ascii_only: bool = False) -> DataFrame:
    """Output text of JSON results: indented (a number of spaces, or a tab), with sorted keys, raw strings or escapes only."""
    ship(df.sparkSession)
    if isinstance(indent, int) and not 0 <= indent <= 7:
        raise ValueError("cannot indent by more than 7 spaces")

    def put(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                v = next(Reader(text).values())
                out.append(v if raw and isinstance(v, str) and not ascii_only else dumps(v, indent, sort_keys, ascii_only))
            yield pa.RecordBatch.from_pydict({"value": out}, schema=pa.schema([("value", pa.string())]))

    return df.where("value IS NOT NULL").select("value").mapInArrow(put, "value string")


def write(df: DataFrame, path: str, separator: str = "\n") -> None:
    """The values of a run's result as text files."""
    df.where("value IS NOT NULL").select("value").write.option("lineSep", separator).text(path)


@dataclass
class Report:
    """What a run came to: its exit code and the messages of its errors, at most ``shown`` of them."""

    code: int
    errors: list[str]


def report(df: DataFrame, exit_status: bool = False, shown: int = 100) -> Report:
    """0, 5 if records failed, a halt's own code; with exit_status 4 without output and 1 if the last was null or false."""
    errors = [r["error"] for r in df.where("error IS NOT NULL").select("error").limit(shown).collect()]
    halted = df.where("error RLIKE '^halt -?[0-9]+:'").select("error").head(1)
    if halted:
        return Report(int(halted[0]["error"].split()[1].rstrip(":")), errors)
    if errors:
        return Report(5, errors)
    if exit_status:
        last = df.where("value IS NOT NULL").select("value").tail(1)
        if not last:
            return Report(4, errors)
        return Report(0 if truthy(next(Reader(last[0]["value"]).values())) else 1, errors)
    return Report(0, errors)
