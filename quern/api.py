"""Run a program of the filter language over a table, a Parquet path or JSON text."""

from __future__ import annotations

import datetime
import functools
import itertools
import os
import warnings
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernel
from .functions.reader import events
from .operators.bags import Bag, flat, piped, run_bag
from .plans.columns import Scope, Unsupported, Value, pieces
from .plans.inline import inline
from .plans.needs import needed
from .plans.parse import parse
from .sources.records import Job, calls, evaluate, read
from .sources.ship import ship

#: Rows of a side table that an interpreted program may read whole.
SIDE_ROWS = 1_000_000
RESULT = "value string, error string, note string"


def run(
    spark: SparkSession, source, program: str, mode: str = "each", args: dict | None = None, tables: dict | None = None, raw: bool = False, stream: bool = False, whole_text: bool = False, native: bool | None = None, filename: str | None = None, positional: list | None = None
) -> DataFrame:
    """The program's outputs as rows.

    source: a DataFrame, a Parquet path, or a path or list of paths of JSON text (a record a line; with
    whole_text, any number of values of any layout a file).  mode: "each" record, "slurp" (all as
    one array) or "null".  args: values of variables; tables: DataFrames that variables
    stand for, as arrays of their rows; positional: $ARGS.positional.  raw: lines are strings.  stream: records are events.

    Over typed tables the program is compiled to DataFrame operators, and the outputs are
    typed columns (one column ``value`` unless an output is an object).  Where it can't be, or
    native is False, the row interpreter runs it and the outputs are JSON text: ``value``, and
    ``error`` for a record whose evaluation failed, after the outputs it had.  A slurped program
    that can't be compiled sees all rows in one task, as its meaning demands.
    """
    df = source
    if isinstance(source, str):
        df = spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else [source]
    tables, args = tables or {}, args or {}
    tree = parse(program, kernel.known(), [*args, *tables])
    if native is not False and not (stream or raw or args or mode == "null") and isinstance(df, DataFrame):
        flat_tree = inline(tree)
        try:
            return compile_each(flat_tree, df) if mode == "each" else run_bag(flat_tree, df, tables)
        except Unsupported as why:
            if native:
                raise
            if mode == "slurp":
                warnings.warn(f"the program isn't compiled ({why}): all rows are read into one task", stacklevel=2)
    held = {k: side_rows(k, t) for k, t in tables.items()}
    job = Job(tree, mode, args, positional or [], held, raw, stream, environment=dict(os.environ) if calls(tree, {"env", "ENV"}) else {})
    return interpret(spark, job, df, whole_text, filename).select("value", "error")


def side_rows(name: str, table: DataFrame) -> list:
    """The rows of a table that an interpreted program reads whole, if they are few enough to send to every task."""
    rows = table.limit(SIDE_ROWS + 1).collect()
    if len(rows) > SIDE_ROWS:
        raise ValueError(f"${name} has more than {SIDE_ROWS} rows, too many for a program that isn't compiled")
    return [plain(r.asDict(recursive=True)) for r in rows]


def compile_each(tree, df: DataFrame) -> DataFrame:
    """A stateless transformation of each row; it holds for streaming DataFrames as well."""
    stages = flat(tree)
    at = next((i for i, s in enumerate(stages) if s[0] == "each"), None)
    if at is not None and not any(s[0] == "as" for s in stages[:at]):
        condition, v = pieces(piped([*stages[:at], stages[at][1]]), Scope(Bag(df).row()))
        if not isinstance(v, Value) or v.type.typeName() != "array":
            raise Unsupported("each of this kind")
        rows = df if condition is None else df.where(condition)
        rows = rows.select(F.explode(v.col).alias("value"))
        return compile_each_value(stages[at + 1 :], rows, v.type.elementType)
    condition, out = pieces(tree, Scope(Bag(df).row()))
    return Bag(df).project(out, condition).result()


def compile_each_value(stages: list, rows: DataFrame, kind) -> DataFrame:
    if not stages:
        return rows
    condition, out = pieces(piped(stages), Scope(Value(F.col("value"), kind)))
    return Bag(rows, True).project(out, condition).result()


def plain(x):
    """A column's value as a JSON value; times are seconds since 1970."""
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, (int, float, Decimal)):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=x.tzinfo or datetime.UTC).timestamp()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day, tzinfo=datetime.UTC).timestamp()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    raise TypeError(f"columns of {type(x).__name__} aren't JSON values")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["value", "error", "note"])


def _batches(rows, size: int = 1000):
    while held := list(itertools.islice(rows, size)):
        yield _batch(held)


def texts(spark: SparkSession, paths: list[str], whole: bool) -> DataFrame:
    """The files' texts, whole or a line each, in the order given: value and file.

    Without files, one partition without rows, where a program of null input still runs once.
    """
    if not paths:
        return spark.range(0, 1, 1, 1).where("id < 0").select(F.lit("").alias("value"), F.lit("").alias("file"))
    frames = [(spark.read.text(p, wholetext=True) if whole else spark.read.option("lineSep", "\n").text(p)).select("value", F.lit(p).alias("file")) for p in paths]
    return functools.reduce(DataFrame.unionAll, frames)


def interpret(spark: SparkSession, job: Job, source, whole: bool = False, filename: str | None = None) -> DataFrame:
    """The job's rows (value, error, note) over a table, or over the texts of a list of paths.

    A program that reads further inputs, or all of them, sees the records in order in one task.
    """
    ship(spark)
    text = source is None or isinstance(source, list)
    whole = whole or (job.raw and job.mode == "slurp")
    df = texts(spark, source or [], whole) if text else source
    if not text and job.mode == "each" and not job.stream and (fields := needed(job.tree)) is not None:
        df = df.select(*([F.col(f"`{c}`") for c in df.columns if c in fields] or [F.lit(True).alias("row")]))

    def parts(batches):
        for batch in batches:
            yield from zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)

    def rows(batches):
        def feed(run):
            if text:
                return read(((f, t if whole or job.raw else t + "\n") for f, t in parts(batches)), job, run)
            run.filename = filename
            found = (plain(row) for batch in batches for row in batch.to_pylist())
            return ((x, None) for v in found for x in (events(v) if job.stream else [v]))

        yield from _batches(evaluate(job, feed, (lambda: (t for _, t in parts(batches))) if text else None))

    if job.mode != "each" or calls(job.tree, {"input", "inputs"}):
        df = df.coalesce(1)
    return df.mapInArrow(rows, RESULT)
