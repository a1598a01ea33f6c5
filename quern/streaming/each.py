"""Programs over unbounded inputs.

A program of each-record mode is stateless, so its compiled form holds for a streaming
DataFrame as it stands.  ``windowed`` adds what the filter language has no words for: the
bags of a grouped program are those of event-time windows, closed by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import compile_each
from ..functions import kernel
from ..operators.bags import Aggregates, Bag, Unnumbered, flat, is_call, listed
from ..plans.columns import Row, Scope, Unsupported, Value, scalar, struct
from ..plans.parse import parse


def each(df: DataFrame, program: str) -> DataFrame:
    """The program's outputs for every record as it comes."""
    if not df.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return compile_each(parse(program, kernel.known()), df)


def windowed(df: DataFrame, program: str, time: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """group_by(keys) | map({...}) for every window of event time; rows come once the watermark has passed it."""
    stages = flat(parse(program, kernel.known()))
    if len(stages) != 2 or not is_call(stages[0], "group_by", 1) or not is_call(stages[1], "map", 1):
        raise Unsupported("a windowed program is group_by(keys) | map({...})")
    bag = Bag(df)
    row = bag.row()
    by, keys = [], {}
    for i, k in enumerate(listed(stages[0][2][0])):
        v = scalar(k, Scope(row))
        by.append(v.col.alias(f"__k{i}"))
        if k[0] == "index" and k[1] == ("id",):
            keys[k[2][1]] = Value(v.col, v.type)
    reader = Aggregates(bag, keys)
    try:
        out = scalar(stages[1][2][0], Scope(None, bag=reader))
    except Unnumbered:
        raise Unsupported("rows of a window have no order") from None
    if not isinstance(out, Row) or reader.needs_order:
        raise Unsupported("a windowed program's output is an object of keys and aggregates")
    frame = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    found = df.withWatermark(time, late).groupBy(frame.alias("__w"), *by).agg(*(struct(v).col.alias(k) for k, v in out.fields.items()))
    return found.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *out.fields)
