"""Joins on a range: .[] as $x | $t[] as $y | select($y.k > $x.a and $y.k < $x.b and …).

A nested loop compares every row with every other.  Here the values of k are cut into bins at
their quantiles, a row of the other side is sent to every bin that its range [a, b] meets, and
only rows of a bin are compared, with the whole condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import Scope, Value, condition, is_num, is_time, num, scalar

#: Bins; a range that meets all of them copies its row so often, which its matches would anyway.
BINS = 1024
#: Rows of either side below which Spark broadcasts and loops, which is no slower.
SMALL = 10_000


def conjuncts(node) -> list:
    return [*conjuncts(node[1]), *conjuncts(node[2])] if node[0] == "and" else [node]


def side(node, names: tuple) -> str | None:
    """The only one of the variables that a filter reads."""
    seen = set()

    def walk(n):
        if isinstance(n, tuple):
            if len(n) == 2 and n[0] == "var":
                seen.add(n[1])
            for x in n:
                walk(x)

    walk(node)
    return next(iter(seen)) if len(seen) == 1 and seen <= set(names) else None


def bounds(on, scope: Scope, point: str, other: str):
    """(point's column, its least, its greatest) where the condition bounds a value of one side on both ends by values of the other."""
    found: dict = {}
    for c in conjuncts(on):
        if c[0] != "binary" or c[1] not in ("<", "<=", ">", ">="):
            if c[0] == "binary" and c[1] == "==" and {side(c[2], (point, other)), side(c[3], (point, other))} == {point, other}:
                return None  # an equality makes a hash join of it
            continue
        a, b, op = c[2], c[3], c[1]
        if side(a, (point, other)) == other:
            a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
        if side(a, (point, other)) != point or side(b, (point, other)) != other:
            continue
        found.setdefault(repr(a), {"of": a})["high" if op[0] == "<" else "low"] = b
    for f in found.values():
        if "low" in f and "high" in f:
            v = [scalar(f[k], scope) for k in ("of", "low", "high")]
            if all(isinstance(x, Value) and (is_num(x) or is_time(x)) for x in v):
                return [num(x) for x in v]
    return None


def _places(cuts: list[float], step: int = 32):
    """The number of cuts below a value, found in two steps."""
    every = F.array(*(F.lit(c) for c in cuts))
    some = F.array(*(F.lit(c) for c in cuts[step - 1 :: step])) if len(cuts) >= step else None

    def of(x):
        first = F.size(F.filter(some, lambda e: e < x)) * step if some is not None else F.lit(0)
        return first + F.size(F.filter(F.slice(every, first + 1, step), lambda e: e < x))

    return of


def binned(left: DataFrame, right: DataFrame, on, scope: Scope, left_name: str, right_name: str) -> DataFrame | None:
    """left and right joined where the condition holds; None if it bounds no range, or the tables are small."""
    for points, spans, names in ((right, left, (right_name, left_name)), (left, right, (left_name, right_name))):
        found = bounds(on, scope, *names)
        if found is None:
            continue
        if points.limit(SMALL + 1).count() <= SMALL or spans.limit(SMALL + 1).count() <= SMALL:
            return None
        k, low, high = found
        known = points.select(k.alias("k")).where("k IS NOT NULL AND NOT isnan(k)")
        cuts = sorted(set(known.approxQuantile("k", [i / BINS for i in range(1, BINS)], 0.5 / BINS)))
        if not cuts:
            return None
        bin_of = _places(cuts)
        # a null or NaN is less than every number, so it bounds nothing from below and all from above
        least = F.when(low.isNull() | F.isnan(low), 0).otherwise(bin_of(low))
        most = F.when(high.isNull() | F.isnan(high), -1).otherwise(bin_of(high))
        homes = points.withColumn("__bin", F.when(k.isNull() | F.isnan(k), 0).otherwise(bin_of(k)))
        reached = F.when(least <= F.greatest(most, F.lit(0)), F.sequence(least, F.greatest(most, F.lit(0))))
        sent = spans.withColumn("__bins", F.explode(reached))
        met = homes.join(sent, (F.col("__bin") == F.col("__bins")) & condition(scalar(on, scope)))
        return met.drop("__bin", "__bins")
    return None
