"""Mixing by iterative proportional fitting and calibrated sampling.

Tokens are added up by source, language and topic.  The expected tokens of every cell of these
start at the budget's share of its tokens and are raked: each dimension in turn scales the
cells of a value so that they sum to the value's target, but a cell gives no more than it has.
So the chances that come out, expected tokens over tokens, meet the targets of all three
dimensions as far as the cells allow.  A document is in the sample if the hash of its id
(of its text, without one) lies below its cell's chance.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, small_batches, stored
from .text import U, batch_words, mix

#: A topic is this many signs of random projections of a text's words, so 2^TOPIC_BITS topics.
TOPIC_BITS = 3
#: Exponents that flatten the shares of the tokens into target shares, where none are given.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.5}
#: Expected tokens of the sample, as a share of all.
BUDGET = 0.5
ROUNDS, TOLERANCE = 200, 1e-6
#: Cells that the driver rakes; a larger table is raked as a DataFrame, in the same way.
DRIVER_CELLS = 100_000
#: Cells that are broadcast to the documents; a larger table is joined by its keys.
BROADCAST_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")


def topics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, topic) of every text; -1 without a word of four bytes or more.

    Every such word pulls each bit of the topic one way or the other, by its hash, with the
    logarithm of its count; so texts that share most of their words mostly share their topic.
    """
    h, doc, length = batch_words(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n).astype(np.int64)
    long = length >= 4
    h, doc = h[long], doc[long]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    topic = np.full(n, -1, dtype=np.int32)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        pull = np.log1p(np.diff(np.append(first, len(h))))
        h, doc = mix(h[first]), doc[first]
        topic[doc] = 0
        for bit in range(TOPIC_BITS):
            way = np.where(h >> U(bit) & U(1), pull, -pull)
            topic += (np.bincount(doc, way, minlength=n) > 0).astype(np.int32) << bit
        topic[np.bincount(doc, minlength=n) == 0] = -1
    return count, topic


def with_topics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, n_tokens (words) and topic; null and empty texts have 0 and -1, every row has its own."""
    small_batches(docs.sparkSession)
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).alias("topic")).schema

    def run(batches):
        for batch in batches:
            n, topic = topics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n), pa.array(topic)], names=[*keep, "n_tokens", "topic"])

    return docs.select(*columns).mapInArrow(run, schema)


def goals(shares: dict, budget: float, given: dict | None, exponent: float) -> dict:
    """Target tokens of each value of a dimension from the values' tokens, adding up to the budget's share of all.

    given: shares of the sample by value; values that aren't in it divide what is left.
    Shares not given are the tokens' own, flattened by the exponent.  A value's target is
    no more than its tokens; what it can't give is divided among the others in proportion.
    """
    total = float(sum(shares.values()))
    flat = {v: (t / total) ** exponent if t > 0 else 0.0 for v, t in shares.items()}
    given = {v: float(x) for v, x in (given or {}).items() if shares.get(v, 0) > 0}
    if any(x < 0 or x != x for x in given.values()) or sum(given.values()) > 1 + 1e-9:
        raise ValueError("target shares must not be negative, nor add up to more than 1")
    rest = sum(x for v, x in flat.items() if v not in given)
    left = max(0.0, 1 - sum(given.values()))
    want = {v: given[v] if v in given else x / rest * left if rest else 0.0 for v, x in flat.items()}
    whole = sum(want.values()) or 1.0
    want = {v: x / whole * budget * total for v, x in want.items()}
    free = {v for v, x in want.items() if x > 0}
    for _ in range(len(want)):
        over = {v for v in free if want[v] > shares[v]}
        if not over:
            break
        spare = sum(want[v] - shares[v] for v in over)
        free -= over
        want |= {v: float(shares[v]) for v in over}
        some = sum(want[v] for v in free)
        if not some:
            break
        want |= {v: want[v] * (1 + spare / some) for v in free}
    return want


def rake(keys: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], start: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(expected tokens of cells, greatest miss of a target as a share of all targets); keys number the values of a dimension."""
    x, off = start.astype(float), 0.0
    for _ in range(rounds):
        off = 0.0
        for key, target in zip(keys, targets, strict=True):
            sums = np.bincount(key, x, minlength=len(target))
            off = max(off, float(np.abs(target - sums).max(initial=0)) / max(1.0, float(target.sum())))
            x = np.minimum(tokens, x * np.divide(target, sums, out=np.zeros(len(target)), where=sums > 0)[key])
        if off < tolerance:
            break
    return x, off


def _rake_table(cells: DataFrame, targets: dict, budget: float) -> tuple[DataFrame, float]:
    """rake() for a table of cells too large for the driver; targets: a table (k, goal) for every dimension."""
    now, off = cells.withColumn("x", F.col("tokens") * float(budget)), 0.0
    whole = max(1.0, targets[DIMENSIONS[0]].agg(F.coalesce(F.sum("goal"), F.lit(0.0))).first()[0])
    last = None
    for _ in range(ROUNDS):
        off = 0.0
        for c in DIMENSIONS:
            sums = now.groupBy(F.col(c).alias("k2")).agg(F.sum("x").alias("s"))
            steps = stored(targets[c].join(sums, F.col("k").eqNullSafe(F.col("k2"))).select("k", "goal", "s", F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(0.0).alias("step")), "steps")
            off = max(off, steps.agg(F.coalesce(F.max(F.abs(F.col("goal") - F.col("s"))), F.lit(0.0))).first()[0] / whole)
            now = stored(now.join(steps, now[c].eqNullSafe(steps.k)).select(*DIMENSIONS, "tokens", F.least(F.col("tokens").cast("double"), F.col("x") * F.col("step")).alias("x")), "cells")
            discard(steps)
            if last is not None:
                discard(last)
            last = now
        if off < TOLERANCE:
            break
    return now, off


def chances(rows: DataFrame, budget: float = BUDGET, targets: dict | None = None, exponents: dict = FLATTEN, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """((source, lang, topic, weight, probability), whether it has a checked, small size); rows: those columns and n_tokens.

    targets: for a dimension, the shares that values are to have of the sample, as in goals().
    weight is a cell's chance over the budget.  A null source or language is a value of its
    own.  Cells without tokens have weight 1 and the budget as their chance.  A warning tells
    of targets that the cells can't meet together, and by how much they are missed.
    """
    spark = rows.sparkSession
    targets = targets or {}
    if set(targets) - set(DIMENSIONS):
        raise ValueError(f"targets are for {', '.join(DIMENSIONS)}")
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    n = cells.count()
    if n > driver_cells:
        some = cells.where("tokens > 0")
        tables = {c: stored(_goal_table(some, c, budget, targets.get(c), exponents[c], driver_cells), "goals") for c in DIMENSIONS}
        raked, off = _rake_table(some, tables, budget)
        chance = F.col("x") / F.col("tokens")
        found = raked.select(*DIMENSIONS, (chance / budget).alias("weight"), chance.alias("probability"))
        found = found.union(cells.where("tokens = 0").select(*DIMENSIONS, F.lit(1.0), F.lit(float(budget))))
    else:
        got = cells.collect()
        tokens = np.array([r["tokens"] for r in got], dtype=float)
        chance, off = np.full(n, float(budget)), 0.0
        some = np.flatnonzero(tokens > 0)
        if len(some):
            keys, wanted = [], []
            for c in DIMENSIONS:
                values = {v: i for i, v in enumerate(dict.fromkeys(got[k][c] for k in some))}
                key = np.array([values[got[k][c]] for k in some])
                want = goals(dict(zip(values, np.bincount(key, tokens[some]), strict=True)), budget, targets.get(c), exponents[c])
                keys.append(key)
                wanted.append(np.array([want[v] for v in values]))
            x, off = rake(keys, tokens[some], wanted, tokens[some] * budget, ROUNDS, TOLERANCE)
            chance[some] = x / tokens[some]
        schema = rows.select(*DIMENSIONS).schema.add("weight", "double").add("probability", "double")
        found = spark.createDataFrame([(*(r[c] for c in DIMENSIONS), float(p / budget), float(p)) for r, p in zip(got, chance, strict=True)], schema)
    if off >= TOLERANCE:
        warnings.warn(f"the targets can't be met together: one is missed by {off:.2g} of the sample", stacklevel=2)
    return found, n <= BROADCAST_CELLS


def _goal_table(cells: DataFrame, c: str, budget: float, given: dict | None, exponent: float, most: int) -> DataFrame:
    """goals() of a dimension as a table; one of more values than ``most`` has few that pass their tokens, so it is done by rounds of joins."""
    shares = stored(cells.groupBy(F.col(c).alias("k")).agg(F.sum("tokens").cast("double").alias("t")), "shares")
    if shares.count() <= max(most, 1000):
        got = {r["k"]: r["t"] for r in shares.collect()}
        want = goals(got, budget, given, exponent)
        return cells.sparkSession.createDataFrame(list(want.items()), shares.select("k").schema.add("goal", "double"))
    total = shares.agg(F.sum("t")).first()[0]
    spark = cells.sparkSession
    flat = shares.withColumn("flat", F.pow(F.col("t") / total, F.lit(exponent)))
    if given:
        listed = spark.createDataFrame([(v, float(x)) for v, x in given.items()], shares.select("k").schema.fields[0].simpleString().replace(":", " ") + ", share double")
        flat = flat.join(F.broadcast(listed.withColumnRenamed("k", "k2")), F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2")
    else:
        flat = flat.withColumn("share", F.lit(None).cast("double"))
    sums = flat.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("g"), F.sum(F.when(F.col("share").isNull(), F.col("flat"))).alias("f")).first()
    want = F.coalesce(F.col("share"), F.col("flat") / (sums["f"] or 1.0) * max(0.0, 1 - sums["g"])) * budget * total
    now = stored(flat.select("k", "t", want.alias("goal"), F.lit(True).alias("free")), "goals")
    for _ in range(50):
        over = now.where("free AND goal > t").agg(F.sum(F.col("goal") - F.col("t"))).first()[0]
        if not over:
            break
        still = F.col("free") & (F.col("goal") <= F.col("t"))
        some = now.where(still).agg(F.sum("goal")).first()[0] or 0.0
        grown = F.when(still, F.col("goal") * (1 + over / some if some else 1.0)).otherwise(F.least("goal", "t"))
        now = stored(now.select("k", "t", grown.alias("goal"), still.alias("free")), "goals")
    return now.select("k", "goal")


def mixed(docs: DataFrame, keep: list[str], budget: float = BUDGET, targets: dict | None = None) -> DataFrame:
    """The ``keep`` columns with topic, n_tokens, weight, probability and selected.

    targets: shares of the sample by dimension and value, as {"lang": {"en": 0.6}}; the other
    values and dimensions have their own shares, flattened.  keep needs doc_id, source and
    lang.  Rows of equal ids, and rows of equal texts without an id, are drawn alike.  Null and empty
    texts have no tokens and the budget as their chance; very long texts count whole; an empty table gives no rows.
    """
    rows = stored(with_topics(docs, ["source", "lang"]).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n_tokens")), "tokens")
    cells, small = chances(rows, budget, targets)
    cells = cells.select(*(F.col(c).alias(f"cell_{c}") for c in DIMENSIONS), "weight", "probability")
    same = [F.col(c).eqNullSafe(F.col(f"cell_{c}")) for c in DIMENSIONS]
    every = [*keep] if "text" in keep else [*keep, "text"]
    joined = with_topics(docs, every).join(F.broadcast(cells) if small else cells, same)
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit("")))))
    draw = F.pmod(F.shiftrightunsigned(place, 11), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return joined.withColumn("selected", draw < F.col("probability")).select(*keep, "topic", "n_tokens", "weight", "probability", "selected")
