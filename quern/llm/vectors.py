"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length 1, rotated and rounded to SCALE steps, so that cosine >= c is squared
distance <= 2 - 2c, give or take the rounding, whose bound is part of every radius.  The vector is split into
blocks; a linked pair is within its block's proportional share of that squared distance in one block at
least.  For each block the first coordinates are cut into cells; a vector is sent, whole, to its own cell and
to the neighbours that its ball reaches, and cells are range-joined under the block's budget.  A pair that is
within budget in several blocks counts in the first of them.

Pairs are verified where they meet.  The rounded vectors decide all but those whose cosine is within the
rounding's bound of the threshold, and those few are verified with the vectors themselves in double precision.
What leaves a cell is a count of links for each vector and links that span its groups, no more
rows than came in, whatever the number of pairs.  A crowded cell is dealt to several tasks,
each for two shares of its rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import Links
from .store import column, grouped, small_batches, stored

BLOCKS = 8
#: Coordinates of a block that make its cells: GRID for up to GRID_ROWS vectors, one more each time there are 2.2 times as many.
GRID, GRID_ROWS, GRID_MOST = 3, 500_000, 6
#: Steps of a coordinate of length 1.
SCALE = 32767
#: Rows of a cell that one task compares with each other: this part of all vectors, within these bounds.
CELL_PART, CELL_LEAST, CELL_MOST = 8, 512, 32_768
#: Comparisons at once.
AT_ONCE = 1 << 21


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector_col: str, negated: bool = False) -> DataFrame:
    """(vec_id, v): vectors with only finite components, not all zero; negated: the other rows, null ids among them."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    known = F.col(id_col).cast("long").isNotNull()
    return vectors.where(~(fine & known) if negated else fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class Shape:
    """How vectors of one length are cut: blocks, radii and cells."""

    def __init__(self, dim: int, cosine: float, rows: int) -> None:
        self.dim, self.cosine = dim, cosine
        self.turn = rotation(dim)
        blocks = min(BLOCKS, dim)
        self.cuts = [dim * b // blocks for b in range(blocks + 1)]
        # rounding moves a difference by one step a coordinate at most
        whole = math.sqrt(max(0.0, 2 - 2 * cosine)) * SCALE + math.sqrt(dim) + 1
        self.budget = [whole**2 * (b - a) / dim for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.slack = 2.5 * math.sqrt(dim) / SCALE + 1e-5 + 2e-7 * dim
        more = max(0, math.ceil(math.log(max(1, rows) / GRID_ROWS) / math.log(2.2)))
        self.grid = min(GRID + more, GRID_MOST, dim // blocks)
        self.crowd = max(CELL_LEAST, min(CELL_MOST, (1 << 26) // (6 * dim), rows // CELL_PART))
        self.keys = ["block", *(f"g{i}" for i in range(self.grid))]

    def rounded(self, v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        x = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.turn
        return np.rint(x * SCALE).astype(np.int16)

    def cells(self, q: np.ndarray):
        """(block, cells, visiting or not, numbers of the vectors that go there)."""
        for b, (lo, _) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            part, radius = q[:, lo : lo + self.grid].astype(np.float64), math.sqrt(self.budget[b])
            wide = 2 * radius
            home = np.floor(part / wide).astype(np.int64)
            below, above = (part - home * wide) ** 2, ((home + 1) * wide - part) ** 2
            for move in np.ndindex(*(3,) * self.grid):
                shift = np.array(move) - 1
                if tuple(shift) < (0,) * self.grid:
                    continue  # of two neighbours the lesser visits the greater
                gap = sum((above[:, i] if s > 0 else below[:, i] for i, s in enumerate(shift) if s), np.zeros(len(q)))
                near = np.flatnonzero(gap <= radius**2)
                if len(near):
                    yield b, (home + shift)[near].astype(np.int32), bool(shift.any()), near

    def close(self, x: np.ndarray, q: np.ndarray, b: int, left: np.ndarray, right: np.ndarray, ordered: bool):
        """(left, right, sure) of pairs that count in block b and may be linked; ordered: only where left < right.  x: q as floats."""
        lo, hi = self.cuts[b], self.cuts[b + 1]
        part = x[:, lo:hi]
        size = (part * part).sum(axis=1)
        step = max(1, AT_ONCE // max(1, len(right)))
        for i in range(0, len(left), step):
            mine = left[i : i + step]
            apart = size[mine, None] + size[None, right] - 2 * (part[mine] @ part[right].T)
            fits = apart <= self.budget[b] + 2e-6 * SCALE**2
            if ordered:
                fits &= mine[:, None] < right[None]
            r, c = np.nonzero(fits)
            for k in range(0, len(r), AT_ONCE // 64):
                p, o = mine[r[k : k + AT_ONCE // 64]], right[c[k : k + AT_ONCE // 64]]
                cosine = np.einsum("ij,ij->i", x[p], x[o]) / SCALE**2
                some = cosine >= self.cosine - self.slack
                if not some.any():
                    continue
                p, o, cosine = p[some], o[some], cosine[some]
                apart_ = (q[p].astype(np.int64) - q[o]) ** 2
                here = np.ones(len(p), dtype=bool)
                for j in range(b):  # counted in an earlier block
                    here &= apart_[:, self.cuts[j] : self.cuts[j + 1]].sum(axis=1) > self.budget[j]
                here &= apart_[:, lo:hi].sum(axis=1) <= self.budget[b]
                if here.any():
                    yield p[here], o[here], cosine[here] >= self.cosine + self.slack


def found_links(classes: DataFrame, cosine: float, dim: int) -> DataFrame:
    """(a, b, n): rows without b count n links of a; rows with both and n = 1 are links, with n = 0 pairs to be verified.

    classes: (rep, copies, v), all of length dim.
    """
    spark = classes.sparkSession
    shape = Shape(dim, cosine, classes.count())
    keys = shape.keys

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = shape.rounded(np.array(batch.column(2).to_pylist(), dtype=np.float64))
            raw = np.array([p.tobytes() for p in q], dtype=object)
            for b, cell, visits, near in shape.cells(q):
                some = pa.array(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), b, np.int32)), *(pa.array(cell[:, i]) for i in range(shape.grid)), pa.array(np.full(len(near), visits)), batch.column(0).take(some), batch.column(1).take(some), pa.array(raw[near], pa.binary())],
                    names=[*keys, "visits", "rep", "copies", "q"],
                )

    def places(batches):
        for batch in batches:
            if batch.num_rows:
                for b, cell, _, near in shape.cells(shape.rounded(np.array(batch.column(0).to_pylist(), dtype=np.float64))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), b, np.int32)), *(pa.array(cell[:, i]) for i in range(shape.grid))], names=keys)

    def meet(batches):
        for key, parts in grouped(batches, [*keys, "one", "two"]):
            ids, copies = column(parts, "rep").to_numpy(), column(parts, "copies").to_numpy()
            visits, share = column(parts, "visits").to_numpy(), column(parts, "share").to_numpy()
            q = np.frombuffer(b"".join(column(parts, "q").to_pylist()), dtype=np.int16).reshape(-1, dim)
            x, one, two = q.astype(np.float32), key[-2], key[-1]
            links, count, open_ = Links(len(ids)), np.zeros(len(ids), dtype=np.int64), []
            sides = [(np.flatnonzero(~visits & (share == one)), np.flatnonzero(~visits & (share == two)), one == two), (np.flatnonzero(visits & (share == one)), np.flatnonzero(~visits & (share == two)), False)]
            if one != two:
                sides.append((np.flatnonzero(visits & (share == two)), np.flatnonzero(~visits & (share == one)), False))
            for left, right, ordered in sides:
                if not len(left) or not len(right):
                    continue
                for p, o, sure in shape.close(x, q, key[0], left, right, ordered):
                    np.add.at(count, p[sure], copies[o[sure]])
                    np.add.at(count, o[sure], copies[p[sure]])
                    links.join(p[sure], o[sure])
                    open_.append((p[~sure], o[~sure]))
            root = links.root
            some, linked = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(ids)))
            p, o = (np.concatenate(y) for y in zip(*open_, strict=True)) if open_ else (np.zeros(0, np.int64),) * 2
            for a, b, n in ((ids[some], None, count[some]), (ids[linked], ids[root[linked]], np.ones(len(linked), np.int64)), (ids[p], ids[o], np.zeros(len(p), np.int64))):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n)], names=["a", "b", "n"])

    schema = ", ".join(f"{k} int" for k in keys)
    cells = classes.select("rep", "copies", "v").mapInArrow(spread, schema + ", visits boolean, rep long, copies long, q binary")
    full = stored(classes.select("v").mapInArrow(places, schema).groupBy(*keys).count().where(F.col("count") > shape.crowd), "full")
    crowded = full.count()
    none = F.lit(0)
    if crowded:
        shares = full.select(*(F.col(k).alias(f"full_{k}") for k in keys), F.ceil(F.col("count") / shape.crowd).cast("int").alias("shares"))
        same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"full_{k}") for k in keys))
        met = cells.join(F.broadcast(shares) if crowded < 100_000 else shares, same, "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        met = met.withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")).withColumn("other", F.explode(F.sequence(none, F.col("shares") - 1)))
        cells = met.withColumn("one", F.least("share", "other")).withColumn("two", F.greatest("share", "other")).select(*cells.columns, "share", "one", "two")
    else:
        cells = cells.select("*", none.alias("share"), none.alias("one"), none.alias("two"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(4 * width, *keys, "one", "two").sortWithinPartitions(*keys, "one", "two")
    return dealt.mapInArrow(meet, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, links being pairs of cosine >= ``cosine``.

    Equal vectors are compared once and count as often as they occur.  Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths never link.  A null id keeps its row, with 0 links.  Rows of
    equal ids are vectors of their own; their links lead to the same id.  Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = usable(vectors, id_col, vector_col).where("vec_id IS NOT NULL")
    rows = stored(good.select("vec_id", F.xxhash64("v").alias("h"), "v"), "vectors")
    classes = stored(rows.groupBy("h", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("rep"), "least", "copies", "v", "h"), "classes")
    dims = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    found = spark.createDataFrame([], "a long, b long, n long")
    for dim in dims:
        found = found.union(found_links(classes.where(F.size("v") == dim), cosine, dim))
    found = stored(found, "found")
    left = classes.select(F.col("rep").alias("a"), F.col("copies").alias("na"), F.col("v").alias("va"))
    right = classes.select(F.col("rep").alias("b"), F.col("copies").alias("nb"), F.col("v").alias("vb"))
    met = found.where("b IS NOT NULL AND n = 0").select("a", "b").join(left, "a").join(right, "b")

    def verify(batches):
        for batch in batches:
            if batch.num_rows:
                va, vb = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), dtype=np.float64) for c in ("va", "vb"))
                va, vb = (x / np.abs(x).max(axis=1, keepdims=True) for x in (va, vb))
                dot = (va * vb).sum(axis=1) / np.sqrt((va * va).sum(axis=1) * (vb * vb).sum(axis=1))
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(dot >= cosine))

    close = stored(reduce(DataFrame.union, [met.where(F.size("va") == d).select("a", "b", "na", "nb", "va", "vb").mapInArrow(verify, "a long, b long, na long, nb long") for d in dims] or [spark.createDataFrame([], "a long, b long, na long, nb long")]), "close")
    counts = found.where("b IS NULL").select(F.col("a").alias("rep"), "n").union(close.select("a", "nb")).union(close.select("b", "na")).groupBy("rep").agg(F.sum("n").alias("links"))
    # links between classes, and between the classes of one id
    ids = rows.groupBy("vec_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("vec_id")
    own = rows.join(ids, "vec_id").join(classes.select("h", "v", "least"), ["h", "v"]).select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    named = classes.select(F.col("rep"), F.col("least"))
    between = found.where("b IS NOT NULL AND n = 1").select("a", "b").union(close.select("a", "b"))
    between = between.join(named.select(F.col("rep").alias("a"), F.col("least").alias("la")), "a").join(named.select(F.col("rep").alias("b"), F.col("least").alias("lb")), "b")
    reached = components(between.select(F.col("la").alias("a"), F.col("lb").alias("b")).union(own)).withColumnRenamed("node", "least")
    of = classes.select("rep", "least", "copies", "h", "v").join(counts, "rep", "left").join(reached, "least", "left")
    of = of.select(F.col("h").alias("h2"), F.col("v").alias("v2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    known = rows.join(of, (rows.h == of.h2) & (rows.v == of.v2)).select("vec_id", "n_links", "component_id")
    alone = usable(vectors, id_col, vector_col, negated=True)
    rest = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
