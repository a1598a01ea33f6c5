"""SimHash fingerprints, and exact pairs by vantage-point trees over Hamming distance.

A pair of 64-bit fingerprints that differ in at most ``bits`` places differs in at most
``bits // 3`` places in one of three blocks of the word.  For each block there is a
vantage-point tree: a level has one vantage point, and its branches are the exact
Hamming distances to it within the block.  By the triangle inequality the distances of a
pair to any vantage point differ by no more than the pair's own distance, and have the
parity of that distance; all other branches are pruned.  The first levels, as many as the
table's size asks for, cut it into shards, to which boundary-overlapping fingerprints are also sent;
a crowded shard is dealt to several tasks, each for two shares of its rows.  Further levels are walked inside a shard, and pairs that are left, and not yet
connected by others, are compared over all 64 bits.
Trees over the whole word prune hardly anything (a level of rings keeps 0.6 of all
pairs within 4 bits), trees over blocks prune to about a third a level.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import column, grouped, small_batches, stored

SEED = 42
BLOCKS = 3
#: Rows of a shard on average, at most; a level cuts a table into about eight parts of like size.
SHARD_ROWS, PARTS = 2_000, 8
#: Rows of a shard that one task walks: this part of all fingerprints, within these bounds.
SHARD_PART, SHARD_LEAST, SHARD_MOST = 16, 1_024, 65_536
DEEP_LEVELS = 14
#: Comparisons below which a branch is not split further.
LEAF = 1 << 16


def fingerprint(text: bytes, size: int = 4) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(body, SEED)
    starts = [0, *(e + 1 for e in ends[:-1])]
    return majority(np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)), dtype=np.uint64, count=len(words) - size + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the signed 64-bit form. Null and empty texts have 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[int]:
    cuts = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _vantage(tree: int, level: int) -> int:
    return xxhash.xxh64_intdigest(f"vantage {tree} {level}", SEED)


def _rings(fps: np.ndarray, tree: int, level: int) -> np.ndarray:
    """Distances within the tree's block to the level's vantage point."""
    return np.bitwise_count((fps ^ np.uint64(_vantage(tree, level))) & np.uint64(_masks()[tree])).astype(np.int64)


def _moves(radius: int, levels: int) -> list[tuple[int, ...]]:
    """Branch shifts that a pair within radius in the block can have: one of a pair and its mirror image, without the zero shift."""
    found = set()
    for distance in range(1, radius + 1):
        shifts = [s for s in range(-distance, distance + 1) if (s - distance) % 2 == 0]
        partial = [()]
        for _ in range(levels):
            partial = [(*p, s) for p in partial for s in shifts]
        found.update(partial)
    return sorted(m for m in found if m > (0,) * levels)


class Links:
    """Nodes joined so far; join() takes index pairs, most of them joined already."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The least node that each node is joined to; only the paths of these nodes are shortened."""
        r = self.up[x]
        while not np.array_equal(above := self.up[r], r):
            r = above
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.find(a), self.find(b)
            if not (new := ra != rb).any():
                return
            a, b = a[new], b[new]
            np.minimum.at(self.up, np.maximum(ra, rb)[new], np.minimum(ra, rb)[new])

    def joined(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether all of these are joined already."""
        r = self.find(a)
        return bool((r == r[0]).all() and (self.find(b) == r[0]).all())

    @property
    def root(self) -> np.ndarray:
        return self.find(np.arange(len(self.up)))


def _compare(a, b, same, fps, bits, links) -> None:
    if same and len(a) > 8:
        # in a group of near copies one row reaches most, and only the others meet all
        near = np.bitwise_count(fps[a[0]] ^ fps[a]) <= bits
        if 4 * near.sum() > len(a):
            links.join(np.full(near.sum(), a[0]), a[near])
            a = a[~near]
    step = max(1, LEAF * 4 // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(fps[a[i : i + step], None] ^ fps[None, b]) <= bits)
        if len(x):
            links.join(a[i : i + step][x], b[y])


def _search(a, b, same, tree, level, radius, bits, fps, rings, links) -> None:
    """Link the pairs of a and b; same: a and b are one set."""
    if links.joined(a, b):
        return
    if len(a) * len(b) <= LEAF or level >= DEEP_LEVELS:
        _compare(a, b, same, fps, bits, links)
        return
    if level not in rings:
        rings[level] = _rings(fps, tree, level)
    ra, rb = rings[level][a], rings[level][b]
    for r in np.unique(ra):
        mine = a[ra == r]
        for s in range(0 if same else -radius, radius + 1):
            other = mine if same and s == 0 else b[rb == r + s]
            if len(other):
                _search(mine, other, same and s == 0, tree, level + 1, radius, bits, fps, rings, links)


def near_pairs(reps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): links that connect exactly the nodes whose fingerprints are chained by steps of at most ``bits``.

    reps: (fp, rep), fp distinct, a stored table.  Inside a shard only a spanning set of links is kept.
    """
    spark = reps.sparkSession
    radius = bits // BLOCKS
    n = reps.count()
    levels = max(1, min(DEEP_LEVELS, math.ceil(math.log(max(1, n) / SHARD_ROWS) / math.log(PARTS))))
    most = max(SHARD_LEAST, min(SHARD_MOST, n // SHARD_PART))
    keys = ["tree", *(f"r{i}" for i in range(levels))]
    moves = [(0,) * levels, *_moves(radius, levels)]

    def signed(x: int):
        return F.lit(x - (1 << 64) if x >> 63 else x)

    cells = []
    for tree, mask in enumerate(_masks()):
        home = [F.bit_count(F.col("fp").bitwiseXOR(signed(_vantage(tree, i))).bitwiseAND(signed(mask))) for i in range(levels)]
        cells += [F.struct(F.lit(tree).alias("tree"), *((h + F.lit(m)).alias(f"r{i}") for i, (h, m) in enumerate(zip(home, move, strict=True))), F.lit(k > 0).alias("visits")) for k, move in enumerate(moves)]
    rows = reps.select("fp", "rep", F.explode(F.array(*cells)).alias("cell")).select("cell.*", "fp", "rep")
    full = stored(rows.groupBy(*keys).count().where(F.col("count") > most), "full")
    crowded = full.count()
    if crowded:
        shares = full.select(*(F.col(k).alias(f"full_{k}") for k in keys), F.ceil(F.col("count") / most).cast("int").alias("shares"))
        same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"full_{k}") for k in keys))
        met = rows.join(F.broadcast(shares) if crowded < 100_000 else shares, same, "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        met = met.withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        rows = met.select(*keys, F.least("share", "other").alias("one"), F.greatest("share", "other").alias("two"), "share", "visits", "fp", "rep")
    else:
        rows = rows.select(*keys, F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("share"), "visits", "fp", "rep")

    def link(batches):
        for key, parts in grouped(batches, [*keys, "one", "two"]):
            fps = column(parts, "fp").to_numpy().view(np.uint64)
            reps_ = column(parts, "rep").to_numpy()
            visits, share = column(parts, "visits").to_numpy(), column(parts, "share").to_numpy()
            one, two = key[-2], key[-1]
            home, guests = [np.flatnonzero(~visits & (share == s)) for s in (one, two)], [np.flatnonzero(visits & (share == s)) for s in (one, two)]
            sides = [(home[0], home[0], True), (guests[0], home[0], False)] if one == two else [(home[0], home[1], False), (guests[0], home[1], False), (guests[1], home[0], False)]
            links = Links(len(fps))
            rings: dict = {}
            for a, b, same in sides:
                if len(a) and len(b):
                    _search(a, b, same, key[0], levels, radius, bits, fps, rings, links)
            root = links.root
            linked = np.flatnonzero(root != np.arange(len(fps)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(reps_[linked]), pa.array(reps_[root[linked]])], names=["a", "b"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = rows.repartition(4 * width, *keys, "one", "two").sortWithinPartitions(*keys, "one", "two")
    return shards.mapInArrow(link, "a long, b long")


def near_groups(docs: DataFrame, bits: int = 4, size: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents linked directly or by others whose fingerprints differ in at most ``bits`` places.

    Null and empty texts have fingerprint 0, which links like any other; very long texts count
    whole.  Rows of null ids link nothing; they have the component of the rows with their own
    fingerprint, or null.  Equal ids share their rows' links; other columns of docs are
    ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, size), "fingerprints")
    reps = stored(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    same_id = fps.groupBy("doc_id").agg(F.min("fp").alias("one"), F.max("fp").alias("n")).where("one <> n AND doc_id IS NOT NULL").select("doc_id")
    own = fps.join(same_id, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(near_pairs(reps, bits).union(own))
    of = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp", "left").select("doc_id", "fp", "component_id")
