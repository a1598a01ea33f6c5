"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the sets, chained by steps of at most BITS bits through the vantage-point
trees of ``simhash``, propose the pairs of a group, its first bucket.  At a similarity of 0.8 about 9.7 of 64 bits
differ, so the fingerprints can't reach all pairs; MinHash values in BANDS bands of ROWS values,
the other buckets, propose those that are left.  A pair of similarity s is proposed by them with the chance
1 - (1 - s**ROWS)**BANDS: all but 7 in a million at 0.8.  Every proposed pair is checked on
the texts' whole shingle sets.  Pairs are proposed in two steps.
First each row of a bucket meets the bucket's least row and the row before it.  Then rows
of a bucket that are in different components meet each other, all of them, where the bucket's
sets have been sent; those in one component by then need no comparison, a pair of several
buckets is checked in the first, and only links leave.  A bucket of more than BUCKET rows is dealt to several
tasks, each for two shares of its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .simhash import Links, majority, near_pairs
from .store import column, grouped, small_batches, stored

SEED = 42
WORDS = 5
#: Bits by which fingerprints of a SimHash group's steps differ, at most.
BITS = 5
BANDS, ROWS = 30, 5
#: Shingles, or rows of a bucket times rows, that are handled at once.
AT_ONCE = 1 << 12
#: Rows of a bucket that one task compares.
BUCKET = 1_024


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; one of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(max(1, len(words) - WORDS + 1))), dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """The bucket of a set in every band; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), AT_ONCE):
        least = np.minimum(least, (found[i : i + AT_ONCE, None] * _TIMES + _PLUS).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, fp, bands) of every row's shingle set."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            prints = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "digest", "size", "fp", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest long, size long, fp long, bands array<long>")


def with_groups(reps: DataFrame) -> DataFrame:
    """reps with the SimHash group of each set as the first of its bands; the empty set is in none."""
    prints = stored(reps.where("size > 0").groupBy("fp").agg(F.min("rep").alias("rep")), "prints")
    found = components(near_pairs(prints, BITS)).select(F.col("node").alias("rep"), "component")
    group = prints.join(found, "rep", "left").select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("component", "rep")).alias("group"))
    grouped_ = reps.where("size > 0").join(group, "fp").select("digest", "rep", "size", F.concat(F.array("group"), "bands").alias("bands"))
    return stored(grouped_.union(reps.where("size = 0").select("digest", "rep", "size", "bands")), "grouped")


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """Each row of a bucket with its least row and the row before it."""
    rows = Window.partitionBy("key").orderBy("digest")
    row = F.struct("digest", "size")
    met = buckets.select("digest", "size", F.first(row).over(rows).alias("least"), F.lag(row).over(rows).alias("last")).where("last IS NOT NULL")
    met = met.select("digest", "size", F.explode(F.array("least", "last")).alias("o"))
    fits = (5 * F.least("size", "o.size") >= 4 * F.greatest("size", "o.size")) & (F.col("o.digest") < F.col("digest"))
    return met.where(fits).select(F.col("o.digest").alias("a"), F.col("digest").alias("b"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(digest, rep, hashes) of the sets named by ids: (digest, rep)."""
    def sets(batches):
        for batch in batches:
            found = [shingles(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["digest", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids.select("rep").distinct(), "rep", "left_semi").select("text")
    # rows of equal ids may have other texts too
    return stored(texts.mapInArrow(sets, "digest long, hashes binary").join(ids, "digest").dropDuplicates(["digest"]).select("digest", "rep", "hashes"), "sets")


def _first_links(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): the least ids of those pairs of digests whose shingle sets are alike."""
    pairs = stored(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    held = _sets(docs, stored(reps.join(needed, "digest").select("digest", "rep"), "needed"))

    def compare(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            same = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(same)

    both = pairs.join(held.select(F.col("digest").alias("a"), F.col("rep").alias("ra"), F.col("hashes").alias("x")), "a").join(held.select(F.col("digest").alias("b"), F.col("rep").alias("rb"), F.col("hashes").alias("y")), "b")
    return stored(both.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "x", "y").mapInArrow(compare, "a long, b long"), "alike")


def _other_links(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between rows of a bucket that are in different components; placed: (digest, rep, size, component, bands)."""
    buckets = placed.select("digest", "rep", "size", "component", "bands", F.posexplode("bands").alias("band", "key"))
    mixed = stored(buckets.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "key", F.ceil(F.col("n") / BUCKET).cast("int").alias("shares")), "mixed")
    rows = stored(buckets.join(mixed, ["band", "key"]), "rows")
    held = _sets(docs, rows.select("digest", "rep").distinct())
    met = rows.withColumn("share", F.pmod(F.xxhash64("digest"), F.col("shares")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    met = met.select("band", "key", F.least("share", "other").alias("one"), F.greatest("share", "other").alias("two"), "share", "digest", "rep", "size", "component", "bands")
    met = met.join(held.select("digest", "hashes"), "digest")
    keys = ["band", "key", "one", "two"]

    def run(batches):
        for (band, _, one, two), parts in grouped(batches, keys):
            rep, size, of, share = (column(parts, c).to_numpy() for c in ("rep", "size", "component", "share"))
            buckets = np.array(column(parts, "bands").to_pylist(), dtype=np.int64)
            sets = [np.frombuffer(h, np.uint64) for h in column(parts, "hashes").to_pylist()]
            first = {}
            links = Links(len(rep))
            known = np.array([first.setdefault(c, i) for i, c in enumerate(of.tolist())])
            links.join(np.arange(len(rep)), known)
            left, right = np.flatnonzero(share == one), np.flatnonzero(share == two)
            out = []
            for i in left:
                root = links.find(right)
                some = right[(root != links.find(np.array([i]))[0]) & (right > i if one == two else True) & (5 * np.minimum(size[i], size[right]) >= 4 * np.maximum(size[i], size[right]))]
                if band:
                    some = some[~(buckets[some, :band] == buckets[i, :band]).any(axis=1)]
                for j in some:
                    if links.up[i] != links.up[j] and (links.find(np.array([i, j]))[0] != links.up[j]) and alike(sets[i], sets[j]):
                        links.join(np.array([i]), np.array([j]))
                        out.append((rep[i], rep[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in out], pa.int64()), pa.array([int(b) for _, b in out], pa.int64())], names=["a", "b"])

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select(*keys, "share", "rep", "size", "component", "bands", "hashes").repartition(4 * width, *keys).sortWithinPartitions(*keys)
    return stored(dealt.mapInArrow(run, "a long, b long"), "alike")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents linked by pairs of similarity 0.8 or more, directly or by others; component_id is the least id.

    Rows of equal ids are linked.  Rows of null ids are left out.  Null, empty and other texts
    without words are alike; very long texts count whole; other columns of docs are ignored; an empty table gives no rows.
    """
    rows = stored(sketches(docs.where("doc_id IS NOT NULL")), "sketches")
    reps = with_groups(stored(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("size", "fp", "bands"))), "reps"))
    ids = rows.groupBy("doc_id").agg(F.min("digest").alias("y"), F.max("digest").alias("z")).where("y <> z").select("doc_id")
    own = rows.join(ids, "doc_id").join(reps, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = _first_links(_first_pairs(reps.select("digest", "size", F.explode("bands").alias("key"))), docs, reps)
    linked = stored(components(first.union(own)), "linked")
    placed = reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", "size", F.coalesce("component", "rep").alias("component"), "bands")
    other = _other_links(placed, docs)
    found = components(first.union(other).union(own)).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    of = reps.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.select("doc_id", "digest").join(of, "digest").select("doc_id", "component_id")
