"""Connected components of a link table, found by repeated joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stored

#: Links for each file of a round's tables.
FILE_LINKS = 50_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each linked node reaches; links: (a, b), any order.

    Every round each node keeps its smallest neighbour as its parent, its other
    smaller neighbours are linked to that parent, and the parent is replaced by its own
    parent.  So chains halve and stars stay; no node's neighbours are ever gathered in
    one place, and what joins on a hub is a plain equi-join, which adaptive execution
    splits.  Rows with a null end or two equal ends count for nothing.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), F.col("a").alias("x"), F.col("b").alias("y"))
        .where("x IS NOT NULL AND y IS NOT NULL AND hi <> lo").select("hi", "lo").distinct(),
        "links",
    )
    # a round's tables are no larger than the links: few links in many files cost more than they hold
    files = max(1, math.ceil(edges.count() / FILE_LINKS))
    for _ in range(rounds):
        parent = stored(edges.groupBy("hi").agg(F.min("lo").alias("up"), F.count("*").alias("n")).coalesce(files), "parents")
        above = parent.select(F.col("hi").alias("up"), F.col("up").alias("top"))
        jumped = parent.join(above, "up", "left").select("hi", "up", "n", "top")
        left = jumped.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count("top").alias("t")).first()
        if left["n"] <= 1 and not left["t"]:
            return parent.select(F.col("hi").alias("node"), F.col("up").alias("component")).union(
                parent.select(F.col("up").alias("node"), F.col("up").alias("component")).distinct()
            )
        several = parent.where("n > 1").select("hi", "up")
        hung = edges.join(several, "hi").where("lo <> up").select(F.col("lo").alias("hi"), F.col("up").alias("lo"))
        moved = jumped.select("hi", F.coalesce("top", "up").alias("lo"))
        last, edges = edges, stored(moved.union(hung).distinct().coalesce(files), "links")
        discard(last)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
