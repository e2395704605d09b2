"""Connected components of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import Scratch, discard, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (hi, lo) after each node hands neighbours to the smallest of them and itself: the larger
    neighbours (a large star), or the smaller ones and itself (a small star)."""
    if large:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    handed = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return handed.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node in ``links`` (two long columns); the root is the component's smallest node.

    Large and small stars in turn, until no link changes; chains, in whatever order of their
    numbers, and cycles shrink by a factor in each round, so rounds grow with the logarithm
    of a component's length.  Every round's links are a table in the shared folder, and the
    result is one that ``scratch`` deletes.  Nulls and links of a node with itself count for
    nothing; an empty table has no nodes.
    """
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    now = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{links.columns[0]}` is not null and `{links.columns[1]}` is not null and hi <> lo").distinct(), "links")
    digest = [F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))]
    before = now.agg(*digest).head()
    while before[0]:
        new = stored(_star(_star(now, True), False), "links")
        discard(now)
        now, after = new, new.agg(*digest).head()
        if after == before:
            break
        before = after
    if scratch is not None:
        scratch.tables.append(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
