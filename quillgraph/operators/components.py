"""Connected components of any edge table, by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hangs its larger neighbours on its smallest neighbour (or itself)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hangs its smaller neighbours and itself on its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def _numbered(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The edges over numbers, and (id, number) of their vertices; numbers rise with the ids."""
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    # sorted over ranges and within them; written, as the numbers hold for one placement of rows
    named = scratch.keep(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id()))
    for c in ("a", "b"):
        edges = edges.join(named.toDF(c, f"n{c}").hint("merge"), c)
    return edges.select(F.col("na").alias("a"), F.col("nb").alias("b")), named


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every vertex of an edge table (a, b); component is its least vertex.

    Rounds end when no edge changes, about the logarithm of the longest path. Only counts and
    checksums reach the driver. Self edges and repeated edges change nothing; no edges, no rows.
    Vertices that are no numbers are numbered in their order first, so that rounds move and reduce numbers.
    """
    now, named = edges.select("a", "b").filter("a <> b"), None
    if edges.schema["a"].dataType != LongType():
        now, named = _numbered(scratch.keep(now), scratch)
    now = scratch.keep(now.distinct())
    said = None
    while True:
        after = scratch.keep(_small_star(_large_star(now).distinct()).distinct())
        scratch.drop(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == said:
            break
        said = seen
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
    if named is None:
        return found
    return found.join(named.toDF("name", "id").hint("merge"), "id").join(named.toDF("least", "component").hint("merge"), "component").select(F.col("name").alias("id"), F.col("least").alias("component"))
