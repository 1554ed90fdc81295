"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodcast.llm.common import discard, materialise


SALTS = 8   # tasks that share the edges of one node at least


def _is_stars(e: DataFrame) -> bool:
    """Every node has one larger end at most, and no node is both a larger and a smaller end."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    worst = ends.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).agg(
        F.max("a").alias("a"), F.max(F.col("a") * F.col("b")).alias("ab")).first()
    return (worst["a"] or 0) <= 1 and not worst["ab"]


def _with_minimum(e: DataFrame, low: DataFrame) -> DataFrame:
    """``e`` joined with the minimum of each u; the edges of one node are dealt over salts."""
    salted = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return salted.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))),
                       ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``u``, ``v``: long); root is the
    smallest node of the component.

    Each round points nodes at the smallest node they can see (large-star, then
    small-star), as joins and partial minima only, until all edges form stars;
    the rounds grow with the logarithm of the longest path. Edges are written to
    the shared folder after each round. An empty edge table gives an empty
    result; nulls are ignored.
    """
    def table(df: DataFrame) -> DataFrame:
        return materialise(df.where("u <> v").distinct(), "edges")

    e = table(edges.where("u is not null and v is not null")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while not _is_stars(e):
        # large-star: every larger neighbour points at the smallest neighbour (or the node itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        big = _with_minimum(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small-star: every smaller neighbour, and the node, point at the smallest one
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_minimum(big, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = table(small.unionByName(low.select("u", F.col("m").alias("v"))))
        discard(e)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
