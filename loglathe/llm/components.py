"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every id of ``edges`` (columns a, b): component is the least id reachable.

    Each round sends every node's larger (then smaller) neighbours to its least neighbour. The minimum is a partial
    aggregate, and the join back is an ordinary equi-join that adaptive execution can split, so a hub with a third
    of all edges is never gathered in a task. Rounds are written to the shared folder; the loop stops when the edge
    set no longer changes (logarithmically many rounds; more than ``max_rounds`` are an error). Only one row of counts reaches the driver per round.
    """
    a, b = F.col("a"), F.col("b")
    current = materialise(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), tag)

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: (a > b). Large: every neighbour above u goes to the least of u's neighbours and u. Small: those below."""
        way = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = way.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else way
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("m", "u").alias("m"))
        joined = both.join(least, F.col("u") == F.col("lu"))
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("lu").alias("a"), F.col("m").alias("b")))
        return out.where(a != b).distinct()

    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64("b", "a")), F.sum(F.shiftright(h, 40))).first())

    after, rounds = mark(current), 0
    before = None if after[0] else after
    while after != before:
        if rounds == max_rounds:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
        current, before, rounds = materialise(star(star(current, True), False), tag), after, rounds + 1
        after = mark(current)
    pairs = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
