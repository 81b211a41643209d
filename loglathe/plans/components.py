"""Connected components by least-label propagation with pointer jumping, each round cut with a reliable checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``; where that is unset (tests), in a folder under the warehouse."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the least id reachable."""
    both = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("component"))
        heads = closer.select(F.col("id").alias("head"), F.col("component").alias("jump"))
        new = _cut(closer.join(heads, closer["component"] == heads["head"]).select("id", F.least("component", "jump").alias("component")))
        old = labels.select("id", F.col("component").alias("old"))
        same = new.join(old, "id").where("component != old").isEmpty()
        labels = new
        if same:
            return labels
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
