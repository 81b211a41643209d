"""IPLOM: iterative partitioning by token count, by the position of least cardinality, by the mapping of two positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import tokenized
from ..plans.components import _cut

#: What is told of partitions is broadcast to the lines up to so many rows; a join would gather a large partition's lines in a task.
BROADCAST = 100_000


def _small(side: DataFrame) -> DataFrame:
    """``side``, computed once, with a broadcast hint where it is small."""
    done = _cut(side)
    return F.broadcast(done) if done.count() <= BROADCAST else done


def _cardinalities(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition: its rows (size) and ``card``, the distinct tokens of each position in order."""
    words = rows.select(*keys, F.posexplode("tokens").alias("pos", "word")).groupBy(*keys, "pos", "word").agg(F.count("*").alias("c"))
    by_pos = words.groupBy(*keys, "pos").agg(F.count("*").alias("d"), F.sum("c").alias("size"))
    return by_pos.groupBy(*keys).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("card"))


def stage1(lines: DataFrame) -> DataFrame:
    """line_id, tokens, n (token count)."""
    return tokenized(lines).withColumn("n", F.size("tokens"))


def stage2(rows: DataFrame) -> DataFrame:
    """Adds split_pos and p2: the token at the first position of least cardinality; null in partitions of one row (or of empty lines)."""
    least = F.array_min(F.transform("card", lambda e: e["d"]))
    first = F.element_at(F.filter("card", lambda e: e["d"] == least), 1)["pos"]
    cut = _cardinalities(rows, ["n"]).select("n", F.when(F.col("size") > 1, first).alias("split_pos"))
    return rows.join(_small(cut), "n", "left").withColumn("p2", F.get("tokens", F.col("split_pos")))


def _two_positions() -> Column:
    """Of ``card``: the first two positions of the cardinality (not 1) that most positions share, else the two least."""
    moving = F.filter("card", lambda e: e["d"] != 1)
    share = lambda d: F.filter(moving, lambda e: e["d"] == d)
    ranked = F.array_sort(F.transform(moving, lambda e: F.struct((-F.size(share(e["d"]))).alias("c"), e["pos"].alias("pos"), e["d"].alias("d"))))
    top = F.element_at(ranked, 1)
    least = F.slice(F.array_sort(F.transform(moving, lambda e: F.struct(e["d"].alias("d"), e["pos"].alias("pos")))), 1, 2)
    chosen = F.when(top["c"] <= -2, F.transform(F.slice(share(top["d"]), 1, 2), lambda e: e["pos"])).otherwise(F.transform(least, lambda e: e["pos"]))
    return F.when(F.size(moving) >= 2, chosen)


def stage3(rows: DataFrame, lower_bound: float = 0.3) -> DataFrame:
    """Adds kind (one, 1-1, 1-M, M-1, M-M) and p3, which tells the final partitions of a stage-2 partition apart."""
    card = _cardinalities(rows.where("n > 0"), ["n", "p2"]).select(F.col("n").alias("n_"), F.col("p2").alias("p2_"), F.when(F.col("size") > 1, _two_positions()).alias("two"))
    cut = rows.join(_small(card), (F.col("n") == F.col("n_")) & F.col("p2").eqNullSafe(F.col("p2_")), "left").drop("n_", "p2_")
    cut = cut.withColumn("l", F.get("tokens", F.get("two", F.lit(0)))).withColumn("r", F.get("tokens", F.get("two", F.lit(1))))
    part = ["n", "p2"]
    pairs = cut.where("l is not null").groupBy(*part, "l", "r").agg(F.count("*").alias("c"))

    # Pairs are distinct, so a count over a value is its number of partners.
    left, right = (Window.partitionBy(*part, side) for side in ("l", "r"))
    full = pairs.select("*", F.count("*").over(left).alias("dl"), F.sum("c").over(left).alias("l_c"))
    full = full.select("*", F.count("*").over(right).alias("dr"), F.sum("c").over(right).alias("r_c"), F.max("dl").over(right).alias("r_dl"))
    full = full.withColumn("l_dr", F.max("dr").over(left))

    def joined(rows: DataFrame, stats: DataFrame, *on: str, small: bool = False) -> DataFrame:
        """A left join by partition and ``on``; p2 can be null, so it is compared null-safely."""
        side = stats.select(*(F.col(c).alias(f"{c}__") if c in (*part, *on) else F.col(c) for c in stats.columns))
        same_part = (F.col("n") == F.col("n__")) & F.col("p2").eqNullSafe(F.col("p2__"))
        for c in on:
            same_part = same_part & (F.col(c) == F.col(f"{c}__"))
        return rows.join(_small(side) if small else side, same_part, "left").drop(*(f"{c}__" for c in (*part, *on)))

    kind = (
        F.when((F.col("dl") == 1) & (F.col("dr") == 1), "1-1")
        .when((F.col("dl") > 1) & (F.col("l_dr") == 1), "1-M")
        .when((F.col("dr") > 1) & (F.col("r_dl") == 1), "M-1")
        .otherwise("M-M")
    )
    full = full.withColumn("kind", kind)
    many = full.where("kind = 'M-M'").groupBy(*part).agg(F.count_distinct("l").alias("ml"), F.count_distinct("r").alias("mr"))
    full = joined(full, many)
    # The bounds compare the share of distinct values on the many side among the mapping's rows.
    p3 = (
        F.when(F.col("kind") == "1-1", F.to_json(F.struct("l", "r")))
        .when(F.col("kind") == "1-M", F.when(F.col("dl") / F.col("l_c") <= lower_bound, F.to_json(F.struct("l", "r"))).otherwise(F.to_json(F.struct("l"))))
        .when(F.col("kind") == "M-1", F.when(F.col("dr") / F.col("r_c") <= lower_bound, F.to_json(F.struct("r"))).otherwise(F.to_json(F.struct("l", "r"))))
        .otherwise(F.when(F.col("ml") <= F.col("mr"), F.to_json(F.struct("l"))).otherwise(F.to_json(F.struct("r"))))
    )
    out = joined(cut, full.select(*part, "l", "r", "kind", p3.alias("p3")), "l", "r", small=True)
    return out.select("line_id", "tokens", "n", "p2", F.coalesce("kind", F.lit("one")).alias("kind"), F.coalesce("p3", F.lit("")).alias("p3"))


def partition_templates(rows: DataFrame) -> DataFrame:
    """template, n_lines, first_line_id of final partitions: constant positions, else wildcards; then distinct templates."""
    keys = ["n", "p2", "kind", "p3"]
    words = rows.where("n > 0").select(*keys, "line_id", F.posexplode("tokens").alias("pos", "word"))
    # Counted by word first: numbers are aggregated by hash, texts by a sort, which then has the distinct words only.
    counted = words.groupBy(*keys, "pos", "word").agg(F.count("*").alias("c"), F.min("line_id").alias("first"))
    by_pos = counted.groupBy(*keys, "pos").agg(F.min("word").alias("lo"), F.max("word").alias("hi"), F.sum("c").alias("c"), F.min("first").alias("first"))
    cells = F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("word"))))
    full = by_pos.groupBy(*keys).agg(F.transform(cells, lambda e: e["word"]).alias("template"), F.max("c").alias("n_lines"), F.min("first").alias("first_line_id"))
    empty = rows.where("n = 0").groupBy().agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line_id")).where("n_lines > 0")
    both = full.select("template", "n_lines", "first_line_id").unionByName(empty.select(F.array().cast("array<string>").alias("template"), "n_lines", "first_line_id"))
    return both.groupBy("template").agg(F.sum("n_lines").alias("n_lines"), F.min("first_line_id").alias("first_line_id"))


def iplom(lines: DataFrame, lower_bound: float = 0.3, upper_bound: float = 0.8) -> DataFrame:
    """template, n_lines, first_line_id. ``upper_bound`` is accepted for its interface; both sides of it act alike.

    Empty lines are one template ``()``.
    """
    return partition_templates(stage3(stage2(stage1(lines)), lower_bound))
