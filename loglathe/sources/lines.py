"""Sources of ordered lines: DataFrames (line_id BIGINT, line STRING). ``line_id`` is the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks of text files (about 100 bytes each) are broadcast up to so many.
BLOCKS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event: ``user <id> <type> props <props>``."""
    e = read_table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), "event_type", F.lit("props"), "props")
    return e.select(F.col("event_id").alias("line_id"), line.alias("line"))


def placed_id(rows: DataFrame, major: str, minor: str | Column) -> Column:
    """One number per (major, minor), in their order: ``major`` times one more than the largest ``minor``.

    The table decides the factor, so no two places share a number; numbers beyond 64 bits are an error, not a wrap.
    """
    minor = F.col(minor) if isinstance(minor, str) else minor
    width = (rows.agg(F.max(minor).alias("w")).first()["w"] or 0) + 1
    return F.col(major) * F.lit(width).cast("long")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents; ids order by document, then place."""
    docs = read_table(spark, sf_dir, "documents")
    first = placed_id(docs, "doc_id", F.size(F.split("text", "\n")) - 1)
    return docs.select(first.alias("first"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select((F.col("first") + F.col("pos")).alias("line_id"), "line")


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per supplier: its name, nation and whether it owes."""
    s, n = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    owes = F.when(F.col("s_acctbal") < 0, F.lit("debit")).otherwise(F.lit("credit"))
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return named.select(F.col("s_suppkey").alias("line_id"), F.concat_ws(" ", F.lit("supplier"), "s_name", F.lit("of"), "n_name", F.lit("account"), owes).alias("line"))


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per nation."""
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return named.select(F.col("n_nationkey").cast("long").alias("line_id"), F.concat_ws(" ", F.lit("nation"), "n_name", F.lit("in region"), "r_name").alias("line"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per turn."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select((placed_id(c, "conv_id", "turn") + F.col("turn")).alias("line_id"), F.regexp_replace("text", "\n", " ").alias("line"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files (a file, folder or pattern), files in the order of their paths, lines in file order.

    A row of a scan knows its file and the block it was read from; inside a block, rows keep their order, so numbers that
    rise inside a task order them. Blocks are counted, and a line's number is the lines of earlier blocks and its place in its own.
    """
    raw = spark.read.text(path, lineSep="\n")
    at = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    blocks = at.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("n").alias("low"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of the files
    starts = blocks.select("file", "block", "low", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return at.join(F.broadcast(starts) if starts.count() <= BLOCKS else starts, ["file", "block"]).select((F.col("before") + F.col("n") - F.col("low")).alias("line_id"), "line")


def distinct_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct lines, each at its first place; with ``limit`` the first so many (a top-k, not a sort)."""
    out = lines.groupBy("line").agg(F.min("line_id").alias("line_id")).select("line_id", "line")
    return out if limit is None else out.orderBy("line_id").limit(limit)


def write_templates(templates: DataFrame, path: str) -> None:
    """Write a template table as Parquet."""
    templates.write.mode("overwrite").parquet(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
