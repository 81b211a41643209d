"""Template tables: DataFrames (template_id BIGINT, template ARRAY<STRING>), numbered from 0 as templates are first met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "template_id long, template array<string>"


def empty_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def add_templates(table: DataFrame, mined: DataFrame) -> DataFrame:
    """``table`` and the templates of ``mined`` (template, first_line_id) that it lacks, with the next numbers in their founding order."""
    new = mined.groupBy("template").agg(F.min("first_line_id").alias("first")).join(table.select("template"), "template", "left_anti")
    top = table.agg(F.max("template_id").alias("m")).first()["m"]
    number = F.row_number().over(Window.orderBy("first", F.to_json("template"))) + F.lit(-1 if top is None else top)  # a row per template
    return table.select("template_id", "template").unionByName(new.select(number.cast("long").alias("template_id"), "template"))


def ids_of(table: DataFrame, templates: DataFrame) -> DataFrame:
    """``templates`` (template, ...) with the table's template_id, null where it has none."""
    return templates.join(table.select("template_id", "template"), "template", "left")


def replace_templates(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``table`` with the templates of ``changes`` (template_id, template) in place of its own."""
    new = changes.select("template_id", F.col("template").alias("new"), F.lit(True).alias("hit"))
    return table.join(new, "template_id", "left").select("template_id", F.when(F.col("hit"), F.col("new")).otherwise(F.col("template")).alias("template"))


def updated(before: DataFrame, after: DataFrame) -> DataFrame:
    """template_id, old (null for an added one) and template of what ``after`` has changed or added."""
    old = before.select("template_id", F.col("template").alias("old"), F.lit(True).alias("known"))
    both = after.join(old, "template_id", "left")
    return both.where(F.col("known").isNull() | ~F.col("template").eqNullSafe(F.col("old"))).select("template_id", "old", "template")


def dump_table(table: DataFrame, path: str) -> None:
    table.select("template_id", "template").write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
