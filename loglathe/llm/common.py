"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes a finished statement's shuffle files at once; nothing reads them again once its table is written.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that :func:`materialise` has written, newest last.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a folder under the warehouse is used, with a warning on a cluster.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local["):
        warnings.warn("spark.checkpoint.dir is not set: scratch tables go to the warehouse, which all machines must share", stacklevel=2)
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``<shared>/loglathe-<application>``, which is deleted when the application ends."""
    root = f"{shared_dir(spark)}/loglathe-{spark.sparkContext.applicationId}"
    path, files = _hadoop(spark, root)
    files.mkdirs(path)
    files.deleteOnExit(path)
    _written.append(f"{root}/{tag}-{uuid.uuid4().hex}")
    return _written[-1]


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Statements that end inside leave no shuffle files."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    :func:`drop_scratch` removes all such tables, :func:`discard` one; those left are deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with clean_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p, files = _hadoop(spark, path)
        files.delete(p, True)
        if path in _written:
            _written.remove(path)


def written() -> list[str]:
    """The paths of the scratch tables there are, oldest first."""
    return list(_written)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables."""
    discard(spark, [f"{shared_dir(spark)}/loglathe-{spark.sparkContext.applicationId}"])
    _written.clear()


def id_parts(name: str = "doc_id") -> tuple[Column, Column]:
    """A nullable long as two columns without nulls, ``name`` and ``no_id``, for functions that run in Python.

    Arrow hands longs with nulls to pandas as floats, which round ids beyond 2**53. :func:`id_whole` is the way back.
    """
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name), F.col(name).isNull().alias("no_id")


def id_whole(name: str = "doc_id") -> Column:
    return F.when(~F.col("no_id"), F.col(name)).alias(name)


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as ``df`` has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(col: str | Column = "text") -> Column:
    """A 128-bit key of a text; null has a key of its own."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.md5(c.cast("binary")), F.lit("null"))


def crc32_text(col: str | Column = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes (null: of the empty string)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))
