"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (by default: equal texts) are never split over shards. At corpus scale the number of groups is
unbounded, so what the packer sees is a *bounded* list of items that covers every group: each group of at least
``total / granularity`` bytes is an item of its own (there can be at most ``granularity`` of those), all smaller
groups are bundled by hash into at most ``granularity`` items. The packer sorts the items by size and puts each
into the fullest bin that still holds it, found in a balanced search tree of remaining capacities. The capacity
is the smallest (within 1/1000 of the mean load) at which the items fit into ``n_shards`` bins.

Edge cases: a null text is the group "null" (size 1); a null doc_id stays null; repeated rows are one group and get different slots; rows that
share a doc_id with another text are placed by their own text; an empty table gives an empty result; extra columns are dropped from the assignment and
written by :func:`write_shards` whatever their names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import columns, crc32_text, fresh, materialise, text_key

#: At most twice this many items reach the driver's packer, whatever the input's size.
GRANULARITY = 32_768


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key = key
        self.priority = zlib.crc32(b"%d/%d" % key)
        self.left: _Node | None = None
        self.right: _Node | None = None


class CapacityTree:
    """A treap over (remaining capacity, bin): logarithmic insert, removal and tightest fit."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.priority >= b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, remaining: int, bin_id: int) -> None:
        low, high = self._split(self.root, (remaining, bin_id))
        self.root = self._merge(self._merge(low, _Node((remaining, bin_id))), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        least = high
        while least.left is not None:
            least = least.left
        _, rest = self._split(high, (least.key[0], least.key[1] + 1))
        self.root = self._merge(low, rest)
        return least.key


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; items larger than the capacity get a bin of their own."""
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            found = (capacity, bins)
            bins += 1
        out[i] = found[1]
        if found[0] > sizes[i]:
            tree.add(found[0] - sizes[i], found[1])
    return out


def pack_into(sizes: list[int], n_shards: int) -> list[int]:
    """Best-fit-decreasing at (nearly) the smallest capacity that needs at most ``n_shards`` bins."""
    total, largest = sum(sizes), max(sizes, default=0)
    low = max(largest, -(-total // n_shards))
    step = max(1, total // (n_shards * 1000))
    high = max(low, 2 * low)
    best = best_fit_decreasing(sizes, low)
    if max(best, default=0) < n_shards:
        return best
    while high - low > step:
        mid = (low + high) // 2
        got = best_fit_decreasing(sizes, mid)
        low, high = (low, mid) if max(got) < n_shards else (mid, high)
    return best_fit_decreasing(sizes, high)


def _sized(docs: DataFrame, granularity: int, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, and the keys of a row's group and bundle."""
    rows = docs.select(
        F.col("doc_id").alias("__id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("__size"),
        crc32_text().alias("__crc"),
        text_key().alias("__group"),
        *more,
    )
    return rows.withColumn("__bundle", F.pmod(F.xxhash64("__group"), F.lit(granularity)))


def _placed(rows: DataFrame, n_shards: int, granularity: int) -> DataFrame:
    """``rows`` of :func:`_sized` with __shard and __slot.

    Group sizes are pre-aggregated before the shuffle, so a text that fills a third of the rows is one row per task; each row's
    item is looked up in a map of at most ``2 * granularity`` entries. Slots are numbered inside (shard, slice) and shifted by the
    slices' counts, so no task ever holds a whole shard.
    """
    spark = rows.sparkSession
    groups = materialise(rows.groupBy("__group", "__bundle").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n")), "groups")
    totals = groups.agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).first()
    total, n_rows = totals["b"] or 0, totals["n"] or 0
    large = F.col("bytes") * granularity >= total
    items = (
        groups.groupBy(F.when(large, F.col("__group")).alias("own"), F.when(~large, F.col("__bundle")).alias("bundle"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most 2 * granularity rows
    )
    items.sort(key=lambda r: (-r["bytes"], r["own"] or "", r["bundle"] if r["bundle"] is not None else -1))
    shard_of = pack_into([r["bytes"] for r in items], n_shards)
    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("__shard", T.IntegerType())])
    placed = spark.createDataFrame([(r["own"] or str(r["bundle"]), s) for r, s in zip(items, shard_of, strict=True)], schema)
    own = {r["own"] for r in items if r["own"] is not None}
    # Both maps are bounded by the granularity, hence the hints.
    owned = spark.createDataFrame([(g,) for g in sorted(own)], "__group string").withColumn("__own", F.lit(True))
    keyed = (
        rows.join(F.broadcast(owned), "__group", "left")
        .withColumn("__key", F.when(F.col("__own"), F.col("__group")).otherwise(F.col("__bundle").cast("string")))
        .join(F.broadcast(placed), "__key")
    )
    slices = max(64, n_rows // 50_000)
    keyed = keyed.withColumn("__slice", F.pmod(F.xxhash64("__id", "__group"), F.lit(slices)).cast("int"))
    order = Window.partitionBy("__shard", "__slice").orderBy("__id", "__crc")
    counts = keyed.groupBy("__shard", "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = keyed.withColumn("__at", F.row_number().over(order).cast("long") - 1).join(starts, ["__shard", "__slice"])
    return numbered.withColumn("__slot", F.col("__start") + F.col("__at"))


def assign_shards(docs: DataFrame, n_shards: int = 8, granularity: int = GRANULARITY) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``; equal texts share a shard. The texts are read once."""
    names = {"__id": "doc_id", "__size": "size", "__crc": "text_crc32", "__shard": "shard", "__slot": "slot"}
    placed = _placed(materialise(_sized(docs, granularity), "sized"), n_shards, granularity)
    return placed.select(*(F.col(c).alias(name) for c, name in names.items()))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, granularity: int = GRANULARITY) -> None:
    """Write every row of ``docs`` under ``path``, one folder per shard, each in slot order.

    The folder's column is called ``shard``, with underscores after it where ``docs`` has such a column.
    """
    name = fresh(docs, "shard")
    placed = _placed(_sized(docs, granularity, F.struct(*columns(docs)).alias("__row")), n_shards, granularity)
    dealt = placed.select("__row", "__shard", "__slot").repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    dealt.select("__row.*", F.col("__shard").alias(name)).write.partitionBy(name).parquet(path)


def op1_query(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    from .common import table

    shards = assign_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
