"""Online mining: a stream of lines in, one row per line out, a miner per key as state.

The same miner classes serve batch and stream. State is the pickled miner, which grows with its templates and not with the
lines. Inside a micro-batch a key's lines are sorted by line_id, in bounded memory whatever the micro-batch's size; the order of
micro-batches is the stream's.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tokens import tokenize
from ..operators.bucketed import Lenma, OnlineFtTree
from ..operators.drain import Drain
from ..operators.ordered import Shiso, Spell, letter_counts
from ..operators.sequential import RUN_BATCH, UNCHANGED, in_order

EVENTS = "line_id long, founder long, template array<string>, update_type string"


def _ingest(miner: object, line_id: int, tokens: list[str]) -> tuple[int, list, str]:
    """(founding line, template, what happened)."""
    found, *rest = miner.ingest(line_id, tokens)
    return (found.first_line, list(found.template), rest[0]) if isinstance(miner, Drain) else (found, *rest)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, line_id, line) of each batch as one compressed cell per key, so that grouping a micro-batch sorts cells, not lines."""
    for batch in batches:
        by_key: dict[str, list[tuple[int, str]]] = {}
        for key, line_id, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_key.setdefault(key, []).append((line_id, line))
        cells = []
        for rows in by_key.values():
            rows.sort()
            steps = np.diff(np.array([i for i, _ in rows], dtype=np.int64), prepend=np.int64(0))
            cells.append(zlib.compress(pickle.dumps((steps.tobytes(), [line for _, line in rows])), 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(by_key), pa.string()), pa.array(cells, pa.binary())], ["key", "cell"])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    """line_id, line of the cells."""
    for pdf in batches:
        for cell in pdf["cell"]:
            steps, lines = pickle.loads(zlib.decompress(cell))
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(np.frombuffer(steps, dtype=np.int64))), pa.array(lines, pa.string())], ["line_id", "line"])


def mine_stream(lines: DataFrame, make: Callable[[], object], key: Column) -> DataFrame:
    """:data:`EVENTS` of a streaming DataFrame (line_id, line); ``key`` is over (line_id, tokens)."""
    rows = lines.select("line_id", tokenize("line").alias("tokens"))
    rows = rows.select(key.cast("string").alias("key"), F.col("line_id").cast("long").alias("line_id"), F.array_join("tokens", " ").alias("line"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        miner = cloudpickle.loads(state.get[0]) if state.exists else make()
        out = ((i, *_ingest(miner, i, line.split(" ") if line else [])) for i, line in in_order(_unpacked(batches), ["line_id"]))
        while some := list(islice(out, RUN_BATCH)):
            yield pd.DataFrame(some, columns=["line_id", "founder", "template", "update_type"])
        state.update((cloudpickle.dumps(miner),))

    packed = rows.mapInArrow(_packed, "key string, cell binary")
    return packed.groupBy("key").applyInPandasWithState(step, EVENTS, "miner binary", "append", GroupStateTimeout.NoTimeout)


def drain_stream(lines: DataFrame, depth: int = 4, sim_th: float = 0.4, max_children: int = 100) -> DataFrame:
    """Drain, keyed by token count, over which its state never reaches."""
    Drain(depth)
    return mine_stream(lines, lambda: Drain(depth, sim_th, max_children), F.size("tokens"))


def lenma_stream(lines: DataFrame, threshold: float = 0.9995) -> DataFrame:
    return mine_stream(lines, lambda: Lenma(threshold), F.size("tokens"))


def spell_stream(lines: DataFrame, tau: float = 0.5) -> DataFrame:
    """One key: Spell's search crosses all lengths."""
    return mine_stream(lines, lambda: Spell(tau), F.lit(""))


def shiso_stream(lines: DataFrame, threshold: float, max_child: int) -> DataFrame:
    """One key: SHISO's tree crosses all lengths."""
    return mine_stream(lines, lambda: Shiso(threshold, max_child, letter_counts), F.lit(""))


def fttree_stream(lines: DataFrame, max_child: int = 6, cut_depth: int = 3, message_type: object = "none", count_unit: str = "char") -> DataFrame:
    """One key: FTTree's running counts cross all message types."""
    return mine_stream(lines, lambda: OnlineFtTree(max_child, cut_depth, message_type, count_unit), F.lit(""))


def final_templates(events: DataFrame) -> DataFrame:
    """template, n_lines, first_line_id from a stream's collected output: each cluster's last template."""
    # A template is what its cluster's last change made of it; only changes are sorted, all lines are counted.
    last = events.where(F.col("update_type") != UNCHANGED).groupBy("founder").agg(F.max_by("template", "line_id").alias("template"))
    counts = events.groupBy("founder").agg(F.count("*").alias("n_lines"))
    return last.join(counts, "founder").select("template", "n_lines", F.col("founder").alias("first_line_id"))


def run_available(events: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now, into Parquet under ``path``; read the output back."""
    query = events.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(f"{path}/out")
