"""Running order-dependent miners on Spark.

A miner is a plain object with ``add(line_id, line)`` and ``templates()``. Where a miner's state never crosses a key (the
token count, the first token, the message type) the lines are dealt by that key, sorted by line_id inside it, and *streamed*
through one miner per key: memory holds the miner's state (its templates), not the key's lines, unless the miner itself
must keep them. Miners whose search crosses all keys have one key, so one task reads all lines in order.

The task sorts its lines itself, in runs of bounded size that it writes to its temp folder and merges (:func:`in_order`): a sort in
front of it would keep all rows of a key in one task's memory. A line travels as one string, its tokens parted by blanks.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import IO, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import tokenized

TEMPLATES = "template array<string>, n_lines long, first_line_id long"
Result = tuple[list, int, int]
#: What a line did: the line that founded its cluster, the cluster's template now, and one of the three below.
Change = tuple[int, list, str]
CREATED, CHANGED, UNCHANGED = "cluster_created", "cluster_template_changed", "none_update"
#: A sorted run is written when its rows take so many bytes, in batches of so many rows; so many runs are merged at once.
RUN_BYTES, RUN_BATCH, FAN_IN = 64 << 20, 4096, 64


#: A miner remembers so many lines' outcomes, once this many lines in a row have changed nothing.
REMEMBERED, CALM = 10_000, 8


class Miner(Protocol):
    def add(self, line_id: int, tokens: list[str]) -> None: ...

    def templates(self) -> list[Result]:
        """(template, lines, the line that founded it)."""


class Settled:
    """What lines did that changed no template, by what of them the search looks at; forgotten at each change.

    While nothing changes, a line's outcome depends on the words that stand against constants alone; so most lines of a log are one look-up.
    """

    def __init__(self) -> None:
        self.calm, self.known, self.outcome = 0, None, {}

    def ready(self) -> bool:
        return self.calm >= CALM

    def unchanged(self, key: tuple | None, outcome: object) -> None:
        self.calm += 1
        if key is not None:
            if len(self.outcome) >= REMEMBERED:
                self.outcome.clear()
            self.outcome[key] = outcome

    def changed(self) -> None:
        self.calm, self.known = 0, None
        self.outcome.clear()

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, state: dict) -> None:
        self.__init__()


def constant_places(templates: Iterable[list], n: int) -> list[int]:
    """The places where any of the templates of ``n`` tokens has a constant."""
    return [i for i, column in enumerate(zip(*templates, strict=True)) if any(t is not None for t in column)] if n else []


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _written(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> IO[bytes]:
    """A run in the temp folder; the file is gone when it is closed."""
    run = tempfile.TemporaryFile()
    with pa.ipc.new_stream(run, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        for batch in batches:
            out.write_batch(batch)
    return run


def _read(run: IO[bytes]) -> Iterator[tuple]:
    run.seek(0)
    with run:
        yield from _rows(pa.ipc.open_stream(run))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, RUN_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def in_order(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple]:
    """The rows of the batches, sorted by the columns ``by``, which are the first ones and have no nulls.

    An external merge sort: memory holds one run, or a batch of each of :data:`FAN_IN` runs.
    """
    runs: list[IO[bytes]] = []
    held: list[pa.RecordBatch] = []
    size = 0

    def ordered() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=RUN_BATCH)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > RUN_BYTES:
            runs.append(_written(ordered(), held[0].schema))
            held, size = [], 0
            if len(runs) == FAN_IN:
                runs = [_written(_batches(heapq.merge(*map(_read, runs)), batch.schema), batch.schema)]
    last = _rows(ordered()) if held else iter(())
    yield from heapq.merge(*map(_read, runs), last) if runs else last


def run_miner(lines: DataFrame, make: Callable[[], Miner], key: Column | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """:data:`TEMPLATES` of all keys' miners. ``key`` is an expression over (line_id, tokens); none: all lines in order."""
    rows = tokenized(lines) if tokens is None else tokens
    own = F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit(""))
    keyed = rows.select(own.alias("key"), F.col("line_id").cast("long").alias("line_id"), F.array_join("tokens", " ").alias("line"))
    dealt = keyed.repartition(1) if key is None else keyed.repartition("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, miner = None, None

        def done() -> Iterator[pa.RecordBatch]:
            found = iter(miner.templates())
            while some := list(islice(found, 10_000)):
                columns = zip(*((list(t), int(n), int(i)) for t, n, i in some), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.string()), pa.int64(), pa.int64()), strict=True)], ["template", "n_lines", "first_line_id"])

        for k, line_id, line in in_order(batches, ["key", "line_id"]):
            if miner is None or k != current:
                if miner is not None:
                    yield from done()
                current, miner = k, make()
            miner.add(line_id, line.split(" ") if line else [])
        if miner is not None:
            yield from done()

    return dealt.mapInArrow(run, TEMPLATES)


def distinct_templates(templates: DataFrame) -> DataFrame:
    """One row per template: its lines, its first founding line."""
    return templates.groupBy("template").agg(F.sum("n_lines").alias("n_lines"), F.min("first_line_id").alias("first_line_id"))


def by_length() -> Column:
    return F.size("tokens")
