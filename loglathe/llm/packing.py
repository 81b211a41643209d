"""Mixture-controlled packing: deficit round-robin over one queue per source.

Every window of ``window`` tokens serves each source its quantum, the source's target share of the window; what a
queue is owed beyond whole tokens is carried on, so after k windows a source has got its share of k windows to within
one token. A source that runs dry leaves its share to the others in proportion. Because a quantum may end inside a
document ("cut freely"), the round-robin has a closed form: source s has been served ``share[s] * v`` tokens, where v, the same for
all sources, is a piecewise-linear function of the stream position with one breakpoint per exhausted source.
Given a document's place in its queue, the windows that serve it and its offsets there follow without looking at any other document.

So the work is: (1) one pass over the texts, in which each task writes its rows' ids and each row's place in the task's
part of its queue; (2) sums per (task, source), whose running totals give every part's place in its queue (and carry
the deficits over partitions); (3) one pass over the ids that cuts the pieces. No token is shuffled and no task holds
more than a batch of rows. Windows follow each other without gaps, so of all sequences of 1024 tokens only the last can be short.

Edge cases: a null or empty text is the one id 0; a null source is a queue of its own; a null doc_id stays null; repeated rows are packed as
often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_parts, id_whole, materialise
from .tokens import Encoder, id_type

SEQUENCE = 1024
#: Sequences in a window, over which the mixture is kept.
WINDOW_SEQUENCES = 64
END = 0
#: Queues at most: in a window of so many tokens no more sources can have a token each. Beyond it, sources with a target (at most half as
#: many) or else the largest half as many keep queues of their own; the others share the rest.
MAX_QUEUES = SEQUENCE * WINDOW_SEQUENCES
#: Up to so many rows (of about 50 bytes) of queue starts are broadcast.
BROADCAST_ROWS = 500_000
#: Shares of the query and the pipeline: in proportion to tokens to this power, so that a hot source is held back while others last.
TEMPER = 0.5

ENCODED = "doc_id long, no_id boolean, queue string, source string, ids binary, n int, task int, start long"
PIECES = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _name(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def _queues(named: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """``named`` with the queues of small sources shared where there are more than :data:`MAX_QUEUES` sources.

    With targets, sources that have none are one queue, served when the others have run dry. Without, they share by hash, and a
    shared queue's share is that of its sources together.
    """
    if named.select("queue").distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES:
        return named
    if targets:
        own = [_name(s) for s, w in targets.items() if w > 0]
        if len(own) > MAX_QUEUES // 2:
            raise ValueError(f"{len(own)} targets: at most {MAX_QUEUES // 2} sources can have a target of their own")
        shared = F.lit("rest")
    else:
        sizes = named.groupBy("queue").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
        own = [r["queue"] for r in sizes.orderBy(F.desc("size"), "queue").limit(MAX_QUEUES // 2).collect()]
        shared = F.concat(F.lit("rest"), F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES - len(own))).cast("string"))
    kept = named.sparkSession.createDataFrame([(q,) for q in own], "queue string").withColumn("own", F.lit(True))
    joined = named.join(F.broadcast(kept), "queue", "left")
    return joined.select("doc_id", "no_id", F.when(F.col("own"), F.col("queue")).otherwise(shared).alias("queue"), "source", "text")


def encode(docs: DataFrame, queue: str = "source", vocabulary: str | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """Each row's ids (little endian, in the vocabulary's :func:`id_type`, END last) with its source and its place in its task's part of its queue."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, task, at = Encoder(vocabulary), TaskContext.get().partitionId(), {}
        for pdf in batches:
            for low in range(0, len(pdf), 512):
                part = pdf.iloc[low : low + 512]
                ids, n, start = [], [], []
                for q, text in zip(part["queue"], part["text"], strict=True):
                    x = np.array([*encoder.encode(text), END], dtype=kind)
                    ids.append(x.tobytes())
                    n.append(len(x))
                    start.append(at.get(q, 0))
                    at[q] = start[-1] + len(x)
                yield pd.DataFrame({**{c: part[c] for c in ("doc_id", "no_id", "queue", "source")}, "ids": ids, "n": n, "task": task, "start": start})

    source = F.col(queue).cast("string")
    named = docs.select(*id_parts(), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("queue"), source.alias("source"), "text")
    return materialise(_queues(named, targets).mapInPandas(run, ENCODED), "ids")


class Mixture:
    """The served amount of every queue as a function of the stream position.

    ``totals``: tokens by queue; ``targets``: shares by queue (default: in proportion to the totals to the power ``temper``).
    Queues without a share are served, in proportion to their totals, when all others have run dry.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = SEQUENCE * WINDOW_SEQUENCES, temper: float = 1.0) -> None:
        share = {q: max(0.0, targets.get(q, 0.0)) if targets else float(n) ** temper for q, n in totals.items() if n}
        #: Queues in the order in which they run dry: those with a share, then the others.
        self.queues = sorted(share, key=lambda q: (not share[q], totals[q] / share[q] if share[q] else 0.0, q))
        self.place = {q: i for i, q in enumerate(self.queues)}
        self.window, self.total = window, sum(totals.values())
        self.n_windows = -(-self.total // window)
        self.totals = np.array([totals[q] for q in self.queues], dtype=np.int64)
        first = sum(1 for q in self.queues if share[q])
        self.share = np.array([share[q] or float(totals[q]) for q in self.queues])
        self.parts = [(low, high) for low, high in ((0, first), (first, len(self.queues))) if low < high]
        #: Per queue, v and the stream position when it runs dry, and before it the sum of what has run dry and the shares that are left.
        self.v, self.x = self.totals / self.share, np.zeros(len(self.queues))
        self.dry, self.left = np.zeros(len(self.queues)), np.zeros(len(self.queues))
        for low, high in self.parts:
            t, s = self.totals[low:high].astype(float), self.share[low:high]
            self.dry[low:high] = self.totals[:low].sum() + np.cumsum(t) - t
            self.left[low:high] = np.cumsum(s[::-1])[::-1]
            self.x[low:high] = np.maximum.accumulate(self.dry[low:high] + self.v[low:high] * self.left[low:high])
        self._windows: dict[int, tuple[np.ndarray, int]] = {}
        self._keep = max(2, min(256, (1 << 20) // max(1, len(self.queues))))

    def served(self, window: int) -> tuple[np.ndarray, int]:
        """Tokens of every queue served before the window (whole tokens of its share so far), and their sum."""
        got = self._windows.get(window)
        if got is None:
            x = min(window * self.window, self.total)
            y = np.zeros(len(self.queues), dtype=np.int64)
            for low, high in self.parts:
                k = low + int(np.searchsorted(self.x[low:high], x, side="right"))
                y[low:k] = self.totals[low:k]
                start = float(self.totals[:low].sum())
                if k < high and x > start:
                    v = min(max((x - self.dry[k]) / self.left[k], self.v[k - 1] if k > low else 0.0), self.v[k])
                    y[k:high] = np.minimum(np.floor(self.share[k:high] * v).astype(np.int64), self.totals[k:high])
            if x >= self.total:
                y = self.totals
            got = (y, int(y.sum()))
            if len(self._windows) >= self._keep:
                self._windows.clear()
            self._windows[window] = got
        return got

    def window_of(self, i: int, token: int) -> int:
        """The window that serves the token of queue i."""
        low = next(low for low, high in self.parts if low <= i < high)
        high = next(high for first, high in self.parts if first == low)
        v = token / self.share[i]
        k = min(low + int(np.searchsorted(self.v[low:high], v, side="right")), high - 1)
        guess = min(max(int((self.dry[k] + v * self.left[k]) // self.window), 0), self.n_windows - 1)
        while guess and self.served(guess)[0][i] > token:
            guess -= 1
        while self.served(guess + 1)[0][i] <= token:
            guess += 1
        return guess


def cut(mixture: Mixture, queue: str, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document of n tokens at ``place`` of its queue."""
    done, i = 0, mixture.place[queue]
    k = mixture.window_of(i, place)
    while done < n:
        (before, start), (after, _) = mixture.served(k), mixture.served(k + 1)
        take = min(n - done, int(after[i]) - place - done)
        # The window's stream starts with what was served before it; in it, queues follow in their order.
        at = start + int((after[:i] - before[:i]).sum()) + place + done - int(before[i])
        while take > 0:
            part = min(take, SEQUENCE - at % SEQUENCE)
            yield done, part, at // SEQUENCE, at % SEQUENCE
            done, at, take = done + part, at + part, take - part
        k += 1


def pack(docs: DataFrame, targets: dict[str, float] | None = None, vocabulary: str | None = None, temper: float = 1.0) -> DataFrame:
    """Pieces of all documents: :data:`PIECES` without ``no_id``.

    ``targets``: token share by source, default in proportion to the corpus's own tokens to the power ``temper``.
    """
    spark, kind = docs.sparkSession, id_type(vocabulary)
    ids = encode(docs, vocabulary=vocabulary, targets=targets)
    parts = ids.groupBy("queue", "task").agg(F.sum("n").alias("tokens"))
    running = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    totals = {r["queue"]: r["t"] for r in ids.groupBy("queue").agg(F.sum("n").alias("t")).collect()}  # <= MAX_QUEUES rows
    wanted = {_name(s): w for s, w in targets.items()} if targets else None
    if wanted and totals and not any(wanted.get(q, 0) > 0 for q in totals):
        raise ValueError("no source of the documents has a target")
    shared = spark.sparkContext.broadcast((totals, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, mixture = [x.split()[0] for x in PIECES.split(", ")], Mixture(*shared.value, temper=temper)
        for pdf in batches:
            for low in range(0, len(pdf), 512):
                out = []
                for d, no, q, source, raw, n, place in pdf.iloc[low : low + 512].itertuples(index=False):
                    full = np.frombuffer(raw, dtype=kind).astype("<u4").tobytes()
                    for start, length, seq, at in cut(mixture, q, place, n):
                        out.append((d, no, start, length, zlib.crc32(full[4 * start : 4 * (start + length)]), n, seq, at, source))
                yield pd.DataFrame(out, columns=names)

    parts = materialise(parts.select("queue", "task", "before"), "parts")
    # A row per queue and task: broadcast while that is small, so that the ids stay where they are.
    placed = ids.join(F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts, ["queue", "task"])
    pieces = placed.select("doc_id", "no_id", "queue", "source", "ids", "n", (F.col("before") + F.col("start")).alias("place")).mapInPandas(run, PIECES)
    return pieces.select(id_whole(), *(c for c in pieces.columns if c not in ("doc_id", "no_id")))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, sources mixed by the square roots of their sizes."""
    from .common import table

    return pack(table(spark, sf_dir, "documents"), temper=TEMPER)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that are left, mixed as in the query."""
    return pack(docs, temper=TEMPER)
