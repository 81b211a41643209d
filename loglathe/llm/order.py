"""Training-order materialisation: fixed-stride shards of token ids in a keyed, seekable random order.

Each task encodes its rows, joins them (END between documents) and cuts sequences of ``length`` ids; only the last of a
task is padded. Counts per task number the sequences 0..N-1. A keyed Feistel network over the next even-width power of
two, walked until the value falls below N, permutes these numbers: sequence i goes to global slot P(i), and P can be
evaluated (and inverted) for any single i without a table, so a reader resumes anywhere.

A shard is a range of ``per_shard`` slots, dealt to one task, sorted there and written as one binary file: a record of ``stride`` bytes for
each slot (its ids, little endian, then two line feeds), after the last record one footer with the documents' spans and a
trailer of two 64-bit numbers (bytes of spans, records). Slot s lies in shard ``s // per_shard`` at byte ``(s % per_shard) * stride``; any Hadoop file system
serves it by seeking. Files are written by Spark's text writer, whose rows may hold any bytes, so a lost executor's or repeated
task's files never appear beside the right ones. Shards are written in waves of at most ``WAVE`` files, at least ``WAVES`` of
them, which bounds the partitions of a shuffle and the disk it takes.

Edge cases: a null or empty text is just END; a null doc_id stays null; repeated rows are written as often as they occur; an
empty table gives no shard; extra columns are ignored; very long texts are cut like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _hadoop, clean_shuffles, discard, id_parts, id_whole, materialise, scratch_path, written
from .tokens import Encoder, id_type

LENGTH = 1024
#: 8 MB of 16-bit ids; a shard is one row when it is read back. Larger ones suit larger corpora and executors.
PER_SHARD = 4096
END = 50256
ROUNDS = 6
#: Files of a wave at most, and waves at least.
WAVE = 20_000
WAVES = 4
#: The tasks' first numbers (16 bytes each) are broadcast up to so many; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Ends a record, so strides are even.
MARK = "\n\n"

#: Spans are rows of four 64-bit integers: doc_id, whether there is none, start in the document, length.
SEQUENCES = "task int, number long, ids binary, spans binary"
ROWS = "doc_id long, no_id boolean, start long, length int, ids_crc32 long, slot long, shard long, byte_at long, offset int"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in rounds:
        if rounds.step > 0:
            left, right = right, left ^ (_mix(right, key * 1000003 + r) & mask)
        else:
            left, right = right ^ (_mix(left, key * 1000003 + r) & mask), left
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """P(i) of each number in [0, n), or the inverse; cycle-walking keeps values below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = _network(numbers.astype(np.uint64), half, key, rounds)
    while (far := out >= np.uint64(n)).any():
        out[far] = _network(out[far], half, key, rounds)
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """:data:`SEQUENCES`, written once: each task's sequences of ``length`` ids and the document spans in them."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, task, number = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        room, spans, parts = length, [], []
        out: list[tuple] = []

        def close() -> None:
            nonlocal room, spans, parts, number
            ids = np.concatenate(parts)
            out.append((task, number, np.pad(ids, (0, length - len(ids)), constant_values=END).tobytes(), np.array(spans, dtype="<i8").tobytes()))
            number, room, spans, parts = number + 1, length, [], []

        names = ["task", "number", "ids", "spans"]
        for pdf in batches:
            for doc, no, text in zip(pdf["doc_id"], pdf["no_id"], pdf["text"], strict=True):
                ids, at = np.array([*encoder.encode(text), END], dtype=kind), 0
                while at < len(ids):
                    take = min(room, len(ids) - at)
                    spans.append((doc, no, at, take))
                    parts.append(ids[at : at + take])
                    at, room = at + take, room - take
                    if not room:
                        close()
                if len(out) >= 512:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        if parts:
            close()
        if out:
            yield pd.DataFrame(out, columns=names)

    return materialise(docs.select(*id_parts(), "text").mapInPandas(run, SEQUENCES), "sequences")


def stride(length: int = LENGTH, vocabulary: str | None = None) -> int:
    """Bytes of a record."""
    return length * np.dtype(id_type(vocabulary)).itemsize + len(MARK)


def write_shards(docs: DataFrame, path: str, key: int = 20, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str | None = None) -> int:
    """Write all documents' sequences as shards under ``path``; returns their number.

    The shard is the task: file ``part-<k>`` of folder ``wave=<w>`` is shard ``w * files + k``, with the wave's ``files`` in its name
    (``<files>-<w>``).
    """
    spark, before_all = docs.sparkSession, set(written())
    sequences = cut_sequences(docs, length, vocabulary)
    counts = sequences.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the encoding pass
    starts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    n_tasks, total = starts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, key))

    n_shards = -(-total // per_shard)
    files = min(WAVE, max(1, -(-n_shards // WAVES)))
    numbered = sequences.join(F.broadcast(starts) if n_tasks <= BROADCAST_ROWS else starts, "task").withColumn("slot", F.pandas_udf(slot_of, "long")(F.col("before") + F.col("number")))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The partition's records in order, then its footer."""
        spans, row = [], 0
        for pdf in batches:
            for raw in pdf["spans"]:
                some = np.frombuffer(raw, dtype="<i8").reshape(-1, 4)
                spans.append(np.column_stack([np.full(len(some), row), some]))
                row += 1
            yield pd.DataFrame({"value": pdf["ids"]})
        if row:
            footer = np.concatenate(spans).astype("<i8").tobytes()
            yield pd.DataFrame({"value": [footer + np.array([len(footer), row], dtype="<i8").tobytes()]})

    for wave in range(-(-n_shards // files)):
        shard = F.floor(F.col("slot") / per_shard).cast("int") - wave * files
        here = numbered.select("slot", shard.alias("file"), "ids", "spans").where(F.col("file").between(0, files - 1))
        dealt = here.repartitionById(files, F.col("file")).sortWithinPartitions("slot")
        with clean_shuffles(spark):
            records = dealt.select("ids", "spans").mapInPandas(build, "value binary")
            records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", MARK).text(f"{path}/wave={files}-{wave}")
    discard(spark, [p for p in written() if p not in before_all and p != path])
    return n_shards


def _files(spark: SparkSession, path: str) -> dict[int, object]:
    """The file of every shard."""
    import re

    p, fs = _hadoop(spark, path)
    out = {}
    for status in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/wave=*/part-*")) or []:
        files, wave, part = map(int, re.search(r"wave=(\d+)-(\d+)/part-(\d+)", status.getPath().toString()).groups())
        out[wave * files + part] = status.getPath()
    return out


def read_from(spark: SparkSession, path: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str | None = None) -> Iterator[np.ndarray]:
    """The ``count`` sequences from global slot ``slot`` on, by seeking; a few records are in memory at a time."""
    kind, step, files, (_, fs) = id_type(vocabulary), stride(length, vocabulary), _files(spark, path), _hadoop(spark, path)
    at, last = slot, slot + count
    while at < last and at // per_shard in files:
        where = files[at // per_shard]
        size = fs.getFileStatus(where).getLen()
        stream = fs.open(where)
        try:
            stream.seek(size - len(MARK) - 8)
            n = int(np.frombuffer(bytes(stream.readNBytes(8)), dtype="<i8")[0])
            stop = min(last, at // per_shard * per_shard + n)
            stream.seek(at % per_shard * step)
            while at < stop:
                some = min(stop - at, 256)
                raw = np.frombuffer(bytes(stream.readNBytes(some * step)), dtype=np.uint8).reshape(some, step)
                yield from np.ascontiguousarray(raw[:, : -len(MARK)]).view(kind)
                at += some
            if n < per_shard:
                return
        finally:
            stream.close()


def read_spans(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str | None = None) -> DataFrame:
    """:data:`ROWS` without ``no_id``, from the files alone: where each piece of each document lies, and the checksum of the ids found there."""
    kind, step = id_type(vocabulary), stride(length, vocabulary)
    names = [x.split()[0] for x in ROWS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, content in zip(pdf["shard"], pdf["content"], strict=True):
                size, n = np.frombuffer(content[-len(MARK) - 16 : -len(MARK)], dtype="<i8").tolist()
                assert len(content) == n * step + size + 16 + len(MARK)
                out, at, last = [], 0, -1
                for row, doc, no, start, count in np.frombuffer(content, dtype="<i8", count=size // 8, offset=n * step).reshape(-1, 5).tolist():
                    at, last = (at, row) if row == last else (0, row)
                    ids = np.frombuffer(content, dtype=kind, count=count, offset=row * step + at * np.dtype(kind).itemsize)
                    out.append((doc, bool(no), start, count, zlib.crc32(ids.astype("<u4").tobytes()), shard * per_shard + row, shard, row * step, at))
                    at += count
                    if len(out) >= 16_384:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    if not _files(spark, path):
        found = spark.createDataFrame([], ROWS)
    else:
        raw = spark.read.format("binaryFile").load(f"{path}/wave=*/part-*")
        number = lambda k: F.regexp_extract("path", r"wave=(\d+)-(\d+)/part-(\d+)", k).cast("long")
        found = raw.select((number(2) * number(1) + number(3)).alias("shard"), "content").mapInPandas(read, ROWS)
    return found.select(id_whole(), *(c for c in found.columns if c not in ("doc_id", "no_id")))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as shards in training order; where each piece lies, read back from the files."""
    from .common import table

    path = scratch_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_spans(spark, path)
