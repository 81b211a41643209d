"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking.

Unit vectors are centred, reduced by principal components and turned by a rotation that iterative quantisation learns so
that signs lose least (balanced binary codes). Several rotations, learned from different starts on a bounded sample, give
one long code, which is cut into substrings of about log2(rows of a label) bits: one table each. Vectors that share a
substring in any table are candidates, so any pair whose codes differ in fewer bits than there are tables is found for
certain; the number of tables is set so that a pair at the threshold is missed with a chance of ``MISS``. Candidates
are reranked with the original vectors in double precision.

Every row is indexed. Buckets are cut into blocks of at most ``BLOCK`` rows and pairs of blocks are compared as matrices, so a
bucket with a third of all rows is spread over many tasks; per vector a count and one link to the least vector of its
local component come out, never the pairs. A pair that shares several tables counts in the first one. Equal vectors are one
row with a multiplicity.

Edge cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components link with nothing;
vectors of different lengths never link; rows that repeat a vec_id are one vector (the least of their values); a row without a vec_id links with
nothing, has no component and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .components import components

THRESHOLD = 0.98
#: The rotations are learned on at most so many vectors of each dimension.
SAMPLE = 20_000
MISS = 0.0005
#: Sign flips of trained codes against those of random planes.
FLIP_MARGIN = 1.5
BLOCK = 1024
ITERATIONS = 30


class Codes:
    """Centre, projection and rotations of one dimension; table keys of vectors."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.bits = tables, bits
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        values, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
        c = len(values)
        v = x @ vectors
        self.turns = []
        for _ in range(-(-tables * bits // c)):
            turn, _ = np.linalg.qr(rng.normal(size=(c, c)))
            for _ in range(ITERATIONS):  # alternate between nearest codes and the rotation that fits them best
                left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (left @ right).T
            self.turns.append(vectors @ turn)

    def state(self) -> tuple:
        """Plain values, to be broadcast."""
        return self.centre, self.turns, self.tables, self.bits

    @classmethod
    def load(cls, state: tuple) -> Codes:
        codes = cls.__new__(cls)
        codes.centre, codes.turns, codes.tables, codes.bits = state
        return codes

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) substrings as integers."""
        signs = np.concatenate([(unit - self.centre) @ t >= 0 for t in self.turns], axis=1)
        # Each table takes bits from all over the code, so tables are alike.
        signs = signs[:, np.random.default_rng(5).permutation(signs.shape[1])[: self.tables * self.bits]]
        return signs.reshape(len(unit), self.tables, self.bits) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def plan_tables(rows: int, threshold: float) -> tuple[int, int]:
    """Tables and bits per table for labels of at most ``rows`` rows."""
    bits = int(np.clip(round(np.log2(max(rows, 2))), 6, 62))
    alike = 1 - FLIP_MARGIN * np.arccos(threshold) / np.pi
    return int(np.ceil(np.log(MISS) / np.log(1 - alike**bits))), bits


def unit_rows(embedding: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in embedding])
    x /= np.abs(x).max(axis=1, keepdims=True)  # norms neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs_of_run(x: np.ndarray, block: np.ndarray, cross: bool, keys: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """The matrix of linked pairs of one group: only between its two blocks if it is ``cross``, first shared table only."""
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    if cross:
        hit &= block[:, None] != block[None, :]
    for t in range(table):
        same = keys[:, t]
        hit &= same[:, None] != same[None, :]
    return hit


def _least_labels(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row reaches inside the group."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], big).min(axis=1))
        if (new == label).all():
            return label
        label = new


def _compare(pdf: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, added links, least linked id) of the rows of whole groups."""
    x, keys = unit_rows(pdf["embedding"]), np.stack(pdf["keys"].to_numpy())
    ids, copies, group = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["group"].to_numpy()
    table, block, cross, label = (pdf[c].to_numpy() for c in ("t", "block", "cross", "label"))
    added, least = np.zeros(len(ids), dtype=np.int64), ids.copy()
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(cuts, len(group)))
    for low, n in zip(cuts[sizes > 32], sizes[sizes > 32], strict=True):
        s = slice(low, low + n)
        hit = _pairs_of_run(x[s], block[s], cross[low], keys[s], table[low], threshold) & (label[s][:, None] == label[s][None, :])
        added[s] += hit @ copies[s]
        least[s] = np.minimum(least[s], _least_labels(hit, ids[s]))
    small, links = np.repeat(sizes <= 32, sizes), []
    for k in range(1, 32):
        a = np.flatnonzero(small[:-k] & (group[:-k] == group[k:]))
        if not len(a):
            break
        b = a + k
        ok = (np.einsum("ij,ij->i", x[a], x[b]) >= threshold) & (label[a] == label[b]) & (table[a] == table[b]) & (~cross[a] | (block[a] != block[b]))
        a, b = a[ok], b[ok]
        if len(a):
            earlier = ((keys[a] == keys[b]) & (np.arange(keys.shape[1])[None, :] < table[a][:, None])).any(axis=1)
            a, b = a[~earlier], b[~earlier]
            np.add.at(added, a, copies[b])
            np.add.at(added, b, copies[a])
            links.append((a, b))
    if links:
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        while (least[a] != least[b]).any():  # along chains of links inside a group
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
    some = added > 0
    return ids[some], added[some], least[some]


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector of ``rows`` (vec_id, embedding, label)."""
    spark = rows.sparkSession
    e = F.col("embedding")
    valid = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(e, lambda v: v != 0)
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    all_rows = rows.where("vec_id is not null").select("vec_id", "label", "embedding").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    all_rows = materialise(all_rows.select("vec_id", F.col("v.label").alias("label"), F.col("v.embedding").alias("embedding")).withColumn("valid", F.coalesce(valid, F.lit(False))), "vectors")
    good = all_rows.where("valid").withColumn("dim", F.size("embedding"))
    copies = good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    copies = materialise(copies, "distinct")
    most = copies.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # a row per dimension
    models = {}
    for r in most:
        sample = copies.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toPandas()
        models[r["dim"]] = Codes(unit_rows(sample["embedding"]), *plan_tables(r["n"], threshold))
    shared = spark.sparkContext.broadcast({dim: m.state() for dim, m in models.items()})

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                keys = Codes.load(shared.value[dim]).keys(unit_rows(part["embedding"]))
                yield pd.DataFrame({"rep": part["rep"], "keys": list(keys.astype(np.int64))})

    coded = materialise(copies.select("rep", "dim", "embedding").mapInPandas(code, "rep long, keys array<long>"), "codes")
    base = copies.join(coded, "rep").select("rep", "copies", "label", "dim", "embedding", "keys")
    entries = base.select("rep", "label", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("label", "dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = entries.join(sizes, ["label", "dim", "t", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    found = found.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = F.xxhash64("label", "dim", "t", "key", F.least("block", "other"), F.greatest("block", "other"))
    cross = (F.col("block") != F.col("other")).alias("cross")
    work = found.select("rep", "t", "block", cross, group.alias("group")).join(base, "rep").select("group", "t", "block", "cross", "rep", "copies", "label", "keys", "embedding")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            last = pdf["group"].iloc[-1] if len(pdf) else None
            if len(pdf) and (pdf["group"].iloc[0] != last):
                every = pd.concat(held) if len(held) > 1 else pdf
                going = (every["group"] == last).to_numpy()
                held = [every[going]]
                yield pd.DataFrame(dict(zip(("id", "added", "least"), _compare(every[~going], threshold), strict=True)))
        if held and sum(map(len, held)):
            yield pd.DataFrame(dict(zip(("id", "added", "least"), _compare(pd.concat(held), threshold), strict=True)))

    dealt = work.repartition("group").sortWithinPartitions("group", "rep")
    partial = materialise(dealt.mapInPandas(compare, "id long, added long, least long"), "links")
    comp = components(partial.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    links = partial.groupBy("id").agg(F.sum("added").alias("added"))
    of_rep = copies.join(links, copies["rep"] == links["id"], "left").drop("id").join(comp, F.col("rep") == comp["id"], "left")
    of_rep = of_rep.select("label", "dim", "embedding", (F.coalesce("added", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(of_rep, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = all_rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(nameless)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal labels."""
    from .common import table

    return link_vectors(table(spark, sf_dir, "embeddings"))
