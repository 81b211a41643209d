"""Near-duplicate documents by ProbMinHash: exponential arrivals, banding, verification.

A document is the set of its distinct five-word shingles (words: runs of letters and digits, lower-cased; a text of
fewer words is one shingle), each of weight 1. Each shingle is a Poisson process of rate its weight: its
arrivals fall on random registers, and a register keeps the shingle that arrives first. Shingles whose next
arrival is later than the latest register stop (early termination), so most are touched once. Two documents agree on
a register with their probability Jaccard as chance; at equal weights that is the Jaccard of the distinct shingles, which is
also what is verified. (Weights that grow with a shingle's count would lose pairs whose unshared shingles are repeated.)

Signatures are cut into ``BANDS`` bands of ``ROWS``. Two documents at the threshold share no band with a chance of
(1 - 0.8**4)**24, about 3 in a million, and less above it. In a bucket every member is first compared with one pivot only (the least by a
hash of id and band, so the bands of a large family have different pivots), and a bucket of any size gives as many candidates as
members. Candidates of which one has too few shingles for the threshold are dropped (an exact bound); all others are verified on the
shingle sets: Jaccard at least ``threshold``. Verified links give components. Members of one bucket that are still in *different* components
then meet in an exact prefix join: their shingles are ordered by rarity, and only documents that share one of their rarest
shingles, at places that leave room for the overlap they need, are compared. So no link between components is lost to the choice of
pivots, and a large family that is alike, but not alike enough, gives few pairs.

Equal word sequences are one class from the start; their copies are not compared. A third of all rows in one group of
copies is one row after the first (map-side combined) aggregation.

Edge cases: null, empty and word-less texts are never linked (each is a class of its own); rows that share a doc_id are one
document, judged by one of its texts (the least by a hash); rows without a doc_id are not compared and give a row each with a null class
that is kept; an empty table gives an empty result; extra columns are ignored; long texts are sketched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh, materialise
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Ids of candidates are broadcast to the scan of the texts up to so many (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bits of the parity bitmaps.
PARITY = 512

SKETCH = "doc_id long, version long, content long, content2 long, n long, bands array<long>"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, n: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of concatenated documents of ``n`` words each, and each shingle's document."""
    doc = np.repeat(np.arange(len(n)), n)
    x = words.view(np.uint64) if words.dtype == np.int64 else words.astype(np.uint64)
    first = np.cumsum(n) - n
    within = np.arange(len(x)) - first[doc]
    rolled = np.zeros(len(x), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = rolled * np.uint64(0x100000001B3)
            part = x[k:]
            rolled[: len(part)] += part  # windows that run over the document's end are dropped below
    keep = within + width <= n[doc]
    short = np.flatnonzero((n > 0) & (n < width))
    hashes, owner = _scramble(rolled[keep]), doc[keep]
    if len(short):
        extra = []
        with np.errstate(over="ignore"):
            for d in short:
                h = np.uint64(n[d])
                for w in x[first[d] : first[d] + n[d]]:
                    h = h * np.uint64(0x100000001B3) + w
                extra.append(h)
        hashes, owner = np.concatenate([hashes, _scramble(np.array(extra, dtype=np.uint64))]), np.concatenate([owner, short])
    return hashes, owner


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts, in document order."""
    order = np.lexsort((hashes, owner))
    h, d = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def prob_minhash(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The m registers of each document: 32 bits of the first shingle to arrive in each (0 where there is none).

    All processes advance round by round. A register packs (arrival time, shingle) into one integer, time first: the
    bits of a positive float grow with it.
    """
    registers = np.full(n_docs * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    time = np.zeros(len(hashes))
    h, d, w, arrival = hashes, owner, weight, 0
    while len(h):
        arrival += 1
        with np.errstate(over="ignore"):
            r = _scramble(h + np.uint64((arrival * 0xA0761D6478BD642F) & (2**64 - 1)))
        uniform = ((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time = time - np.log(uniform) / w
        place = d * m + (_scramble(r ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(registers, place, packed)
        latest = registers.reshape(n_docs, m).max(axis=1)
        going = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) < latest[d]
        h, d, w, time = h[going], d[going], w[going], time[going]
    sig = (registers & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, m)
    sig[np.bincount(owner, minlength=n_docs) == 0] = 0
    return sig


def _grouped(arrays: pd.Series, limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` words."""
    low = total = 0
    for i, x in enumerate(arrays):
        total += len(x)
        if total >= limit:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(arrays):
        yield low, len(arrays)


def version_of(text: str = "text") -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def sketch(docs: DataFrame) -> DataFrame:
    """:data:`SKETCH` of every row with a doc_id: its text's version, a 128-bit key of its words, the number of distinct shingles, and band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low, high in _grouped(pdf["words"]):
                part = pdf.iloc[low:high]
                n = np.array([len(x) for x in part["words"]], dtype=np.int64)
                words = np.concatenate([*part["words"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
                hashes, owner = shingles(words, n)
                h, d, _ = weighted(hashes, owner)
                sig = prob_minhash(h, d, np.ones(len(h)), len(n))
                bands = np.zeros((len(n), BANDS), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        bands = _scramble(bands * np.uint64(31) + sig.reshape(len(n), BANDS, ROWS)[:, :, k])
                same = {c: part[c].to_numpy() for c in ("doc_id", "version", "content", "content2")}
                yield pd.DataFrame({**same, "n": np.bincount(d, minlength=len(n)), "bands": list(bands.view(np.int64))})

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), version_of().alias("version"), word_hashes(F.col("text")).alias("words"))
    return named.select("doc_id", "version", "words", F.xxhash64("words").alias("content"), F.xxhash64(F.lit(1), "words").alias("content2")).mapInPandas(run, SKETCH)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``n``, ``items`` (distinct 64-bit shingle hashes) and ``bits`` (their parity bitmap) of the documents (id, version) in ``ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low, high in _grouped(pdf["words"]):
                part = pdf.iloc[low:high]
                n = np.array([len(x) for x in part["words"]], dtype=np.int64)
                words = np.concatenate([*part["words"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
                h, d, _ = weighted(*shingles(words, n))
                count = np.bincount(d, minlength=len(n))
                place = d * PARITY + (h >> np.uint64(40)).astype(np.int64) % PARITY
                odd = np.bincount(place, minlength=len(n) * PARITY).reshape(len(n), PARITY) & 1
                bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                yield pd.DataFrame({"id": part["doc_id"].to_numpy(), "n": count, "items": np.split(h.view(np.int64), np.cumsum(count)[:-1]), "bits": list(bits)})

    ids = materialise(ids.select(F.col("id").alias("doc_id"), "version").distinct(), "candidate-ids")
    texts = docs.select("doc_id", version_of().alias("version"), "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["doc_id", "version"])
    sets = texts.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words")).mapInPandas(run, "id long, n int, items array<long>, bits array<long>")
    return materialise(sets.dropDuplicates(["id"]), "sets")  # a document may be in several rows


def verify(candidates: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of ``candidates`` whose shingle sets' Jaccard reaches the threshold."""

    left = candidates.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= threshold * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def prefix_pairs(left: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of different components (``left``: id, component) that can reach the threshold, by an exact prefix filter.

    Shingles that one document alone has come first in the order and cannot match, so they are only counted. The parity
    bitmaps differ in at most as many bits as the sets in shingles, which rules out most pairs inside the join.
    """
    items = sets.join(left, "id").select("id", F.explode("items").alias("s"))
    common = items.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ordered = items.join(common, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("c"))
    ordered = ordered.join(sets.select("id", "n", "bits").join(left, "id"), "id")
    alone = F.col("n") - F.size("c")
    # The slack keeps rounding of the products from losing a pair on the threshold.
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-6).cast("int") + 1 - alone
    bits = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(PARITY // 64)]
    entries = ordered.select("id", "component", "n", *bits, alone.alias("alone"), F.posexplode(F.slice("c", F.lit(1), F.greatest(length, F.lit(0)))).alias("p", "v"))
    entries = entries.select(F.col("v.s").alias("s"), "id", "component", "n", (F.col("alone") + F.col("p") + 1).alias("at"), *(f"b{i}" for i in range(PARITY // 64)))
    as_ = lambda p: entries.select("s", *(F.col(c).alias(p + c) for c in entries.columns if c != "s"))
    need = threshold / (1 + threshold) * (F.col("xn") + F.col("yn")) - 1e-6
    room = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat")) + 1
    close = (F.least("xn", "yn") >= threshold * F.greatest("xn", "yn") - 1e-6) & (room >= need) & (F.col("xat") <= F.col("xn") - need + 1) & (F.col("yat") <= F.col("yn") - need + 1)
    apart = F.expr(" + ".join(f"bit_count(xb{i} ^ yb{i})" for i in range(PARITY // 64)))
    close = close & (apart <= F.col("xn") + F.col("yn") - 2 * need)
    pairs = as_("x").join(as_("y"), "s").where((F.col("xid") < F.col("yid")) & (F.col("xcomponent") != F.col("ycomponent")) & close)
    return pairs.select(F.col("xid").alias("a"), F.col("yid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and kept (doc_id = class_id) of every document."""
    classes = _classes(docs, threshold).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return classes.unionByName(nameless)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, version (the text judged) and class_id of every doc_id."""
    every = materialise(sketch(docs), "sketch")
    versions = every.groupBy("doc_id").agg(F.min("version").alias("judged"), F.max("version").alias("last")).where("judged < last").select("doc_id", "judged")
    rows = every.join(materialise(versions, "versions"), "doc_id", "left").where("judged is null or version = judged").drop("judged")
    solo = rows.where(F.col("n") == 0).select("doc_id", "version")
    real = rows.where(F.col("n") > 0)
    # Written, so that the join below has plain sides and adaptive execution can split a hot text.
    first = materialise(real.groupBy("content", "content2").agg(F.min("doc_id").alias("rep")), "first")
    members = real.select("doc_id", "version", "content", "content2").join(first, ["content", "content2"])
    members = materialise(members.select("doc_id", "version", "rep").distinct(), "members")
    own = members.where(F.col("doc_id") == F.col("rep")).select("doc_id")
    reps = materialise(real.join(own, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "version", "n", "bands").dropDuplicates(["id"]), "reps")
    entries = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    buckets = entries.groupBy("band", "bucket").agg(F.min_by("id", F.xxhash64("id", "band")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    # Written apart, or the aggregation would keep adaptive execution from splitting a hot bucket in the join.
    buckets = materialise(buckets.select("band", "bucket", "pivot"), "pivots")
    shared = materialise(entries.join(buckets, ["band", "bucket"]).select("band", "bucket", "id", "pivot"), "buckets")
    stars = shared.where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    sizes = reps.select("id", "n")
    known = stars.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("x")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("y")), "b")
    tried = materialise(known.where(F.least("x", "y") >= threshold * F.greatest("x", "y") - 1e-6).select("a", "b"), "candidates")

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(docs, reps.select("id", "version").join(ids, "id", "left_semi"))

    sets = sets_of(tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct())
    linked = materialise(verify(tried, sets, threshold), "links")
    comp = components(linked)
    # What the pivots may have missed: members of one bucket that are still in different components.
    labelled = materialise(shared.join(comp, "id", "left").select("band", "bucket", "id", F.coalesce("component", "id").alias("component")), "labelled")
    mixed = labelled.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "bucket")
    left = materialise(labelled.join(materialise(mixed, "mixed-buckets"), ["band", "bucket"]).select("id", "component").distinct(), "mixed")
    if not left.isEmpty():
        sets = sets_of(left.select("id"))
        missed = materialise(prefix_pairs(left, sets, threshold).join(tried, ["a", "b"], "left_anti"), "missed")
        found = materialise(verify(missed, sets, threshold), "links")
        if not found.isEmpty():
            linked = linked.unionByName(found)
            comp = components(linked)
    classes = members.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "version", F.coalesce("component", "rep").alias("class_id"))
    return classes.unionByName(solo.select("doc_id", "version", F.col("doc_id").alias("class_id"))).groupBy("doc_id", "version").agg(F.min("class_id").alias("class_id"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, and of rows that repeat its doc_id and text one row.

    Rows that share a doc_id with another text that was judged stay, and so do rows without a doc_id.
    """
    version, again = fresh(docs, "version"), fresh(docs, "again")
    gone = _classes(docs, THRESHOLD).where("doc_id != class_id").select("doc_id", F.col("version").alias(version))
    left = docs.withColumn(version, version_of()).join(gone, ["doc_id", version], "left_anti")
    repeated = left.where("doc_id is not null").groupBy("doc_id", version).agg(F.count("*").alias(again)).where(F.col(again) > 1)
    left = left.join(materialise(repeated, "repeated"), ["doc_id", version], "left")
    once, more = left.where(F.col(again).isNull()), left.where(F.col(again).isNotNull()).dropDuplicates(["doc_id", version])
    return once.unionByName(more).select(*columns(docs))
