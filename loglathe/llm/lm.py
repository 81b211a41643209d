"""Document scores by masked pseudo-likelihood with a bidirectional window network.

A token is a lower-cased word or mark, hashed into ``2**VOCAB_BITS`` ids. Its probability given both sides factors into a class, a part of the class
and the token: p(token | window) = p(class | window) * p(part | class, window) * p(token | part). The network (numpy) sums position-wise
embeddings of the ``SIDE`` tokens on either side, applies tanh, and has a softmax over ``CLASSES`` classes, bands of equal corpus
mass in order of frequency, and one over the ``PARTS`` parts of the target's class. Token frequencies inside a part come from counts over
*all* documents. Frequent context tokens have an embedding of their own, the others share by hash. A document's
score is the sum of its tokens' conditional log-probabilities, each token predicted from both sides, never seen itself.

The texts are tokenised once; counts, training and scores read the written ids. Training covers all documents and all positions: every partition
starts from the same weights, runs stochastic gradient descent over its own documents with each position as a target once, and
the partitions' weights are averaged, weighted by their targets. What travels per partition is one set of weights, so it grows with
the corpus, as do the counted ids; the average has a fixed size. Weights, and by that scores, depend on how rows lie in partitions.

Edge cases: null, empty and token-less texts have 0 tokens, a sum of 0 and a null mean; one-token texts are predicted from
padding; repeated rows get equal scores, a null doc_id stays null; an empty table gives an empty result; extra columns are ignored; texts of
any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_parts, id_whole, materialise

VOCAB_BITS = 20
CLASSES = 64
PARTS = 32
SIDE = 2
DIM = 16
RATE = 1.0
#: Context embeddings: one for each of the most frequent ids, then so many that the other ids share, then padding.
OWN = 3072
SHARED = 1024
VOCAB = 1 << VOCAB_BITS
PAD = OWN + SHARED
#: The logit of a part that no token is in.
_NONE = -30.0
_TINY = np.float32(1e-30)


def token_ids(text: Column) -> Column:
    """Ids of a text's words and single marks."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"), F.lit(0))
    return F.transform(tokens, lambda w: F.hash(w).bitwiseAND(F.lit(VOCAB - 1)))


class Vocabulary:
    """What the counts say of every id: class, part, log p(token | part), context embedding, and the parts' first logits."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        seen = int(np.count_nonzero(counts))
        # An id that was never counted weighs half a token.
        weight = np.where(counts > 0, counts, 0.5)
        self.cls, self.part, self.context = (np.zeros(VOCAB, dtype=np.int16) for _ in range(3))
        self.cls[:], self.context[:] = CLASSES - 1, OWN + np.arange(VOCAB) % SHARED
        top = order[:seen]
        mass = np.cumsum(counts[top])
        if seen:
            self.cls[top] = np.minimum((mass - counts[top] / 2) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int16)
            starts = np.searchsorted(self.cls[top], np.arange(CLASSES))
            self.part[top] = (np.arange(seen) - starts[self.cls[top]]) % PARTS
            self.context[top[:OWN]] = np.arange(min(seen, OWN))
        cell = self.cls.astype(np.int32) * PARTS + self.part
        total = np.bincount(cell[top], counts[top], CLASSES * PARTS) if seen else np.zeros(CLASSES * PARTS)
        self.inside = np.log(weight / np.maximum(total[cell], 0.5)).astype(np.float32)
        by_class = total.reshape(CLASSES, PARTS)
        share = by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1)
        self.first = np.where(share > 0, np.log(np.maximum(share, 1e-12)), _NONE).astype(np.float32)

    def state(self) -> tuple:
        """Plain values, to be broadcast."""
        return self.cls, self.part, self.inside, self.context, self.first

    @classmethod
    def load(cls, state: tuple) -> Vocabulary:
        out = cls.__new__(cls)
        out.cls, out.part, out.inside, out.context, out.first = state
        return out


class Network:
    """Weights as flat arrays; the same shapes on every partition."""

    def __init__(self, first: np.ndarray | None = None, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (2 * SIDE, PAD + 1, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (DIM, CLASSES)).astype(np.float32)
        self.bias = np.zeros(CLASSES, dtype=np.float32)
        self.out_part = np.zeros((DIM, PARTS), dtype=np.float32)
        self.bias_part = np.zeros((CLASSES, PARTS), dtype=np.float32) if first is None else first.copy()

    def _arrays(self) -> list[np.ndarray]:
        return [self.emb, self.out, self.bias, self.out_part, self.bias_part]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self._arrays()])

    def load(self, flat: np.ndarray) -> Network:
        at, parts = 0, []
        for a in self._arrays():
            parts.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        self.emb, self.out, self.bias, self.out_part, self.bias_part = parts
        return self

    def hidden(self, window: np.ndarray) -> np.ndarray:
        h = self.emb[0][window[0]]
        for k in range(1, 2 * SIDE):
            h = h + self.emb[k][window[k]]
        return np.tanh(h, out=h)

    def log_target(self, window: np.ndarray, cls: np.ndarray, part: np.ndarray) -> np.ndarray:
        """log p(class | window) + log p(part | class, window)."""
        h, out = self.hidden(window), np.zeros(len(cls))
        for z, target in ((h @ self.out + self.bias, cls), (h @ self.out_part + self.bias_part[cls], part)):
            z -= z.max()  # of all rows: logits are of one size, and a maximum by row costs as much as the exponentials
            own = z[np.arange(len(cls)), target].copy()
            out += own - np.log(np.maximum(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=z.dtype), _TINY))
        return out

    def step(self, window: np.ndarray, cls: np.ndarray, part: np.ndarray, rate: float) -> None:
        h, n = self.hidden(window), len(cls)
        back = np.zeros_like(h)
        for z, weight, target in ((h @ self.out + self.bias, self.out, cls), (h @ self.out_part + self.bias_part[cls], self.out_part, part)):
            z -= z.max()
            np.exp(z, out=z)
            z *= (1 / (n * np.maximum(z @ np.ones(z.shape[1], dtype=z.dtype), _TINY)))[:, None]
            z[np.arange(n), target] -= np.float32(1 / n)
            back += z @ weight.T
            weight -= rate * (h.T @ z)
            if weight is self.out:
                self.bias -= rate * z.sum(axis=0)
            else:
                self._scatter(self.bias_part, cls, z, rate)
        back *= 1 - h * h
        for k in range(2 * SIDE):
            self._scatter(self.emb[k], window[k], back, rate * n * 0.02)

    @staticmethod
    def _scatter(table: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """table[rows] -= rate * grad, with repeated rows summed first."""
        order = np.argsort(rows, kind="stable")
        there = rows[order]
        starts = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
        table[there[starts]] -= rate * np.add.reduceat(grad[order], starts, axis=0)


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents joined with SIDE pads between them; the positions of tokens."""
    gap = np.full(SIDE, -1, dtype=np.int32)
    parts = [gap]
    for a in arrays:
        parts += (a, gap)
    x = np.concatenate(parts)
    return x, np.flatnonzero(x >= 0)


def _context(x: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    return np.where(x >= 0, vocabulary.context[x], PAD)


def _windows(context: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [context[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))]


def _chunks(ids: pd.Series, limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, x in enumerate(ids):
        total += len(x)
        if total >= limit:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(ids):
        yield low, len(ids)


def _steps(at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for low in range(0, len(at), size):
        yield at[low : low + size]


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, no_id and the ids of every row, written once."""
    return materialise(docs.select(*id_parts(), token_ids(F.col("text")).alias("ids")), "token-ids")


def count_tokens(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(VOCAB, dtype=np.int64)
        for pdf in batches:
            for low, high in _chunks(pdf["ids"]):
                total += np.bincount(np.concatenate(pdf["ids"].iloc[low:high].tolist() or [np.zeros(0, dtype=np.int64)]).astype(np.int64), minlength=VOCAB)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    got = tokens.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most VOCAB rows, as columns: as rows they would take hundreds of MB of the driver's memory, in the JVM and in Python.
    got = got.toArrow()
    out = np.zeros(VOCAB)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def train(tokens: DataFrame, vocabulary: Vocabulary, rounds: int = 1, seed: int = 1) -> Network:
    """The average of the networks that the partitions train, over all documents; ``rounds`` times."""
    spark = tokens.sparkSession
    flat, known = Network(vocabulary.first, seed).flat(), spark.sparkContext.broadcast(vocabulary.state())
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pd.DataFrame], shared: object = shared) -> Iterator[pd.DataFrame]:
            net, vocab, seen = Network().load(shared.value), Vocabulary.load(known.value), 0
            for pdf in batches:
                for low, high in _chunks(pdf["ids"]):
                    x, at = _flat([np.asarray(a, dtype=np.int32) for a in pdf["ids"].iloc[low:high]])
                    context = _context(x, vocab)
                    # The order of targets depends on place and content only, so a retried task repeats itself.
                    rng = np.random.default_rng([seed, len(at), int(x[at[:64]].sum()) if len(at) else 0])
                    for some in _steps(rng.permutation(at), 1024):
                        net.step(_windows(context, some), vocab.cls[x[some]], vocab.part[x[some]], RATE)
                    seen += len(at)
            if seen:
                yield pd.DataFrame({"weights": [(net.flat() * np.float64(seen)).tolist()], "n": [seen]})

        partial = tokens.select("ids").mapInPandas(run, "weights array<double>, n long").select("n", F.posexplode("weights").alias("at", "w"))
        mean = partial.groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w"))
        got = mean.toArrow()  # one row per weight
        if got.num_rows:
            flat = got.sort_by("at")["w"].to_numpy()
    return Network().load(flat)


def score(tokens: DataFrame, network: Network, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, pll (the sum) and mean_pll of every row of :func:`tokenised`."""
    shared = tokens.sparkSession.sparkContext.broadcast((network.flat(), vocabulary.state()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, vocab = Network().load(shared.value[0]), Vocabulary.load(shared.value[1])
        for pdf in batches:
            for low, high in _chunks(pdf["ids"]):
                part = pdf.iloc[low:high]
                n = np.array([len(a) for a in part["ids"]], dtype=np.int64)
                x, at = _flat([np.asarray(a, dtype=np.int32) for a in part["ids"]])
                context, logs = _context(x, vocab), np.empty(len(at))
                for low_at in range(0, len(at), 8192):
                    some = at[low_at : low_at + 8192]
                    own = x[some]
                    logs[low_at : low_at + 8192] = net.log_target(_windows(context, some), vocab.cls[own], vocab.part[own]) + vocab.inside[own]
                total = np.bincount(np.repeat(np.arange(len(n)), n), logs, len(n))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "no_id": part["no_id"].to_numpy(), "n_tokens": n, "pll": total})

    scored = tokens.select("doc_id", "no_id", "ids").mapInPandas(run, "doc_id long, no_id boolean, n_tokens long, pll double")
    return scored.select(id_whole(), "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Count, train and score: every step over all documents."""
    tokens = tokenised(docs)
    vocabulary = Vocabulary(count_tokens(tokens))
    return score(tokens, train(tokens, vocabulary), vocabulary)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    from .common import table

    return score_documents(table(spark, sf_dir, "documents"))
