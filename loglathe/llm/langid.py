"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased; its UTF-8 bytes with ASCII non-letters as single blanks give subwords: all windows of 2, 3 and 4
bytes, hashed into ``2**BITS`` rows. The text's vector is the average of its subwords' embeddings; a linear
softmax over the learned languages sits on top. Embeddings and weights are trained together by minibatch
stochastic gradient descent in numpy on pieces of a bounded sample of labelled rows.

Calibration uses the held-back tenth of the sample, whole and cut into windows of 8, 16, 32... bytes, by length: for every doubling
of the length one temperature makes the score a probability (a short text is less certain than a long one of equal average), and one limit
decides rejection. Rejection asks whether the text is made of known subwords at all: the mean log share of its subwords over the learned
languages together (so a text in two of them is not rejected). The limit is where rejected held-back windows, each weighing as much as ``CLEAN_WEIGHT``
kept foreign ones, cost least; foreign are the windows of each language seen by a model of the others, and all windows with
their letters exchanged. The model keeps the resulting rates of whole texts.

Since everything after the lookup is linear, prediction folds embeddings, weights and shares into one table of
subword x (languages and share), so whole texts of any length cost one lookup per subword.

Edge cases: null texts and texts without a letter get ``und`` and score 0 and are rejected; an empty training set
yields ``und`` for all; null labels never train; a null doc_id is not held out; repeated rows are predicted alike; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh

BITS = 16
DIM = 12
#: The bound of the training sample: about so many distinct texts of each label, of at most MAX_LABELS labels and ROWS rows, and of each text at most
#: so many characters, at a place that its hash decides.
ROWS_PER_LABEL = 400
MAX_LABELS = 256
ROWS = 20_000
SAMPLE_CHARS = 8192
#: Training pieces are this many bytes long, so short texts are learned too.
PIECE = 400
CLEAN_WEIGHT = 20
#: Length classes: a class holds the lengths (in subwords) from a power of two to the next.
CLASSES = 32
#: Calibration windows of each length that are cut from a held-back text.
WINDOWS = 4
_BLANK = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = _BLANK
_FOLD[65:91] += 32
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(col: str = "text") -> Column:
    return F.coalesce(F.col(col).rlike(r"\p{L}"), F.lit(False))


def folded(text: str) -> np.ndarray:
    """The text's bytes, non-letters as blanks, runs of blanks as one, a blank at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    out = _FOLD[raw]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != _BLANK) | (out[:-1] != _BLANK)
    return out[keep]


def subwords(data: np.ndarray) -> np.ndarray:
    """Hashed ids of all byte windows of 2, 3 and 4 in ``data``; each n has its own hash."""
    x = data.astype(np.uint32)
    pair = (x[:-1] << np.uint32(8)) | x[1:]
    grams = [pair, (pair[:-1] << np.uint32(8)) | x[2:], (pair[:-2] << np.uint32(16)) | pair[2:]]
    return np.concatenate([((g * m) >> np.uint32(32 - BITS)) for g, m in zip(grams, _MIX, strict=True)]).astype(np.int64)


class _Pieces:
    """The subwords of many pieces, two bytes each, in one block: the driver holds those of the whole sample."""

    def __init__(self) -> None:
        self.flat, self.ends = array("H"), [0]

    def add(self, ids: np.ndarray) -> None:
        self.flat.frombytes(ids.astype(np.uint16).tobytes())
        self.ends.append(len(self.flat))

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(self.flat, dtype=np.uint16)[self.ends[i] : self.ends[i + 1]]


class Model:
    """Languages, the folded table (a column of logits per language, then the log share), and temperature and limit by length class."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray) -> None:
        self.labels, self.table, self.bias = labels, table, bias
        self.temperature, self.limit = np.ones(CLASSES), np.full(CLASSES, -np.inf)
        #: What calibration measured: the share rejected of held-back whole texts and of foreign and exchanged ones.
        self.rates: dict[str, float] = {}

    def state(self) -> tuple:
        """Plain values, to be broadcast."""
        return self.labels, self.table, self.bias, self.temperature, self.limit

    @classmethod
    def load(cls, state: tuple) -> Model:
        model = cls(*state[:3])
        model.temperature, model.limit = state[3:]
        return model

    def averages(self, data: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of folded texts: logits, mean log share and length class."""
        out, n = np.empty((len(data), self.table.shape[1])), np.empty(len(data), dtype=np.int64)
        for i, x in enumerate(data):
            ids = subwords(x)
            hist = np.bincount(ids) if len(ids) > 50_000 else None  # long texts: by histogram, in bounded memory
            total = hist @ self.table[: len(hist)] if hist is not None else self.table[ids].sum(axis=0)
            n[i] = max(1, len(ids))
            out[i] = total / n[i]
        return out[:, :-1] + self.bias, out[:, -1], np.log2(n).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected."""
        z, share, kind = self.averages([folded(t) for t in texts])
        p = _softmax(z / self.temperature[kind][:, None])
        best = p.argmax(axis=1)
        return [self.labels[k] for k in best], p[np.arange(len(best)), best], share < self.limit[kind]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 40.0, seed: int = 7) -> Model:
    """Fit on whole texts, cut into pieces; every tenth row is held back for calibration."""
    names = sorted(set(labels))
    code = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 10 == 9
    pieces, target = _Pieces(), []
    for t, y, h in zip(texts, labels, held, strict=True):
        if h:
            continue
        data = folded(t)
        for at in range(0, max(1, len(data) - 3), PIECE):
            if len(data) - at >= 4:
                pieces.add(subwords(data[at : at + PIECE]))
                target.append(code[y])
    y = np.array(target, dtype=np.int64)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    share = np.bincount(y, minlength=len(names)) if len(y) else np.ones(len(names))
    balance = (len(y) / np.maximum(share, 1) / len(names)).astype(np.float32)
    size = 64
    for epoch in range(epochs if len(y) else 0):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            ids = [pieces[i] for i in pick]
            n = np.array([len(x) for x in ids])
            flat = np.concatenate(ids).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            mean = np.add.reduceat(emb[flat], starts, axis=0) / n[:, None].astype(np.float32)
            grad = _softmax(mean @ weight + bias).astype(np.float32)
            grad[np.arange(len(pick)), y[pick]] -= 1
            grad *= balance[y[pick]][:, None] / len(pick)
            back = (grad @ weight.T) / n[:, None]
            weight -= step * 0.05 * (mean.T @ grad)
            bias -= step * 0.005 * grad.sum(axis=0)
            used, where = np.unique(flat, return_inverse=True)
            rows = np.repeat(back, n, axis=0)
            emb[used] -= step * np.stack([np.bincount(where, rows[:, d], len(used)) for d in range(DIM)], axis=1).astype(np.float32)
    if not names:
        return Model([], np.zeros((1 << BITS, 1)), bias.astype(np.float64))
    counts = np.ones((len(names), 1 << BITS))  # add-one
    for i, k in enumerate(y):
        counts[k] += np.bincount(pieces[i], minlength=1 << BITS)
    del pieces
    model = Model(names, np.column_stack([emb @ weight, _log_share(counts)]).astype(np.float64), bias.astype(np.float64))
    back = [(folded(t), code[x]) for t, x, h in zip(texts, labels, held, strict=True) if h]
    if back:
        calibrate(model, counts, back, rng)
    return model


def _log_share(counts: np.ndarray) -> np.ndarray:
    """log of each subword's share, the mean over the languages, against an even spread."""
    return np.log((counts / counts.sum(axis=1, keepdims=True)).mean(axis=0) * counts.shape[1])


def _cheapest(clean: np.ndarray, foreign: list[np.ndarray]) -> float:
    """The limit of least cost, halfway down to the next value below it."""
    kept = sum(1 - np.searchsorted(f, clean) / len(f) for f in foreign) / len(foreign)
    at = int(np.argmin(CLEAN_WEIGHT * np.arange(len(clean)) / len(clean) + kept))
    below = [f[k - 1] for f in foreign if (k := np.searchsorted(f, clean[at]))] + ([clean[at - 1]] if at else [])
    return float((clean[at] + max(below, default=clean[at] - 1)) / 2)


def calibrate(model: Model, counts: np.ndarray, back: list[tuple[np.ndarray, int]], rng: np.random.Generator) -> None:
    """Set the model's temperatures and limits by held-back (folded text, language)."""
    data, truth = [x for x, _ in back], [k for _, k in back]
    whole = len(data)
    for x, k in back:
        size = 8
        while size < len(x):
            for at in rng.integers(0, len(x) - size, WINDOWS):
                data.append(x[at : at + size])
                truth.append(k)
            size *= 2
    z, share, kind = model.averages(data)
    truth = np.array(truth)
    swap = np.arange(256, dtype=np.uint8)  # another language's look: each letter stands for another
    swap[97:123] = 97 + np.roll(np.arange(26), 7)[rng.permutation(26)]
    foreign = [model.averages([swap[x] for x in data])[1]]
    if len(model.labels) > 1:
        unseen = [_log_share(np.delete(counts, k, axis=0)) for k in range(len(model.labels))]
        # One text's ids at a time: those of all windows together are many times the sample.
        foreign.append(np.array([unseen[k][i].mean() if len(i) else 0.0 for i, k in zip(map(subwords, data), truth, strict=True)]))
    grid, last = np.geomspace(0.02, 50, 120), 0
    for c in range(CLASSES):
        here = np.flatnonzero(kind == c)
        if len(here) < 8:  # too few to judge: as for the class below
            model.temperature[c], model.limit[c] = model.temperature[last], model.limit[last]
            continue
        last = c
        if len(model.labels) > 1:
            own = lambda t, h=here: -np.log(_softmax(z[h] / t)[np.arange(len(h)), truth[h]] + 1e-12).mean()
            model.temperature[c] = min(grid, key=own)
        model.limit[c] = _cheapest(np.sort(share[here]), [np.sort(f[here]) for f in foreign])
    model.rates = {"clean": float((share < model.limit[kind])[:whole].mean())}
    for name, f in zip(("exchanged", "foreign"), foreign, strict=False):
        model.rates[name] = float((f < model.limit[kind])[:whole].mean())


def sample_labelled(rows: DataFrame, per_label: int = ROWS_PER_LABEL, max_labels: int = MAX_LABELS, max_rows: int = ROWS) -> pd.DataFrame:
    """About ``per_label`` distinct texts of each of the most frequent labels, chosen by a hash of the text.

    ``rows`` has text and lang. Counts of distinct texts per label (copies count once) come from all rows; the sample is bounded by the
    parameters and :data:`SAMPLE_CHARS`, whatever the input's size.
    """
    fit = rows.where(F.col("lang").isNotNull() & has_letter())
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).orderBy(F.desc("n"), "lang").limit(max_labels).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    per_label = min(per_label, max(1, max_rows // len(counts)))
    rates = [(lang, min(1.0, per_label / max(1, n))) for lang, n in counts.items()]
    some = fit.withColumn("__place", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    some = some.join(F.broadcast(rows.sparkSession.createDataFrame(rates, "lang string, __rate double")), "lang").where("__place < __rate")  # <= MAX_LABELS rows
    start = F.pmod(F.xxhash64("text", F.lit(13)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    # Equal texts hash alike: keep one of each, or one hot text could fill the sample.
    one = some.groupBy("lang", F.xxhash64("text").alias("__key")).agg(F.min(F.struct("__place", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"))).alias("v"))
    one = one.select(F.col("v.__place").alias("__place"), "lang", F.col("v.text").alias("text")).orderBy("__place", "lang", "text").limit(2 * per_label * len(counts))
    return one.select("text", "lang").toPandas()


def fit(rows: DataFrame) -> Model:
    sample = sample_labelled(rows)
    return train(sample["text"].tolist(), sample["lang"].tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and a last column (``language``, or with underscores after it where that is taken): a struct of lang_pred, score and rejected.

    Only ``text`` is read for it. The model, of fixed size, is broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = Model.load(shared.value)
        for texts, letters in batches:
            lang, p, bad = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            some = letters.to_numpy(dtype=bool)
            if m.labels and some.any():
                lang[some], p[some], bad[some] = m.predict(texts[some].tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": p, "rejected": bad})

    judged = F.pandas_udf(score, "lang_pred string, score double, rejected boolean")
    # One column carries all three results, so the function runs once per row.
    return docs.withColumn(fresh(docs, "language"), judged(F.col("text"), has_letter()))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from the documents that are not held out."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "language.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is recognised; rejected ones go."""
    judged = predict(docs, fit(docs.select("text", "lang")))
    return judged.where(~F.col(f"{judged.columns[-1]}.rejected")).select(*columns(docs))
