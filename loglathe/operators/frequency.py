"""The miners that are plain relational queries on word counts: SLCT, LFA, VA and LogCluster.

All take lines (line_id, line) and return (template, n_lines, first_line_id), distinct templates in ``first_line_id``
order. Counts are partial aggregates, so a word in a third of all lines is a few rows per task. Where the words that stay are at most
``IN_PLACE``, which a count of them decides, each line's tokens are looked up in place, and nothing but counts and templates is shuffled. Beyond
that, and where every word's count is needed, the ``COUNTED`` most frequent are looked up in place; only tokens that are not among them are
exploded and joined, and what they give returns to their lines. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import first_seen, tokenized
from ..plans.components import _cut

#: Words that stay are made part of the plan, as a hash set, up to so many.
IN_PLACE = 20_000
#: Counts of so many words, the most frequent, are looked up in place, by 128-bit hashes.
COUNTED = 2_000_000


def exploded(tokens: DataFrame) -> DataFrame:
    return tokens.select("line_id", F.posexplode("tokens").alias("pos", "word"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """word, n over all occurrences."""
    return tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def position_word_counts(tokens: DataFrame) -> DataFrame:
    """pos, word, n."""
    return exploded(tokens).groupBy("pos", "word").agg(F.count("*").alias("n"))


def _regrouped(rows: DataFrame, tokens: DataFrame, *cols: Column) -> DataFrame:
    """line_id and ``x``, the array of structs of a line's tokens in order; lines without a token have an empty one."""
    lines = rows.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", *cols))).alias("x"))
    nothing = F.array().cast(lines.schema["x"].dataType)
    return lines.unionByName(tokens.where(F.size("tokens") == 0).select("line_id", nothing.alias("x")))


def _in_place(tokens: DataFrame, hot: pa.Table, on: list[str], default: int) -> DataFrame:
    """line_id, tokens, ns: what ``hot`` (a, b, n) has for each token, else ``default``."""
    known, check, n = (hot[c].to_numpy() for c in ("a", "b", "n"))
    order = np.lexsort((check, known))
    known, check, n = known[order], check[order], n[order]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, first, second = batch.columns
            one, two = first.flatten().to_numpy(), second.flatten().to_numpy()
            found = np.full(len(one), default, dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                found = np.where((known[at] == one) & (check[at] == two), n[at], default)
            yield pa.RecordBatch.from_arrays([ids, words, _lists(first, found)], ["line_id", "tokens", "ns"])

    sides = F.transform("tokens", lambda w, i: _hash(1, w, i, on)).alias("a"), F.transform("tokens", lambda w, i: _hash(2, w, i, on)).alias("b")
    return tokens.select("line_id", "tokens", *sides).mapInArrow(look_up, tokens.select("line_id", "tokens", F.array(F.lit(1).cast("long")).alias("ns")).schema)


def _lists(like: pa.ListArray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(like.value_lengths().to_numpy())]).astype(np.int32), values)


def _hash(seed: int, word: str | Column, pos: str | Column, on: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), word, *([pos] if "pos" in on else []))


def _counted(tokens: DataFrame, counts: DataFrame, on: list[str], default: int) -> DataFrame:
    """line_id and ``x``, the array of a line's (pos, word, n) in order: n of ``counts`` (above ``default``), else ``default``.

    A frequent word is in most lines, and a join on it would sort most lines in one task. So the :data:`COUNTED` most frequent words are looked
    up in place, which moves no line. Where there are more, only the tokens not found are joined, and what they give returns to the lines.
    """
    counts = _cut(counts.select(*on, "n").where(F.col("n") > default))
    by_count = sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)
    held, least = 0, None
    for n, words in by_count:
        held += words
        if held > COUNTED:
            break
        least = n
    hot = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    place = "pos" if "pos" in on else F.lit(0)
    hot = hot.select(_hash(1, "word", place, on).alias("a"), _hash(2, "word", place, on).alias("b"), "n").toArrow()
    if (np.diff(np.sort(hot["a"].to_numpy())) == 0).any():
        raise RuntimeError("two words have one hash")
    if held <= COUNTED:
        rows = _in_place(tokens, hot, on, default)
    else:
        rows = _in_place(tokens, hot, on, -1)
        rare = counts.where(F.col("n") < least) if least is not None else counts
        left = rows.select("line_id", F.posexplode(F.arrays_zip("tokens", "ns")).alias("pos", "e")).where("e.ns = -1").select("line_id", "pos", F.col("e.tokens").alias("word"))
        more = left.join(rare, on).groupBy("line_id").agg(F.collect_list("pos").alias("places"), F.collect_list("n").alias("found"))
        rows = rows.join(more, "line_id", "left").select("line_id", "tokens", "ns", "places", "found")

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, words, ns, places, found = batch.columns
                values = ns.flatten().to_numpy().copy()
                starts = np.cumsum(ns.value_lengths().to_numpy()) - ns.value_lengths().to_numpy()
                sizes = places.value_lengths().fill_null(0).to_numpy()
                values[np.repeat(starts, sizes) + places.flatten().to_numpy()] = found.flatten().to_numpy()
                values[values == -1] = default
                yield pa.RecordBatch.from_arrays([ids, words, _lists(ns, values)], ["line_id", "tokens", "ns"])

        rows = rows.mapInArrow(fill, rows.select("line_id", "tokens", "ns").schema)
    rows = rows.withColumn("pairs", F.zip_with("tokens", "ns", lambda w, c: F.struct(w.alias("word"), c.alias("n"))))
    return rows.select("line_id", F.transform("pairs", lambda e, i: F.struct(i.alias("pos"), e["word"].alias("word"), e["n"].alias("n"))).alias("x"))


def _masked(tokens: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """line_id, template: each token that ``kept`` has, else null."""
    kept = _cut(kept.select(*on, "n"))
    few = kept.select(*on).limit(IN_PLACE + 1).collect()
    if len(few) <= IN_PLACE:
        placed = on != ["word"]
        known = [f"{r['pos']} {r['word']}" if placed else r["word"] for r in few]
        name = (lambda w, i: F.concat_ws(" ", i.cast("string"), w)) if placed else (lambda w, i: w)
        cell = (lambda w, i: F.when(name(w, i).isin(known), w)) if known else (lambda w, i: F.lit(None).cast("string"))
        return tokens.select("line_id", F.transform("tokens", lambda w, i: cell(w, i)).alias("template"))
    x = _counted(tokens, kept, on, 0)
    return x.select("line_id", F.transform("x", lambda e: F.when(e["n"] > 0, e["word"])).alias("template"))


def slct(lines: DataFrame, wp_supp: int = 50, tpl_supp: int = 20) -> DataFrame:
    """Words frequent at their position (more than ``wp_supp``) make candidates; those of more than ``tpl_supp`` lines stay."""
    tokens = tokenized(lines)
    frequent = position_word_counts(tokens).where(F.col("n") > wp_supp)
    return first_seen(_masked(tokens, frequent, ["pos", "word"])).where(F.col("n_lines") > tpl_supp)


def _gap_masked(rows: DataFrame) -> DataFrame:
    """line_id, template: the words on the upper side of the first largest gap of the line's sorted counts.

    Each step is a column that the next uses more than once, so the optimizer does not move it into a lambda, where it
    would be computed for every token.
    """
    rows = rows.withColumn("counts", F.sort_array(F.transform("x", lambda e: e["n"])))
    less = F.greatest(F.size("counts") - 1, F.lit(0))
    rows = rows.withColumn("gaps", F.zip_with(F.slice("counts", F.lit(2), less), F.slice("counts", F.lit(1), less), lambda a, b: a - b))
    largest = F.array_max("gaps")
    rows = rows.withColumn("edge", F.when(largest > 0, F.element_at("counts", F.array_position("gaps", largest).cast("int"))))
    words = F.transform("x", lambda e: e["word"])
    upper = F.transform("x", lambda e: F.when(e["n"] > F.col("edge"), e["word"]))
    return rows.select("line_id", F.when(F.col("edge").isNull(), words).otherwise(upper).alias("template"))


def lfa(lines: DataFrame) -> DataFrame:
    """Per line, the words above the first largest gap between its words' (position, word) counts stay."""
    tokens = tokenized(lines)
    return first_seen(_gap_masked(_counted(tokens, position_word_counts(tokens), ["pos", "word"], 1)))


def va(lines: DataFrame, method: str, threshold: float) -> DataFrame:
    """Word-frequency miner.

    ``static``: words with more than ``threshold`` occurrences; ``relative-line``: whose occurrences per line exceed it;
    ``relative-variable``: per line, the first ``int(len * threshold)`` tokens by (count, place) go, and a word stays
    wherever one of its occurrences stays.
    """
    tokens = tokenized(lines)
    words = word_counts(tokens)
    if method == "static":
        return first_seen(_masked(tokens, words.where(F.col("n") > threshold), ["word"]))
    if method == "relative-line":
        total = lines.count()
        return first_seen(_masked(tokens, words.where(F.col("n") / F.lit(total) > threshold), ["word"]))
    if method == "relative-variable":
        x = _counted(tokens, words, ["word"], 1)
        order = F.sort_array(F.transform("x", lambda e: F.struct(e["n"].alias("n"), e["pos"].alias("pos"), e["word"].alias("word"))))
        drop = F.floor(F.size("x") * F.lit(float(threshold))).cast("int")
        kept = F.transform(F.slice(order, drop + 1, F.greatest(F.size("x") - drop, F.lit(0))), lambda e: e["word"])
        x = x.withColumn("kept", kept)
        none = F.transform("x", lambda e: F.lit(None).cast("string"))
        some = F.transform("x", lambda e: F.when(F.array_contains("kept", e["word"]), e["word"]))
        # Two uses of "kept" keep it out of the lambda.
        return first_seen(x.select("line_id", F.when(F.size("kept") == 0, none).otherwise(some).alias("template")))
    raise NotImplementedError(method)


def logcluster(lines: DataFrame, freq_bar: int) -> DataFrame:
    """Words of at least ``freq_bar`` occurrences stay."""
    tokens = tokenized(lines)
    return first_seen(_masked(tokens, word_counts(tokens).where(F.col("n") >= freq_bar), ["word"]))


def logcluster_patterns(lines: DataFrame, freq_bar: int) -> DataFrame:
    """Patterns of frequent words and gap ranges, one per sequence of frequent words.

    pattern: array of (word, least, most), word null for a gap; n_lines; first_line_id. A gap before a word ranges over the
    lengths met there, none included; the gap after the last word only over lengths that are not 0. A single
    length is a gap of that length; only zeros are no gap.
    """
    tokens = tokenized(lines)
    frequent = word_counts(tokens).where(F.col("n") >= freq_bar).select("word", F.lit(True).alias("keep"))
    x = _regrouped(exploded(tokens).join(frequent, "word", "left"), tokens, F.coalesce("keep", F.lit(False)).alias("keep"))
    start = F.struct(F.array().cast("array<int>").alias("gaps"), F.lit(0).alias("run"))
    step = lambda acc, e: F.when(e["keep"], F.struct(F.concat(acc["gaps"], F.array(acc["run"])).alias("gaps"), F.lit(0).alias("run"))).otherwise(
        F.struct(acc["gaps"].alias("gaps"), (acc["run"] + 1).alias("run"))
    )
    gaps = F.aggregate("x", start, step, lambda acc: F.concat(acc["gaps"], F.array(acc["run"])))
    key = F.transform(F.filter("x", lambda e: e["keep"]), lambda e: e["word"])
    keyed = x.select("line_id", key.alias("key"), gaps.alias("gaps"))
    slots = keyed.select("key", F.posexplode("gaps").alias("slot", "gap")).where((F.col("slot") < F.size("key")) | (F.col("gap") > 0))
    ranges = slots.groupBy("key", "slot").agg(F.min("gap").alias("least"), F.max("gap").alias("most")).where("most > 0")
    listed = ranges.groupBy("key").agg(F.collect_list(F.struct("slot", "least", "most")).alias("ranges"))
    heads = keyed.groupBy("key").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line_id"))
    none = F.lit(None).cast("string")
    ranged = lambda s: F.transform(F.filter("ranges", lambda r: r["slot"] == s), lambda r: F.struct(none.alias("word"), r["least"].alias("least"), r["most"].alias("most")))
    word = lambda w: F.array(F.struct(w.alias("word"), F.lit(None).cast("int").alias("least"), F.lit(None).cast("int").alias("most")))
    body = F.flatten(F.transform("key", lambda w, i: F.concat(ranged(i), word(w))))
    full = heads.join(listed, "key", "left")
    none_ranges = F.expr("cast(array() as array<struct<slot:int,least:int,most:int>>)")
    return full.withColumn("ranges", F.coalesce("ranges", none_ranges)).select(F.concat(body, ranged(F.size("key"))).alias("pattern"), "n_lines", "first_line_id")


def pattern_text(pattern: str) -> Column:
    """A pattern as text: words, ``[n]`` and ``[least,most]``."""
    gap = lambda e: F.when(e["least"] == e["most"], F.format_string("[%d]", e["most"])).otherwise(F.format_string("[%d,%d]", e["least"], e["most"]))
    return F.array_join(F.transform(pattern, lambda e: F.coalesce(e["word"], gap(e))), " ")
