"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

A text becomes its words and numbers. In the *template*, numbers become ``<num>``, capitalised words ``<name>`` and
units after a number ``<unit>``; other words are lower-cased. Windows of ``width`` tokens are hashed in two channels: the
template, and the plain lower-cased words (which also finds passages whose case was changed). Windows of the documents that begin and end
with the same two tokens as some benchmark window (fixed-size bit tables decide) are hash-joined with those of the benchmark; a match
is verified on the words, and the slots of all matched windows of an (item, document, alignment) must map the item's values
one-to-one to the document's. A document that repeats an item with other numbers, names or units is thus caught; windows with fewer
than ``MIN_LITERAL`` plain words say too little about an item and are not used as templates. Where no window of an item has so many, its
template windows are widened: to the least width at which one has, else to the whole item (an item of fewer words altogether, or without
any plain one, has no template form). Where slots contradict each other, only plain windows count.

Edge cases: null, empty and shorter-than-a-window texts never match, except that an item of fewer than ``width`` words is
matched by a window of its own length, an item of one word wherever the word stands; items without a word match nothing; rows without a
doc_id are not reported and stay; repeated rows of either table count once per (doc_id, item_id), and rows that share a doc_id with
another text are one document with several texts; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, materialise

WIDTH = 8
MIN_LITERAL = 5
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "mv", "a", "ma", "j", "kj",
    "n", "pa", "kpa", "bar", "k", "c", "f", "b", "kb", "mb", "gb", "tb", "in", "ft", "yd", "mi", "oz", "lb", "percent", "euro", "euros", "dollar", "dollars", "meter", "meters",
    "metre", "metres", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years",
)
#: The benchmark's windows are broadcast up to so many rows (about 200 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Bits in a table of the benchmark's window ends, at least and at most: 16 places for each window in between.
BIT_PLACES = (20, 22)

NUM, NAME, UNIT = "<num>", "<name>", "<unit>"


def words_of(text: Column) -> Column:
    """Numbers (with inner points and commas) and words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}]*"), F.lit(0))


def template_of(words: str, lower: str) -> Column:
    """The canonical token of each word; ``lower`` names the lower-cased words."""
    units = F.array(*(F.lit(u) for u in UNITS))
    # A token begins with a letter or a numeral: in ASCII, numerals come before ":". The expression is only needed beyond ASCII.
    number = lambda x: (x < ":") | ((x >= "\x80") & x.rlike(r"^\p{N}"))

    def canon(x: Column, i: Column) -> Column:
        low = F.get(lower, i)
        return (
            F.when(number(x), NUM)
            .when(number(F.get(words, i - 1)) & F.array_contains(units, low), UNIT)
            .when((low != x) & (F.length(x) > 1) & (F.substring(x, 2, 1 << 30) == F.substring(low, 2, 1 << 30)), NAME)
            .otherwise(low)
        )

    return F.transform(words, canon)


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.hash(x))


def _pair(h: Column, i: Column) -> Column:
    """A hash of the tokens i and i + 1 (from 0)."""
    return F.hash(F.get(h, i), F.get(h, i + 1))


def _pairs(h: Column, places: int) -> Column:
    """The place in a bit table of every token with the next (the last with none)."""
    return F.transform(h, lambda x, i: F.hash(x, F.get(h, i + 1)).bitwiseAND(F.lit((1 << places) - 1)))


def _bit_table(marks: DataFrame, end: str, is_template: bool, places: int) -> Column:
    """A constant array of 64-bit words with the bits of the benchmark's window ends set."""
    words = [0] * (1 << (places - 6))
    at = F.col(end).bitwiseAND(F.lit((1 << places) - 1))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63))))
    for r in marks.where(F.col("is_template") == is_template).groupBy(F.shiftright(at, 6).alias("w")).agg(bits.alias("b")).collect():  # at most len(words) rows
        words[r["w"]] = r["b"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _has_bit(table: Column, x: Column) -> Column:
    """``x``, a place of the table, is used twice: cheap expressions only. A shift takes the low six bits of its width."""
    return F.call_function("shiftright", F.get(table, F.shiftright(x, 6)), x).bitwiseAND(F.lit(1).cast("long")) == 1


def _begins(pairs: Column, table: Column) -> Column:
    """The places (from 1) where a window of two tokens or more can begin."""
    return F.array_remove(F.transform(pairs, lambda p, i: F.when(_has_bit(table, p), i + 1).otherwise(0)), 0)


def _windows(h: Column, pairs: Column, begins: Column, ends: Column, width: int, is_template: bool) -> Column:
    """Place and hash of those windows of ``width`` that can be a benchmark window; ``begins`` as :func:`_begins` gives them."""
    if width == 1:
        starts = F.transform(h, lambda _, i: i + 1)
    else:
        starts = F.filter(begins, lambda i: (i + (width - 1) <= F.size(h)) & _has_bit(ends, F.get(pairs, i + (width - 3))))
    return F.transform(
        starts,
        lambda i: F.struct(F.lit(width).alias("k"), F.lit(is_template).alias("is_template"), i.alias("place"), F.xxhash64(F.slice(h, i, width), F.lit(int(is_template))).alias("hash")),
    )


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, at, words, templ (the item's window, raw and canonical), is_template, hash, and the hashes of its first and last two tokens."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    items = items.withColumn("lower", F.transform("w", F.lower))
    # Written, or the template would be computed again at every place of it.
    items = materialise(items.select("item_id", "w", template_of("w", "lower").alias("t"), F.least(F.size("w"), F.lit(width)).alias("k")), "items")
    literal = lambda x: ~x.isin(NUM, NAME, UNIT)
    items = items.withColumn("places", F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: literal(F.get("t", i - 1))))
    spans = F.transform(F.slice("places", F.lit(1), F.greatest(F.size("places") - (MIN_LITERAL - 1), F.lit(0))), lambda x, i: F.get("places", i + (MIN_LITERAL - 1)) - x + 1)
    wide = items.where((F.size("places") > 0) & (F.size("w") >= MIN_LITERAL)).withColumn("k", F.greatest("k", F.coalesce(F.array_min(spans), F.size("w"))))

    def cut(rows: DataFrame) -> DataFrame:
        at = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("at"))
        return at.select("item_id", "at", "k", F.slice("w", F.col("at"), F.col("k")).alias("words"), F.slice("t", F.col("at"), F.col("k")).alias("templ"), (F.col("k") == F.size("w")).alias("whole"))

    plain = cut(items).select("*", F.lit(False).alias("is_template"), _hashes(F.transform("words", F.lower)).alias("h"))
    templ = cut(wide).where(F.col("whole") | (F.size(F.filter("templ", literal)) >= MIN_LITERAL)).select("*", F.lit(True).alias("is_template"), _hashes(F.col("templ")).alias("h"))
    both = plain.unionByName(templ)
    ends = _pair(F.col("h"), F.lit(0)).alias("begin"), _pair(F.col("h"), F.col("k") - 2).alias("end")
    return both.select("*", F.xxhash64("h", F.col("is_template").cast("int")).alias("hash"), *ends).drop("h", "whole")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per (doc_id, item_id) found: n_windows, exact (all slots alike) and the alignments found."""
    marks = materialise(benchmark_windows(benchmark, width), "marks")
    n_marks = marks.count()
    kinds = [(r["k"], r["is_template"]) for r in marks.select("k", "is_template").distinct().collect()]  # a row per channel and width, at most an item's words
    places = min(max(BIT_PLACES[0], (16 * n_marks).bit_length()), BIT_PLACES[1])
    tokens = docs.where("doc_id is not null").select("doc_id", words_of(F.col("text")).alias("words"))
    tokens = tokens.withColumn("lower", F.transform("words", F.lower))
    tokens = tokens.select("doc_id", "words", _hashes(F.col("lower")).alias("plain"), _hashes(template_of("words", "lower")).alias("templ"))
    # Where a window can begin is decided once per channel, for all widths.
    for name in sorted({"templ" if t else "plain" for k, t in kinds if k > 1}):
        h, table = F.col(name), _bit_table(marks.where("k > 1"), "begin", name == "templ", places)
        tokens = tokens.withColumn(f"{name}_pairs", _pairs(h, places)).withColumn(f"{name}_begins", _begins(F.col(f"{name}_pairs"), table))
    found = []
    for k, t in sorted(kinds):
        name = "templ" if t else "plain"
        pairs, begins = (F.col(f"{name}_pairs"), F.col(f"{name}_begins")) if k > 1 else (None, None)
        found.append(_windows(F.col(name), pairs, begins, _bit_table(marks.where("k > 1"), "end", t, places) if k > 1 else None, k, t))
    none = F.array().cast("array<struct<k:int,is_template:boolean,place:int,hash:bigint>>")
    exploded = tokens.select("doc_id", "words", F.explode(F.concat(*found) if found else none).alias("v"))
    exploded = exploded.select("doc_id", "v.*", F.slice("words", F.col("v.place"), F.col("v.k")).alias("dw"))
    marks = marks.select("hash", "k", "is_template", "item_id", "at", F.col("words").alias("iw"), "templ")
    hits = exploded.join(F.broadcast(marks) if n_marks <= BROADCAST_ROWS else marks, ["hash", "k", "is_template"])
    pairs = hits.withColumn("z", F.arrays_zip("iw", "dw", "templ"))
    slot = lambda z: F.col("is_template") & z["templ"].isin(NUM, NAME, UNIT)
    real = pairs.where(F.forall("z", lambda z: slot(z) | (F.lower(z["iw"]) == F.lower(z["dw"]))))
    slots = F.transform(F.filter("z", slot), lambda z: F.struct(z["templ"].alias("kind"), F.lower(z["iw"]).alias("item"), F.lower(z["dw"]).alias("doc")))
    aligned = real.select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift"), "at", "is_template", slots.alias("slots")).groupBy("doc_id", "item_id", "shift")
    # An alignment has at most one window per position of its item and channel.
    plain = F.count_distinct(F.when(~F.col("is_template"), F.col("at"))).alias("plain")
    found = aligned.agg(F.count_distinct("at").alias("n"), plain, F.array_distinct(F.flatten(F.collect_set("slots"))).alias("m"))
    one_to_one = (F.size("m") == F.size(F.array_distinct(F.transform("m", lambda s: F.struct(s["kind"], s["item"])))) ) & (
        F.size("m") == F.size(F.array_distinct(F.transform("m", lambda s: F.struct(s["kind"], s["doc"]))))
    )
    same = one_to_one & F.forall("m", lambda s: s["item"] == s["doc"])
    return (
        found.select("doc_id", "item_id", F.when(one_to_one, F.col("n")).otherwise(F.col("plain")).alias("n"), same.alias("same"))
        .where("n > 0")
        .groupBy("doc_id", "item_id")
        .agg(F.max("n").cast("long").alias("n_windows"), F.bool_or("same").alias("exact"), F.count("*").alias("n_alignments"))
    )


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    from .common import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark item."""
    from .common import table

    return docs.join(find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "doc_id", "left_anti").select(*columns(docs))
