"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import char_classes, length_cosine, mismatch_ratio, specificity, template_text, tokenized
from ..operators import bucketed, drain, frequency, iplom, lke, match, neural, ordered, search
from ..sources import lines as src
from ..streaming import online

Query = Callable[[SparkSession, str], DataFrame]


def _shown(templates: DataFrame) -> DataFrame:
    """A template table with the template as text."""
    return templates.select(template_text("template").alias("template"), F.size("template").alias("n_tokens"), F.col("n_lines").cast("long").alias("n_lines"), "first_line_id")


def _mined(miner: Callable[..., DataFrame], source: Callable[[SparkSession, str], DataFrame] = src.event_lines, **params: object) -> Query:
    return lambda spark, d: _shown(miner(source(spark, d), **params))


def _lfa_templates(spark: SparkSession, d: str) -> DataFrame:
    return frequency.lfa(src.event_lines(spark, d)).withColumn("template_id", F.col("first_line_id"))


def _slct_templates(spark: SparkSession, d: str) -> DataFrame:
    return frequency.slct(src.event_lines(spark, d), 150, 20).withColumn("template_id", F.col("first_line_id"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = tokenized(src.document_lines(spark, d))
    return t.select("line_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tokenized(src.document_lines(spark, d)).groupBy(F.size("tokens").alias("n_tokens")).agg(F.count("*").alias("n"))


def distinct_lines_topn(spark: SparkSession, d: str) -> DataFrame:
    return src.distinct_lines(src.conversation_lines(spark, d), 30)


def word_freq(spark: SparkSession, d: str) -> DataFrame:
    return frequency.word_counts(tokenized(src.event_lines(spark, d)))


def pos_word_freq(spark: SparkSession, d: str) -> DataFrame:
    return frequency.position_word_counts(tokenized(src.event_lines(spark, d)))


def column_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return frequency.position_word_counts(tokenized(src.event_lines(spark, d))).groupBy("pos").agg(F.count("*").alias("n_distinct"))


def logcluster_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = frequency.logcluster_patterns(src.event_lines(spark, d), 500)
    return p.select(frequency.pattern_text("pattern").alias("pattern"), "n_lines", "first_line_id")


def iplom_stage1(spark: SparkSession, d: str) -> DataFrame:
    return iplom.stage1(src.document_lines(spark, d)).groupBy("n").agg(F.count("*").alias("n_lines"))


def iplom_stage2(spark: SparkSession, d: str) -> DataFrame:
    rows = iplom.stage2(iplom.stage1(src.event_lines(spark, d)))
    return rows.groupBy("n", "split_pos", "p2").agg(F.count("*").alias("n_lines"))


def iplom_stage3(spark: SparkSession, d: str) -> DataFrame:
    rows = iplom.stage3(iplom.stage2(iplom.stage1(src.event_lines(spark, d))))
    return rows.groupBy("n", "p2", "kind").agg(F.count("*").alias("n_lines"), F.count_distinct("p3").alias("n_parts"))


def match_tpl2logs(spark: SparkSession, d: str) -> DataFrame:
    return _shown(match.templates_to_lines(src.event_lines(spark, d), _slct_templates(spark, d)))


def match_log2tpls(spark: SparkSession, d: str) -> DataFrame:
    m = match.lines_to_templates(src.event_lines(spark, d), _slct_templates(spark, d))
    return m.select(F.array_join("tokens", " ").alias("log"), F.size("templates").alias("n_templates"), F.array_join(F.transform("templates", template_text), " ; ").alias("templates"))


def missed_logs(spark: SparkSession, d: str) -> DataFrame:
    return match.missed_lines(src.event_lines(spark, d), frequency.slct(src.event_lines(spark, d), 150, 2000).withColumn("template_id", F.col("first_line_id")))


def missed_tpls(spark: SparkSession, d: str) -> DataFrame:
    """Templates of the events that no turn of the conversations matches."""
    return match.missed_templates(src.conversation_lines(spark, d), _slct_templates(spark, d)).select(template_text("template").alias("template"))


def template_cover_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = match.cover_pairs(_all_templates(spark, d))
    return pairs.select(template_text("parent").alias("parent"), template_text("child").alias("child"))


def _all_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of two miners, so that some cover others."""
    lines = src.event_lines(spark, d)
    both = frequency.slct(lines, 150, 20).select("template").unionByName(frequency.va(lines, "static", 3000).select("template")).distinct()
    return both.withColumn("template_id", template_text("template"))


def remove_sub_tpls(spark: SparkSession, d: str) -> DataFrame:
    return match.remove_covered(_all_templates(spark, d)).select(template_text("template").alias("template"))


def template_scores(spark: SparkSession, d: str) -> DataFrame:
    t = match.templates_to_lines(src.event_lines(spark, d), _slct_templates(spark, d))
    return t.select(template_text("template").alias("template"), F.round(specificity("template"), 6).alias("specificity"), F.col("n_lines").cast("long").alias("frequency"))


def term_pairs(spark: SparkSession, d: str) -> DataFrame:
    return search.term_pairs(src.event_lines(spark, d))


def logsig_signature(spark: SparkSession, d: str) -> DataFrame:
    lines = src.event_lines(spark, d)
    s = search.group_signatures(lines, F.get(F.split("line", " "), F.lit(2)))
    return s.select("grp", template_text("template").alias("template"))


def running_char_counts(spark: SparkSession, d: str) -> DataFrame:
    return bucketed.running_counts(src.conversation_lines(spark, d), "char").where("freq > 0")


def sorted_words(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier line's tokens by falling (running count, word)."""
    c = bucketed.running_counts(src.supplier_lines(spark, d), "word")
    x = F.sort_array(F.collect_list(F.struct("freq", "word")), asc=False)
    return c.groupBy("line_id").agg(F.array_join(F.transform(x, lambda e: e["word"]), " ").alias("words"))


def gap_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = tokenized(src.event_lines(spark, d))
    g = lke.gap_statistics(rows, ["user", "props"], F.get("tokens", F.lit(2)))
    return g.select("grp", "slot", "distinct", F.round("entropy", 6).alias("entropy"))


def line_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mismatch ratio and length cosine of each supplier line against its predecessor."""
    t = tokenized(src.supplier_lines(spark, d)).where(F.size("tokens") == 6)
    a = t.select((F.col("line_id") + 1).alias("line_id"), F.col("tokens").alias("before"))
    both = t.join(a, "line_id")
    return both.select("line_id", F.round(mismatch_ratio("tokens", "before"), 6).alias("mismatch"), F.round(length_cosine("tokens", "before"), 6).alias("cosine"))


def char_class_vectors(spark: SparkSession, d: str) -> DataFrame:
    words = frequency.word_counts(tokenized(src.supplier_lines(spark, d)))
    v = words.select("word", char_classes("word").alias("v"))
    return v.select("word", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("upper", "lower", "digit", "other"))))


def drain_match(spark: SparkSession, d: str) -> DataFrame:
    lines = src.event_lines(spark, d)
    return drain.drain_lookup(lines, drain.drain(lines)).groupBy("first_line_id").agg(F.count("*").alias("n_lines"))


def _stream(make: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = f"{d}/events.parque[t]"  # a pattern: a stream source takes no single file
        schema = src.read_table(spark, d, "events").schema
        e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
        line = F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), "event_type", F.lit("props"), "props")
        shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        events = make(e.select(F.col("event_id").alias("line_id"), line.alias("line")))
        return _shown(online.final_templates(online.run_available(events, f"{shared}/stream-{uuid.uuid4().hex}")))

    return run


QUERIES: dict[str, Query] = {
    "slct": _mined(frequency.slct, wp_supp=150, tpl_supp=20),
    "slct_documents": _mined(frequency.slct, src.document_lines, wp_supp=3, tpl_supp=1),
    "lfa": _mined(frequency.lfa),
    "lfa_documents": _mined(frequency.lfa, src.document_lines),
    "va_static": _mined(frequency.va, method="static", threshold=150),
    "va_relative_line": _mined(frequency.va, method="relative-line", threshold=0.15),
    "va_relative_variable": _mined(frequency.va, method="relative-variable", threshold=0.5),
    "logcluster": _mined(frequency.logcluster, freq_bar=500),
    "logcluster_patterns": logcluster_patterns,
    "iplom": _mined(iplom.iplom),
    "iplom_stage1": iplom_stage1,
    "iplom_stage2": iplom_stage2,
    "iplom_stage3": iplom_stage3,
    "tokenize": tokenize,
    "line_lengths": line_lengths,
    "distinct_lines_topn": distinct_lines_topn,
    "word_freq": word_freq,
    "pos_word_freq": pos_word_freq,
    "column_cardinality": column_cardinality,
    "match_tpl2logs": match_tpl2logs,
    "match_log2tpls": match_log2tpls,
    "missed_logs": missed_logs,
    "missed_tpls": missed_tpls,
    "template_cover_pairs": template_cover_pairs,
    "remove_sub_tpls": remove_sub_tpls,
    "template_scores": template_scores,
    "term_pairs": term_pairs,
    "logsig_signature": logsig_signature,
    "running_char_counts": running_char_counts,
    "sorted_words": sorted_words,
    "gap_entropy": gap_entropy,
    "line_scores": line_scores,
    "char_class_vectors": char_class_vectors,
    "ael": _mined(bucketed.ael),
    "dlog": _mined(bucketed.dlog),
    "ael_suppliers": _mined(bucketed.ael, src.supplier_lines, merge_pct=0.4),
    "drain": _mined(drain.drain),
    "drain_strict": _mined(drain.drain, sim_th=0.6),
    "drain_suppliers": _mined(drain.drain, src.supplier_lines, sim_th=0.7),
    "drain_match": drain_match,
    "fttree": _mined(bucketed.fttree),
    "lenma": _mined(bucketed.lenma, threshold=0.99),
    "lenma_suppliers": _mined(bucketed.lenma, src.supplier_lines, threshold=0.99),
    "spell": _mined(ordered.spell),
    "shiso": _mined(ordered.shiso, threshold=0.8, max_child=4),
    "logmine": _mined(ordered.logmine, max_dist=0.4, level=2),
    "logsig": _mined(search.logsig, src.supplier_lines, grp_num=8),
    "lke": _mined(lke.lke, src.supplier_lines, split_threshold=3.0),
    "molfi": _mined(search.molfi, src.nation_lines),
    "nulog": _mined(neural.nulog, src.supplier_lines, k=8, nr_epochs=8),
    "drain_stream": _stream(online.drain_stream),
    "fttree_stream": _stream(online.fttree_stream),
    "lenma_stream": _stream(lambda lines: online.lenma_stream(lines, 0.99)),
    "spell_stream": _stream(online.spell_stream),
    "shiso_stream": _stream(lambda lines: online.shiso_stream(lines, 0.8, 4)),
}
