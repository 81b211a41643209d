"""Templates against lines: which match, which lines and templates are missed.

The join is not a theta join over all pairs of a length. Templates with the same length and the same constant positions share
a *mask*; per line and mask of its length, the line's tokens at the constant positions form a key, and that key is
hash-joined with the templates'. The masks are few; they are broadcast after a check of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import covers, matches, tokenized

#: Beyond so many masks the join falls back to the lengths as key and the predicate.
MASKS = 10_000


def _mask(template: str) -> Column:
    return F.transform(template, lambda t: t.isNotNull())


def match_pairs(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(line_id, tokens, template_id, template) of every match; ``templates`` has template_id and template."""
    return _mask_join(tokenized(lines), templates, matches)


def _mask_join(rows: DataFrame, templates: DataFrame, holds: Callable[[str, str], Column]) -> DataFrame:
    """``rows`` (with an array ``tokens``, which may have wildcards itself) with the template_id and template that cover it.

    A wildcard of a row never equals a constant of a template, as its key is null where the template's is not.
    """
    masks = templates.select(F.size("template").alias("n"), _mask("template").alias("mask")).distinct()
    side = templates.select("template_id", "template")
    if masks.count() > MASKS:
        return rows.join(side, (F.size("tokens") == F.size("template")) & holds("tokens", "template")).select(*rows.columns, "template_id", "template")
    keyed = rows.join(F.broadcast(masks), F.size("tokens") == F.col("n"))
    keyed = keyed.withColumn("key", F.zip_with("tokens", "mask", lambda t, m: F.when(m, t)))
    # Arrays with null elements compare by value, so the key equals exactly the templates of this mask that match. The
    # number of wildcards rules out that a row's own wildcard stands for a constant.
    same = (keyed["key"] == side["template"]) & (F.size(F.filter("key", lambda t: t.isNull())) == F.size(F.filter("mask", lambda m: ~m)))
    return keyed.join(side, same).select(*rows.columns, "template_id", "template")


def templates_to_lines(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Each distinct template with the number and first of its lines (multiplicity counts)."""
    hits = match_pairs(lines, templates).select("template", "line_id").distinct()
    counts = hits.groupBy("template").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line_id"))
    every = templates.select("template").distinct()
    return every.join(counts, "template", "left").select("template", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "first_line_id")


def template_line_lists(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Each distinct template with the token lists of its lines in line order; for results that are known to be small."""
    hits = match_pairs(lines, templates).select("template", "line_id", "tokens").distinct()
    lists = hits.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("line_id", "tokens"))).alias("x"))
    lists = lists.select("template", F.transform("x", lambda e: e["tokens"]).alias("lines"))
    return templates.select("template").distinct().join(lists, "template", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<array<string>>")))


def lines_to_templates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Each distinct token list with its matching templates in template order (repeated templates stay)."""
    distinct = lines.groupBy("line").agg(F.min("line_id").alias("line_id"))
    hits = match_pairs(distinct, templates)
    lists = hits.groupBy("tokens").agg(F.sort_array(F.collect_set(F.struct("template_id", "template"))).alias("x"))
    lists = lists.select("tokens", F.transform("x", lambda e: e["template"]).alias("templates"))
    every = tokenized(distinct).select("tokens").distinct()
    return every.join(lists, "tokens", "left").withColumn("templates", F.coalesce("templates", F.array().cast("array<array<string>>")))


def missed_lines(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """line_id, line of the lines that no template matches."""
    return lines.join(match_pairs(lines, templates).select("line_id").distinct(), "line_id", "left_anti")


def missed_templates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """The templates that match no line."""
    return templates.join(match_pairs(lines, templates).select("template_id").distinct(), "template_id", "left_anti")


def cover_pairs(templates: DataFrame) -> DataFrame:
    """(parent, child) ids of templates of which the first matches all that the second does."""
    rows = templates.select(F.col("template_id").alias("child_id"), F.col("template").alias("tokens"))
    pairs = _mask_join(rows, templates, lambda child, parent: covers(parent, child)).where(F.col("template_id") != F.col("child_id"))
    return pairs.select(F.col("template_id").alias("parent_id"), "child_id", F.col("template").alias("parent"), F.col("tokens").alias("child"))


def remove_covered(templates: DataFrame) -> DataFrame:
    """The templates that no other one covers (equal templates cover each other, so distinct ones are expected)."""
    return templates.join(cover_pairs(templates).select(F.col("child_id").alias("template_id")).distinct(), "template_id", "left_anti")
