"""Column expressions over lines, tokens and templates (arrays with null wildcards)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"
#: Unicode white space plus the four separators that Python's str.split also splits on.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def tokenize(line: str | Column) -> Column:
    """The white-space separated tokens of a line, as Python's ``str.split()`` gives them; null is an empty line."""
    c = F.col(line) if isinstance(line, str) else line
    return F.filter(F.split(F.coalesce(c, F.lit("")), _SPACE), lambda t: t != "")


def tokenize_delimited(line: str | Column, delimiters: list[str]) -> Column:
    """As :func:`tokenize`, each of the literal delimiters first replaced by a blank, in list order."""
    c = F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit(""))
    for d in delimiters:
        c = F.replace(c, F.lit(d), F.lit(" "))
    return tokenize(c)


def template_text(template: str | Column) -> Column:
    """A template as text, wildcards as ``<*>``."""
    c = F.col(template) if isinstance(template, str) else template
    return F.array_join(F.transform(c, lambda t: F.coalesce(t, F.lit(WILDCARD))), " ")


def matches(tokens: str | Column, template: str | Column) -> Column:
    """Equal length, and equal at every position that is not a wildcard."""
    a, t = (F.col(c) if isinstance(c, str) else c for c in (tokens, template))
    return (F.size(a) == F.size(t)) & F.forall(F.zip_with(a, t, lambda x, y: y.isNull() | (x == y)), lambda ok: ok)


def covers(parent: str | Column, child: str | Column) -> Column:
    """The parent template matches whatever the child does: equal length, wildcard or equal at each position."""
    p, c = (F.col(x) if isinstance(x, str) else x for x in (parent, child))
    return (F.size(p) == F.size(c)) & F.forall(F.zip_with(p, c, lambda x, y: x.isNull() | x.eqNullSafe(y)), lambda ok: ok)


def merge(a: str | Column, b: str | Column) -> Column:
    """Position by position: the token where both agree, else a wildcard."""
    return F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), x))


def specificity(template: str | Column) -> Column:
    """The share of constant positions (0 for the empty template)."""
    c = F.col(template) if isinstance(template, str) else template
    return F.when(F.size(c) > 0, F.size(F.filter(c, lambda t: t.isNotNull())) / F.size(c)).otherwise(F.lit(0.0))


def mismatch_ratio(a: str | Column, b: str | Column) -> Column:
    """The share of positions that differ, of two token arrays of one length."""
    wrong = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: ~same))
    return wrong / F.size(a)


def length_cosine(a: str | Column, b: str | Column) -> Column:
    """The cosine of two lines' word-length vectors."""
    x, y = (F.transform(c, lambda w: F.length(w)) for c in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda acc, e: acc + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return dot / (F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e))))


def char_classes(word: str | Column) -> Column:
    """Counts of upper-case, lower-case, digit and other characters of a word."""
    w = F.col(word) if isinstance(word, str) else word
    count = lambda p: F.regexp_count(w, F.lit(p))
    upper, lower, digit = count("[A-Z]"), count("[a-z]"), count("[0-9]")
    return F.array(upper, lower, digit, F.length(w) - upper - lower - digit)


def ordered_pairs(tokens: str | Column) -> Column:
    """All (earlier, later) token pairs of a line with multiplicity."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    rest = lambda i: F.slice(c, i + 2, F.size(c))
    return F.flatten(F.transform(c, lambda t, i: F.transform(rest(i), lambda u: F.struct(t.alias("t1"), u.alias("t2")))))


def tokenized(lines: DataFrame) -> DataFrame:
    """line_id, tokens of ``lines`` (line_id, line)."""
    return lines.select("line_id", tokenize("line").alias("tokens"))


def first_seen(rows: DataFrame) -> DataFrame:
    """template, n_lines, first_line_id of rows (line_id, template): distinct templates, map-side combined."""
    return rows.groupBy("template").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line_id"))
