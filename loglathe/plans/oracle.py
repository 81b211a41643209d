"""DuckDB SQL for the registered queries that SQL can express, written apart from the DataFrame plans."""

from __future__ import annotations

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"

_EVENTS = "lines AS (SELECT event_id AS line_id, 'user ' || user_id || ' ' || event_type || ' props ' || props AS line FROM events)"
_DOCUMENTS = (
    "parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),"
    " lines AS (SELECT doc_id * (SELECT max(len(l)) FROM parts) + i - 1 AS line_id, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM parts))"
)
_SUPPLIERS = (
    "lines AS (SELECT s_suppkey AS line_id, 'supplier ' || s_name || ' of ' || n_name || ' account ' || CASE WHEN s_acctbal < 0 THEN 'debit' ELSE 'credit' END AS line"
    " FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)
_TURNS = "lines AS (SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS line_id, replace(text, chr(10), ' ') AS line FROM conversations)"
_TOKENS = (
    f"tok AS (SELECT line_id, list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '') AS tokens FROM lines),"
    " ex AS (SELECT line_id, unnest(tokens) AS word, CAST(unnest(range(len(tokens))) AS INTEGER) AS pos FROM tok)"
)
_WORDS = "words AS (SELECT word, count(*) AS n FROM ex GROUP BY word)"
_PLACED = "placed AS (SELECT pos, word, count(*) AS n FROM ex GROUP BY pos, word)"


def _with(source: str, *more: str) -> str:
    return "WITH " + ", ".join((source, _TOKENS, *more)) + " "


def _masked(name: str, kept: str, on: str) -> str:
    """line_id, template: tokens that ``kept`` has, else the wildcard's text; empty lines are the empty template."""
    return (
        f"{name} AS (SELECT line_id, list(CASE WHEN k.word IS NULL THEN '<*>' ELSE ex.word END ORDER BY ex.pos) AS template"
        f" FROM ex LEFT JOIN ({kept}) k USING ({on}) GROUP BY line_id"
        " UNION ALL SELECT line_id, CAST([] AS VARCHAR[]) FROM tok WHERE len(tokens) = 0)"
    )


def _shown(name: str, having: str = "") -> str:
    return (
        "SELECT array_to_string(template, ' ') AS template, CAST(len(template) AS INTEGER) AS n_tokens, count(*) AS n_lines, min(line_id) AS first_line_id"
        f" FROM {name} GROUP BY template {having}"
    )


def _slct(source: str, words: int, lines: int) -> str:
    return _with(source, _PLACED, _masked("t", f"SELECT pos, word FROM placed WHERE n > {words}", "pos, word")) + _shown("t", f"HAVING count(*) > {lines}")


def _lfa(source: str) -> str:
    return (
        _with(
            source,
            _PLACED,
            "j AS (SELECT line_id, list(word ORDER BY pos) AS ws, list(n ORDER BY pos) AS ns, list_sort(list(n)) AS s FROM ex JOIN placed USING (pos, word) GROUP BY line_id)",
            "g AS (SELECT *, list_transform(range(1, len(s)), lambda i: s[i + 1] - s[i]) AS gaps FROM j)",
            "h AS (SELECT *, s[list_position(gaps, list_max(gaps))] AS edge FROM g)",
            "t AS (SELECT line_id, CASE WHEN len(ws) < 2 OR list_max(gaps) = 0 THEN ws"
            " ELSE list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN ns[i] > edge THEN ws[i] ELSE '<*>' END) END AS template FROM h"
            " UNION ALL SELECT line_id, CAST([] AS VARCHAR[]) FROM tok WHERE len(tokens) = 0)",
        )
        + _shown("t")
    )


_SLCT_TABLE = (
    _PLACED,
    "pw AS (SELECT pos, word FROM placed WHERE n > 150)",
    "m AS (SELECT line_id, list(pw.word ORDER BY ex.pos) AS template FROM ex LEFT JOIN pw USING (pos, word) GROUP BY line_id)",
    "tpl AS (SELECT template, min(line_id) AS template_id, count(*) AS n FROM m GROUP BY template HAVING count(*) > 20)",
)
_MATCH = "len(tokens) = len(template) AND len(list_filter(range(1, len(tokens) + 1), lambda i: template[i] IS NOT NULL AND template[i] <> tokens[i])) = 0"
_TEXT = "array_to_string(list_transform(template, lambda x: coalesce(x, '<*>')), ' ')"
_HITS = f"hits AS (SELECT line_id, tokens, template_id, template FROM tok JOIN tpl ON {_MATCH})"

_ALL_TABLE = (
    *_SLCT_TABLE,
    _WORDS,
    "vm AS (SELECT line_id, list(CASE WHEN w.n > 3000 THEN ex.word END ORDER BY ex.pos) AS template FROM ex JOIN words w USING (word) GROUP BY line_id)",
    f"every AS (SELECT DISTINCT template, {_TEXT} AS text FROM (SELECT template FROM tpl UNION ALL SELECT template FROM vm))",
    "covers AS (SELECT p.text AS parent, c.text AS child FROM every p JOIN every c ON len(p.template) = len(c.template) AND p.text <> c.text"
    " AND len(list_filter(range(1, len(p.template) + 1), lambda i: p.template[i] IS NOT NULL AND p.template[i] IS DISTINCT FROM c.template[i])) = 0)",
)

_PATTERNS = _with(
    _EVENTS,
    _WORDS,
    "x AS (SELECT line_id, pos, word, n >= 500 AS keep FROM ex JOIN words USING (word))",
    "keys AS (SELECT line_id, coalesce(list(word ORDER BY pos) FILTER (keep), []) AS key FROM x GROUP BY line_id)",
    "runs AS (SELECT line_id, keep, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY pos) AS slot FROM x)",
    "lens AS (SELECT line_id, slot, count(*) AS gap FROM runs WHERE NOT keep GROUP BY line_id, slot)",
    "slots AS (SELECT line_id, key, unnest(range(len(key) + 1)) AS slot FROM keys)",
    "full_ AS (SELECT key, slot, coalesce(gap, 0) AS gap FROM slots LEFT JOIN lens USING (line_id, slot))",
    "ranges AS (SELECT key, slot, min(gap) AS lo, max(gap) AS hi FROM full_ WHERE slot < len(key) OR gap > 0 GROUP BY key, slot HAVING max(gap) > 0)",
    "cells AS (SELECT key, 2 * slot AS o, CASE WHEN lo = hi THEN '[' || hi || ']' ELSE '[' || lo || ',' || hi || ']' END AS cell FROM ranges"
    " UNION ALL SELECT key, 2 * i - 1, key[i] FROM (SELECT DISTINCT key, unnest(range(1, len(key) + 1)) AS i FROM keys))",
    "shown AS (SELECT key, string_agg(cell, ' ' ORDER BY o) AS pattern FROM cells GROUP BY key)",
    "heads AS (SELECT key, count(*) AS n_lines, min(line_id) AS first_line_id FROM keys GROUP BY key)",
) + "SELECT coalesce(pattern, '') AS pattern, n_lines, first_line_id FROM heads LEFT JOIN shown USING (key)"

_IPLOM2 = (
    "s1 AS (SELECT line_id, tokens, CAST(len(tokens) AS INTEGER) AS n FROM tok)",
    "c1 AS (SELECT n, pos, count(DISTINCT word) AS d FROM ex JOIN s1 USING (line_id) GROUP BY n, pos)",
    "z1 AS (SELECT n, count(*) AS size FROM s1 GROUP BY n)",
    "cut AS (SELECT n, CASE WHEN size > 1 THEN arg_min(pos, d * 100000 + pos) END AS split_pos FROM c1 JOIN z1 USING (n) GROUP BY n, size)",
    "s2 AS (SELECT line_id, tokens, n, split_pos, tokens[split_pos + 1] AS p2 FROM s1 LEFT JOIN cut USING (n))",
)
_IPLOM3 = (
    *_IPLOM2,
    "c2 AS (SELECT s2.n, p2, pos, count(DISTINCT word) AS d FROM ex JOIN s2 USING (line_id) GROUP BY s2.n, p2, pos)",
    "z2 AS (SELECT n, p2, count(*) AS size FROM s2 GROUP BY n, p2)",
    "mv AS (SELECT c2.n, c2.p2, pos, d FROM c2 JOIN z2 ON c2.n = z2.n AND c2.p2 IS NOT DISTINCT FROM z2.p2 WHERE d <> 1 AND size > 1)",
    "sh AS (SELECT *, count(*) OVER (PARTITION BY n, p2, d) AS c, min(pos) OVER (PARTITION BY n, p2, d) AS f FROM mv)",
    "rk AS (SELECT *, max(c) OVER (PARTITION BY n, p2) AS top, row_number() OVER (PARTITION BY n, p2 ORDER BY c DESC, f, pos) AS by_share,"
    " row_number() OVER (PARTITION BY n, p2 ORDER BY d, pos) AS by_size, count(*) OVER (PARTITION BY n, p2) AS moving FROM sh)",
    "two AS (SELECT n, p2, list(pos ORDER BY CASE WHEN top >= 2 THEN by_share ELSE by_size END) FILTER ((top >= 2 AND by_share <= 2) OR (top < 2 AND by_size <= 2)) AS pp"
    " FROM rk WHERE moving >= 2 GROUP BY n, p2)",
    "lr AS (SELECT s2.*, tokens[pp[1] + 1] AS l, tokens[pp[2] + 1] AS r FROM s2 LEFT JOIN two ON s2.n = two.n AND s2.p2 IS NOT DISTINCT FROM two.p2)",
    "pairs AS (SELECT n, p2, l, r, count(*) AS c FROM lr WHERE l IS NOT NULL GROUP BY n, p2, l, r)",
    "dg AS (SELECT *, count(*) OVER (PARTITION BY n, p2, l) AS dl, count(*) OVER (PARTITION BY n, p2, r) AS dr,"
    " sum(c) OVER (PARTITION BY n, p2, l) AS lc, sum(c) OVER (PARTITION BY n, p2, r) AS rc FROM pairs)",
    "kd AS (SELECT *, CASE WHEN dl = 1 AND dr = 1 THEN '1-1' WHEN dl > 1 AND max(dr) OVER (PARTITION BY n, p2, l) = 1 THEN '1-M'"
    " WHEN dr > 1 AND max(dl) OVER (PARTITION BY n, p2, r) = 1 THEN 'M-1' ELSE 'M-M' END AS kind FROM dg)",
    "mm AS (SELECT n, p2, count(DISTINCT l) AS ml, count(DISTINCT r) AS mr FROM kd WHERE kind = 'M-M' GROUP BY n, p2)",
    "p3 AS (SELECT kd.*, CASE kind WHEN '1-1' THEN 'l' || l || ' r' || r WHEN '1-M' THEN CASE WHEN dl / lc <= 0.3 THEN 'l' || l || ' r' || r ELSE 'l' || l END"
    " WHEN 'M-1' THEN CASE WHEN dr / rc <= 0.3 THEN 'r' || r ELSE 'l' || l || ' r' || r END ELSE CASE WHEN ml <= mr THEN 'l' || l ELSE 'r' || r END END AS part"
    " FROM kd LEFT JOIN mm ON kd.n = mm.n AND kd.p2 IS NOT DISTINCT FROM mm.p2)",
    "s3 AS (SELECT lr.line_id, lr.tokens, lr.n, lr.p2, coalesce(kind, 'one') AS kind, coalesce(part, '') AS part FROM lr"
    " LEFT JOIN p3 ON lr.n = p3.n AND lr.p2 IS NOT DISTINCT FROM p3.p2 AND lr.l = p3.l AND lr.r = p3.r)",
)
_CHARS = (
    "single AS (SELECT DISTINCT word FROM ex WHERE len(word) = 1)",
    "units AS (SELECT line_id, unnest(string_split(line, '')) AS word FROM lines)",
)

_ORDERED = "ord AS (SELECT row_number() OVER (ORDER BY line_id) AS k, line_id, tokens AS t, len(tokens) AS n FROM tok)"


def _recursive(source: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join((source, _TOKENS, _ORDERED, *more)) + " "


def _online(fields: str, about: str, found: str, started: str, changed: str) -> str:
    """One line after the other: ``v.cl`` are the clusters so far, ``best`` the number of the one that takes the line ``v.t``."""
    none = f"CAST([] AS STRUCT({fields})[])"
    line = "'id': {0}.id, 't': {0}.t, 'n': {0}.n"
    step = f"CASE WHEN best IS NULL THEN list_append(v.cl, {started}) ELSE list_transform(range(1, len(v.cl) + 1), lambda i: CASE WHEN i = best THEN {changed} ELSE v.cl[i] END) END"
    return (
        f"r AS (SELECT list_reduce(list({{'id': line_id, 't': t, 'n': n, 'cl': {none}}} ORDER BY k), lambda a, x:"
        f" list_transform([{{'cl': a.cl, {line.format('x')}, {about}}}], lambda v: list_transform([{found}], lambda best: {{{line.format('v')}, 'cl': {step}}})[1])[1],"
        f" {{'id': CAST(0 AS BIGINT), 't': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT), 'cl': {none}}}).cl AS cl FROM ord),"
        " clusters AS (SELECT unnest(cl, recursive := true) FROM r)"
    )


_CLUSTERS = (
    "SELECT array_to_string(list_transform(tpl, lambda x: coalesce(x, '<*>')), ' ') AS template, CAST(len(tpl) AS INTEGER) AS n_tokens, hits AS n_lines, founder AS first_line_id FROM clusters"
)
_MERGED = "list_transform(range(1, v.n + 1), lambda j: CASE WHEN v.cl[i].tpl[j] = v.t[j] THEN v.t[j] END)"
_EQUAL = "len(list_filter(range(1, v.n + 1), lambda j: v.cl[i].tpl[j] = v.t[j]))"
_SAME_LENGTH = "list_filter(range(1, len(v.cl) + 1), lambda i: len(v.cl[i].tpl) = v.n)"
#: Depth 4: the first token (of two or more) leads to a leaf; at most 100 children, one of them the wildcard.
def _drain(source: str, need: float) -> str:
    kids = "list_distinct(list_transform(list_filter(a.cl, lambda c: len(c.tpl) = x.n), lambda c: c.leaf))"
    scores = f"{{'s': CASE WHEN v.n = 0 THEN 1.0 ELSE {_EQUAL} / v.n END, 'g': len(list_filter(v.cl[i].tpl, lambda y: y IS NULL)), 'i': -i}}"
    here = f"list_filter({_SAME_LENGTH}, lambda i: v.cl[i].leaf = CASE WHEN list_contains(v.kids, v.head) THEN v.head ELSE '<*>' END)"
    return _recursive(
        source,
        _online(
            "leaf VARCHAR, tpl VARCHAR[], hits BIGINT, founder BIGINT",
            f"'head': CASE WHEN x.n > 1 THEN x.t[1] ELSE '' END, 'kids': {kids}",
            f"-(list_reverse_sort(list_filter(list_transform({here}, lambda i: {scores}), lambda c: c.s >= {need}))[1]).i",
            "{'leaf': CASE WHEN list_contains(v.kids, v.head) OR len(v.kids) < CASE WHEN list_contains(v.kids, '<*>') THEN 100 ELSE 99 END THEN v.head ELSE '<*>' END,"
            " 'tpl': v.t, 'hits': CAST(1 AS BIGINT), 'founder': v.id}",
            f"{{'leaf': v.cl[i].leaf, 'tpl': {_MERGED}, 'hits': v.cl[i].hits + 1, 'founder': v.cl[i].founder}}",
        ),
    )


_DOT = "list_sum(list_transform(range(1, v.n + 1), lambda j: {0}[j] * {1}[j]))"


def _lenma(source: str) -> str:
    cosine = f"{_DOT.format('v.own', 'v.cl[i].lens')} / (sqrt({_DOT.format('v.own', 'v.own')}) * sqrt({_DOT.format('v.cl[i].lens', 'v.cl[i].lens')}))"
    scores = f"{{'s': CASE WHEN len(list_filter(range(1, v.n + 1), lambda j: v.cl[i].tpl[j] <> v.t[j])) = 0 THEN 1.0 ELSE {cosine} END, 'i': -i}}"
    return _recursive(
        source,
        _online(
            "tpl VARCHAR[], lens BIGINT[], hits BIGINT, founder BIGINT",
            "'own': list_transform(x.t, lambda y: len(y))",
            f"-(list_reverse_sort(list_filter(list_transform({_SAME_LENGTH}, lambda i: {scores}), lambda c: c.s >= 0.99))[1]).i",
            "{'tpl': v.t, 'lens': v.own, 'hits': CAST(1 AS BIGINT), 'founder': v.id}",
            f"{{'tpl': {_MERGED}, 'lens': v.own, 'hits': v.cl[i].hits + 1, 'founder': v.cl[i].founder}}",
        ),
    )


#: A leader at a time, per token count, over the lines that are still free; at most ``share`` of the positions differ, from three lines on.
def _ael(source: str, share: float) -> str:
    return (
        _recursive(
            source,
            "r AS (SELECT n, count(*) AS m, list({'id': line_id, 't': t} ORDER BY line_id) AS free, CAST(NULL AS STRUCT(id BIGINT, t VARCHAR[])) AS head,"
            " CAST([] AS STRUCT(id BIGINT, t VARCHAR[])[]) AS grp FROM ord GROUP BY n UNION ALL"
            " SELECT n, m, list_filter(rest, lambda x: NOT list_contains(list_transform(taken, lambda y: y.id), x.id)), lead, taken FROM (SELECT *, CASE WHEN m < 3 THEN [] ELSE"
            f" list_filter(rest, lambda x: x.t <> lead.t AND len(list_filter(range(1, n + 1), lambda j: x.t[j] <> lead.t[j])) / n <= {share}) END AS taken"
            " FROM (SELECT n, m, free[1] AS lead, free[2:] AS rest FROM r WHERE len(free) > 0)))",
            "g AS (SELECT head.id AS id, 1 + len(grp) AS size, list_transform(range(1, n + 1), lambda j: CASE WHEN len(list_filter(grp, lambda x: x.t[j] <> head.t[j])) = 0 THEN head.t[j] ELSE '<*>' END) AS tpl"
            " FROM r WHERE head IS NOT NULL)",
        )
        + "SELECT array_to_string(tpl, ' ') AS template, CAST(len(tpl) AS INTEGER) AS n_tokens, CAST(sum(size) AS BIGINT) AS n_lines, min(id) AS first_line_id FROM g GROUP BY tpl"
    )


ORACLE_SQL: dict[str, str] = {
    "slct": _slct(_EVENTS, 150, 20),
    "slct_documents": _slct(_DOCUMENTS, 3, 1),
    "lfa": _lfa(_EVENTS),
    "lfa_documents": _lfa(_DOCUMENTS),
    "va_static": _with(_EVENTS, _WORDS, _masked("t", "SELECT word FROM words WHERE n > 150", "word")) + _shown("t"),
    "va_relative_line": _with(_EVENTS, _WORDS, _masked("t", "SELECT word FROM words WHERE n / (SELECT count(*) FROM lines) > 0.15", "word")) + _shown("t"),
    "va_relative_variable": _with(
        _EVENTS,
        _WORDS,
        "r AS (SELECT line_id, list({'n': n, 'pos': pos, 'word': word} ORDER BY n, pos) AS o, list(word ORDER BY pos) AS ws FROM ex JOIN words USING (word) GROUP BY line_id)",
        "k AS (SELECT line_id, ws, list_transform(o[CAST(floor(len(o) * 0.5) AS BIGINT) + 1 :], lambda e: e.word) AS kept FROM r)",
        "t AS (SELECT line_id, list_transform(ws, lambda w: CASE WHEN list_contains(kept, w) THEN w ELSE '<*>' END) AS template FROM k)",
    )
    + _shown("t"),
    "logcluster": _with(_EVENTS, _WORDS, _masked("t", "SELECT word FROM words WHERE n >= 500", "word")) + _shown("t"),
    "logcluster_patterns": _PATTERNS,
    "iplom_stage1": _with(_DOCUMENTS) + "SELECT CAST(len(tokens) AS INTEGER) AS n, count(*) AS n_lines FROM tok GROUP BY 1",
    "iplom_stage2": _with(_EVENTS, *_IPLOM2) + "SELECT n, split_pos, p2, count(*) AS n_lines FROM s2 GROUP BY n, split_pos, p2",
    "iplom_stage3": _with(_EVENTS, *_IPLOM3) + "SELECT n, p2, kind, count(*) AS n_lines, count(DISTINCT part) AS n_parts FROM s3 GROUP BY n, p2, kind",
    "iplom": _with(
        _EVENTS,
        *_IPLOM3,
        "cells AS (SELECT s3.n, p2, kind, part, pos, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS cell, count(*) AS c, min(line_id) AS f"
        " FROM ex JOIN s3 USING (line_id) GROUP BY s3.n, p2, kind, part, pos)",
        "parts_ AS (SELECT list(cell ORDER BY pos) AS template, max(c) AS c, min(f) AS f FROM cells GROUP BY n, p2, kind, part)",
    )
    + "SELECT array_to_string(template, ' ') AS template, CAST(len(template) AS INTEGER) AS n_tokens, CAST(sum(c) AS BIGINT) AS n_lines, min(f) AS first_line_id FROM parts_ GROUP BY template",
    "tokenize": _with(_DOCUMENTS) + "SELECT line_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, '|') AS tokens FROM tok",
    "line_lengths": _with(_DOCUMENTS) + "SELECT CAST(len(tokens) AS INTEGER) AS n_tokens, count(*) AS n FROM tok GROUP BY 1",
    "distinct_lines_topn": f"WITH {_TURNS} SELECT min(line_id) AS line_id, line FROM lines GROUP BY line ORDER BY 1 LIMIT 30",
    "word_freq": _with(_EVENTS, _WORDS) + "SELECT word, n FROM words",
    "pos_word_freq": _with(_EVENTS, _PLACED) + "SELECT pos, word, n FROM placed",
    "column_cardinality": _with(_EVENTS) + "SELECT pos, count(DISTINCT word) AS n_distinct FROM ex GROUP BY pos",
    "match_tpl2logs": _with(_EVENTS, *_SLCT_TABLE, _HITS, f"s AS (SELECT template, {_TEXT} AS t, CAST(len(template) AS INTEGER) AS n FROM tpl)")
    + "SELECT t AS template, s.n AS n_tokens, count(line_id) AS n_lines, min(line_id) AS first_line_id FROM s LEFT JOIN hits ON s.template = hits.template GROUP BY t, s.n",
    "match_log2tpls": _with(
        _EVENTS,
        *_SLCT_TABLE,
        _HITS,
        f"named AS (SELECT DISTINCT tokens, template_id, {_TEXT} AS t FROM hits)",
        "agg AS (SELECT tokens, count(*) AS n, string_agg(t, ' ; ' ORDER BY template_id) AS ts FROM named GROUP BY tokens)",
        "logs AS (SELECT DISTINCT tokens FROM tok)",
    )
    + "SELECT array_to_string(tokens, ' ') AS log, CAST(coalesce(n, 0) AS INTEGER) AS n_templates, coalesce(ts, '') AS templates FROM logs LEFT JOIN agg USING (tokens)",
    "missed_logs": _with(_EVENTS, *_SLCT_TABLE[:3], "tpl AS (SELECT template, min(line_id) AS template_id FROM m GROUP BY template HAVING count(*) > 2000)", _HITS)
    + "SELECT line_id, line FROM lines WHERE line_id NOT IN (SELECT line_id FROM hits)",
    "missed_tpls": _with(
        _EVENTS,
        *_SLCT_TABLE,
        f"turns AS (SELECT list_filter(regexp_split_to_array(replace(text, chr(10), ' '), '{_SPACE}'), lambda x: x <> '') AS tokens FROM conversations)",
    )
    + f"SELECT {_TEXT} AS template FROM tpl WHERE template_id NOT IN (SELECT template_id FROM tpl JOIN turns ON {_MATCH})",
    "template_cover_pairs": _with(_EVENTS, *_ALL_TABLE) + "SELECT parent, child FROM covers",
    "remove_sub_tpls": _with(_EVENTS, *_ALL_TABLE) + "SELECT text AS template FROM every WHERE text NOT IN (SELECT child FROM covers)",
    "template_scores": _with(_EVENTS, *_SLCT_TABLE, _HITS)
    + f"SELECT {_TEXT} AS template, round(len(list_filter(template, lambda x: x IS NOT NULL)) / len(template), 6) AS specificity,"
    " count(DISTINCT line_id) AS frequency FROM hits GROUP BY template",
    "term_pairs": _with(_EVENTS) + "SELECT a.word AS t1, b.word AS t2, count(*) AS n FROM ex a JOIN ex b ON a.line_id = b.line_id AND a.pos < b.pos GROUP BY 1, 2",
    "logsig_signature": _with(
        _EVENTS,
        "g AS (SELECT line_id, string_split(line, ' ')[3] AS grp FROM lines)",
        "half AS (SELECT grp, ceil(count(*) / 2) AS half FROM g GROUP BY grp)",
        "wd AS (SELECT grp, word FROM ex JOIN g USING (line_id) JOIN half USING (grp) GROUP BY grp, word, half HAVING count(*) >= half)",
        "sh AS (SELECT g.grp, line_id, string_agg(CASE WHEN wd.word IS NULL THEN '<*>' ELSE ex.word END, ' ' ORDER BY pos) AS template"
        " FROM ex JOIN g USING (line_id) LEFT JOIN wd ON wd.grp = g.grp AND wd.word = ex.word GROUP BY g.grp, line_id)",
        "ct AS (SELECT grp, template, count(*) AS n, min(line_id) AS f FROM sh GROUP BY grp, template)",
    )
    + "SELECT grp, template FROM ct QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) = 1",
    "running_char_counts": _with(
        _TURNS,
        *_CHARS,
        "per AS (SELECT word, line_id, count(*) AS c FROM units WHERE word IN (SELECT word FROM single) GROUP BY word, line_id)",
        "so AS (SELECT line_id, word, CAST(sum(c) OVER (PARTITION BY word ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freq FROM per)",
    )
    + "SELECT DISTINCT line_id, word, freq FROM ex JOIN so USING (line_id, word)",
    "sorted_words": _with(
        _SUPPLIERS,
        "per AS (SELECT word, line_id, count(*) AS c FROM ex GROUP BY word, line_id)",
        "so AS (SELECT line_id, word, sum(c) OVER (PARTITION BY word ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS freq FROM per)",
    )
    + "SELECT line_id, string_agg(word, ' ' ORDER BY freq DESC, word DESC) AS words FROM so GROUP BY line_id",
    "gap_entropy": _with(
        _EVENTS,
        "g AS (SELECT tokens[3] AS grp, 1 AS slot, array_to_string(tokens[2:3], ' ') AS gap FROM tok UNION ALL SELECT tokens[3], 2, array_to_string(tokens[5:], ' ') FROM tok"
        " UNION ALL SELECT tokens[3], 0, '' FROM tok)",
        "c AS (SELECT grp, slot, gap, count(*) AS n FROM g GROUP BY ALL)",
        "p AS (SELECT grp, slot, n / sum(n) OVER (PARTITION BY grp, slot) AS p FROM c)",
    )
    + "SELECT grp, CAST(slot AS INTEGER) AS slot, count(*) AS \"distinct\", round(-sum(p * ln(p)) / (ln(2) * ln(2)) + 0.0, 6) AS entropy FROM p GROUP BY grp, slot",
    "line_scores": _with(
        _SUPPLIERS,
        "t AS (SELECT line_id, tokens, list_transform(tokens, lambda w: len(w)) AS v FROM tok WHERE len(tokens) = 6)",
        "b AS (SELECT a.line_id, a.tokens AS x, b.tokens AS y, a.v AS p, b.v AS q FROM t a JOIN t b ON a.line_id = b.line_id + 1)",
    )
    + "SELECT line_id, round(len(list_filter(range(1, 7), lambda i: x[i] <> y[i])) / 6, 6) AS mismatch, round(list_cosine_similarity(CAST(p AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS cosine FROM b",
    "char_class_vectors": _with(_SUPPLIERS)
    + "SELECT word, CAST(len(regexp_replace(word, '[^A-Z]', '', 'g')) AS INTEGER) AS upper, CAST(len(regexp_replace(word, '[^a-z]', '', 'g')) AS INTEGER) AS lower,"
    " CAST(len(regexp_replace(word, '[^0-9]', '', 'g')) AS INTEGER) AS digit, CAST(len(regexp_replace(word, '[A-Za-z0-9]', '', 'g')) AS INTEGER) AS other FROM (SELECT DISTINCT word FROM ex)",
    "ael": _ael(_EVENTS, 0.5),
    "ael_suppliers": _ael(_SUPPLIERS, 0.4),
    "drain": _drain(_EVENTS, 0.4) + _CLUSTERS,
    "drain_strict": _drain(_EVENTS, 0.6) + _CLUSTERS,
    "drain_suppliers": _drain(_SUPPLIERS, 0.7) + _CLUSTERS,
    "drain_stream": _drain(_EVENTS, 0.4) + _CLUSTERS,
    "drain_match": _drain(_EVENTS, 0.4)
    + "SELECT founder AS first_line_id, count(*) AS n_lines FROM (SELECT line_id, founder FROM tok JOIN clusters"
    " ON len(tokens) = len(tpl) AND len(list_filter(range(1, len(tpl) + 1), lambda j: tpl[j] <> tokens[j])) = 0"
    " QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY len(list_filter(tpl, lambda x: x IS NULL)) DESC, founder) = 1) GROUP BY founder",
    "lenma": _lenma(_EVENTS) + _CLUSTERS,
    "lenma_suppliers": _lenma(_SUPPLIERS) + _CLUSTERS,
    "lenma_stream": _lenma(_EVENTS) + _CLUSTERS,
}
