"""DuckDB SQL for those training-data queries that SQL can express: plain definitions, without the operators' shortcuts."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"

LINE_DEDUP = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i - 1 AS ln, list_distinct({_WORDS.format("l[i]")}) AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM parts)),
sets AS (SELECT doc_id, ln, list_sort(t) AS t, row_number() OVER (ORDER BY doc_id, ln) AS pos FROM lines WHERE len(t) > 0),
distinct_sets AS (SELECT t, min(pos) AS pos FROM sets GROUP BY t),
df AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM distinct_sets) GROUP BY w),
ranked AS (SELECT pos, w, len(t) AS n, row_number() OVER (PARTITION BY pos ORDER BY df.n, w) AS place FROM (SELECT pos, t, unnest(t) AS w FROM distinct_sets) JOIN df USING (w)),
prefix AS (SELECT pos, w, n FROM ranked WHERE place <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
near AS (SELECT DISTINCT x.pos AS a, y.pos AS b FROM prefix x JOIN prefix y ON x.w = y.w AND y.pos < x.pos AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
gone AS (SELECT DISTINCT a AS pos FROM near JOIN distinct_sets p ON p.pos = a JOIN distinct_sets q ON q.pos = b
  WHERE 9 * len(list_intersect(p.t, q.t)) >= 4 * (len(p.t) + len(q.t))),
kept AS (SELECT doc_id, ln FROM sets WHERE pos IN (SELECT pos FROM distinct_sets) AND pos NOT IN (SELECT pos FROM gone)),
lists AS (SELECT doc_id, count(*) AS k, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) AS kept_lines FROM kept GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) - coalesce(k, 0) AS INTEGER) AS n_removed, coalesce(kept_lines, '') AS kept_lines
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lists USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT id, b FROM reach JOIN links ON r = a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(max(n), 0) AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach LEFT JOIN counted ON id = a GROUP BY id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS o FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 5 * o >= 4 * (n + m - o)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT id, b FROM reach JOIN links ON r = a)
SELECT id AS doc_id, min(r) AS class_id, id = min(r) AS kept FROM reach GROUP BY id
"""

#: Fixed values of the method: window width, least plain words of a template window, units.
_WIDTH, _LITERAL = 8, 5
_UNITS = """
mm cm m km mg g kg t ml cl l s ms min h hz khz mhz ghz w kw mw v mv a ma j kj n pa kpa bar k c f b kb mb gb tb in ft yd mi oz lb percent euro euros
dollar dollars meter meters metre metres hour hours minute minutes second seconds day days week weeks month months year years
""".split()
_SLOTS = "('<num>', '<name>', '<unit>')"
_NUMBER = r"regexp_matches({0}, '^\p{{N}}')"
_CANON = (
    f"list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {_NUMBER.format('w[i]')} THEN '<num>'"
    f" WHEN i > 1 AND {_NUMBER.format('w[i - 1]')} AND list_contains([{', '.join(repr(u) for u in _UNITS)}], lower(w[i])) THEN '<unit>'"
    " WHEN lower(w[i]) <> w[i] AND len(w[i]) > 1 AND w[i][2:] = lower(w[i])[2:] THEN '<name>' ELSE lower(w[i]) END)"
)
_TOKENS = r"regexp_extract_all(coalesce(text, ''), '\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}]*')"
_KEY = "array_to_string(list_transform({0}[i : i + k - 1], lambda x: lower(x)), ' ')"

LEAKS = f"""
WITH items AS (SELECT DISTINCT item_id, {_TOKENS} AS w FROM benchmark),
it AS (SELECT item_id, w, {_CANON} AS t, least(len(w), {_WIDTH}) AS k FROM items WHERE len(w) > 0),
pl AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: t[i] NOT IN {_SLOTS}) AS p FROM it),
wide AS (SELECT item_id, w, t, greatest(k, coalesce(list_min(list_transform(range(1, len(p) - {_LITERAL} + 2), lambda i: p[i + {_LITERAL} - 1] - p[i] + 1)), len(w))) AS k FROM pl WHERE len(p) > 0 AND len(w) >= {_LITERAL}),
im AS (SELECT item_id, k, i AS place, w[i : i + k - 1] AS ww, t[i : i + k - 1] AS tt, false AS templ, {_KEY.format("w")} AS key FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM it)
  UNION ALL SELECT item_id, k, i, w[i : i + k - 1], t[i : i + k - 1] AS tt, true, array_to_string(t[i : i + k - 1], ' ') FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM wide)
    WHERE k = len(w) OR len(list_filter(t[i : i + k - 1], lambda x: x NOT IN {_SLOTS})) >= {_LITERAL}),
dw AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE doc_id IS NOT NULL),
dt AS (SELECT doc_id, w, {_CANON} AS t FROM dw),
dk AS (SELECT doc_id, w, t, k, unnest(range(1, len(w) - k + 2)) AS i FROM dt CROSS JOIN (SELECT DISTINCT k FROM im) WHERE len(w) >= k),
dm AS (SELECT doc_id, k, i, w[i : i + k - 1] AS ww, false AS templ, {_KEY.format("w")} AS key FROM dk
  UNION ALL SELECT doc_id, k, i, w[i : i + k - 1], true, array_to_string(t[i : i + k - 1], ' ') FROM dk),
hits AS (SELECT doc_id, item_id, dm.i - im.place AS shift, im.place, im.ww AS iw, dm.ww AS dw, im.tt, im.templ FROM dm JOIN im USING (key, k, templ)),
slots AS (SELECT doc_id, item_id, shift, tt[j] AS kind, lower(iw[j]) AS a, lower(dw[j]) AS b
  FROM (SELECT *, unnest(range(1, len(iw) + 1)) AS j FROM hits WHERE templ) WHERE tt[j] IN {_SLOTS}),
judged AS (SELECT doc_id, item_id, shift, count(DISTINCT (kind, a, b)) AS m, count(DISTINCT (kind, a)) AS ma, count(DISTINCT (kind, b)) AS mb, bool_and(a = b) AS same FROM slots GROUP BY ALL),
found AS (SELECT doc_id, item_id, shift, count(DISTINCT place) AS n, count(DISTINCT place) FILTER (NOT templ) AS plain FROM hits GROUP BY ALL),
ended AS (SELECT doc_id, item_id, coalesce(m = ma AND m = mb, true) AS fits, coalesce(same, true) AS same, n, plain FROM found LEFT JOIN judged USING (doc_id, item_id, shift))
SELECT doc_id, item_id, max(CASE WHEN fits THEN n ELSE plain END) AS n_windows, bool_or(fits AND same) AS exact, count(*) AS n_alignments
FROM ended WHERE fits OR plain > 0 GROUP BY doc_id, item_id
"""
