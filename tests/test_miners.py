"""Hand-traced fixtures, edge cases and invariants of every miner."""

import pytest

from loglathe.functions.tokens import tokenize
from loglathe.operators import bucketed, drain, frequency, iplom, lke, neural, ordered, search
from loglathe.operators.drain import Drain
from loglathe.plans.registry import PARSERS, parser
from pyspark.sql import functions as F

O = None


def mined(df):
    return [tuple(r["template"]) for r in df.orderBy("first_line_id").collect()]


CASES = [
    (lambda d: frequency.slct(d, 1, 1), ["a x", "a y", "b z"], [("a", O)]),
    (frequency.lfa, ["a x", "a y", "z"], [("a", O), ("z",)]),
    (lambda d: frequency.va(d, "static", 1), ["a a", "b c"], [("a", "a"), (O, O)]),
    (lambda d: frequency.va(d, "relative-line", 0.5), ["a a", "b c"], [("a", "a"), (O, O)]),
    (lambda d: frequency.va(d, "relative-variable", 0.5), ["a b", "a c"], [("a", O)]),
    (lambda d: frequency.logcluster(d, 3), ["a x b", "a b", "a x y b z"], [("a", O, "b"), ("a", "b"), ("a", O, O, "b", O)]),
    (lambda d: bucketed.ael(d, 0.5, 3), ["a b", "a b", "a c"], [("a", O), ("a", "b")]),
    (lambda d: drain.drain(d, 4, 0.4), ["a b c", "a b d", "x y z"], [("a", "b", O), ("x", "y", "z")]),
    (iplom.iplom, ["a x", "a y", "b x", "b y"], [("a", O), ("b", O)]),
    (lambda d: bucketed.lenma(d, 0.9995), ["ab cd", "ab xy"], [("ab", O)]),
    (bucketed.dlog, ["a x c", "a y c"], [("a", O, "c")]),
    (bucketed.dlog, ["A x c d", "A y c d"], [("A", O, "c", O)]),
    (lambda d: bucketed.fttree(d, 2, 0), ["b a", "c a"], [("b", "a"), (O, O)]),
    (lambda d: ordered.spell(d, 0.5), ["a b c d", "a b x y"], [("a", "b", O)]),
    (lambda d: ordered.shiso(d, 0.5, 2), ["ab x", "ab y"], [("ab", O)]),
    (lambda d: ordered.shiso(d, 0.9, 2), ["ab x", "ab y"], [("ab", "x"), ("ab", "y")]),
    (lambda d: ordered.logmine(d, 0.5, 1), ["a b", "a c"], [("a", "b")]),
    (lambda d: search.logsig(d, 1), ["a b", "a c", "a d"], [("a", O)]),
    (lambda d: search.logsig(d, 1), ["a b", "a c"], [("a", "b")]),
    (lambda d: lke.lke(d, 3), ["a b c", "a b d"], [("a", "b", "c"), ("a", "b", "d")]),
    # Lines that the original methods fail on: defined results.
    (iplom.iplom, ["", ""], [()]),
    (lambda d: bucketed.ael(d, 0.5, 2), ["", "", ""], [()]),
    (lambda d: ordered.shiso(d, 0.5, 2), ["é à", "é à"], [("é", "à")]),
    (frequency.lfa, [""], [()]),
    (lambda d: frequency.slct(d, 1, 1), ["", ""], [()]),
    (lambda d: bucketed.lenma(d, 0.9), ["", ""], [()]),
    (lambda d: bucketed.fttree(d, 6, 3, "top"), [""], [()]),
    (lambda d: search.molfi(d), [""], [()]),
    (lambda d: neural.nulog(d, 1, nr_epochs=1), [""], [()]),
]


@pytest.mark.parametrize(("miner", "given", "expected"), CASES)
def test_fixture(lines, miner, given, expected):
    assert mined(miner(lines(*given))) == expected


def test_patterns(lines):
    got = frequency.logcluster_patterns(lines("a x b", "a b", "a x y b z"), 3).select(frequency.pattern_text("pattern")).collect()
    assert [r[0] for r in got] == ["a [0,2] b [1]"]


@pytest.mark.parametrize("name", sorted(set(PARSERS) - {"logcluster_patterns"}))
def test_empty_input_and_null_line(spark, lines, name):
    params = {
        "va": {"method": "static", "threshold": 1}, "va_static": {"threshold": 1}, "varl": {"threshold": 0.5}, "varv": {"threshold": 0.5}, "logcluster": {"freq_bar": 1},
        "lke": {"split_threshold": 3}, "shiso": {"threshold": 0.5, "max_child": 4}, "nulog": {"k": 1, "nr_epochs": 1},
    }.get(name, {})
    p = parser(name, **params)
    assert p.mine(spark.createDataFrame([], "line_id long, line string")).count() == 0
    if name != "slct":
        assert p.mine(spark.createDataFrame([(0, None), (1, "a b")], "line_id long, line string")).count() >= 1


COVERING = {
    "ael": {}, "dlog": {}, "drain": {}, "fttree": {}, "iplom": {}, "lenma": {}, "lfa": {}, "logcluster": {"freq_bar": 5}, "molfi": {}, "lke": {"split_threshold": 3},
    "shiso": {"threshold": 0.7, "max_child": 4}, "varv": {"threshold": 0.5},
}


@pytest.mark.parametrize("name", sorted(COVERING))
def test_every_line_is_matched_and_partitions_do_not_matter(spark, name):
    from loglathe.operators.match import missed_lines

    rows = [(i, f"{'get' if i % 3 else 'put'} item {i % 7} from host{i % 5} {'ok' if i % 2 else 'slow'}") for i in range(60)]
    df = spark.createDataFrame(rows, "line_id long, line string")
    p = parser(name, **COVERING[name])
    one, seven = (p.mine(df.repartition(n)).persist() for n in (1, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, seven.collect()))
    assert missed_lines(df, one.withColumn("template_id", F.col("first_line_id"))).count() == 0


def test_molfi_has_no_covered_template(lines):
    from loglathe.functions.sequences import covers

    got = mined(search.molfi(lines(*(f"a {i} b{i % 3}" for i in range(20)))))
    assert len(set(got)) == len(got)
    assert not any(x != y and covers(x, y) for x in got for y in got)


def test_drain_online():
    d = Drain()
    assert [d.ingest(i, t.split())[1] for i, t in enumerate(["a b c", "a b d", "x y z", "a b q"])] == ["cluster_created", "cluster_template_changed", "cluster_created", "none_update"]
    assert d.match("a b zz".split()).template == ["a", "b", None]
    assert d.match("q b zz".split()) is None
    assert d.total_size() == 4
    assert [c.number for c in d.clusters_of_length(3)] == [1, 2]
    assert any("a b <*>" in x for x in d.tree_lines())
    with pytest.raises(ValueError):
        Drain(depth=2)


def test_drain_overflow():
    d = Drain(depth=4, max_children=2, sim_th=0.9)
    for i, t in enumerate(["a x 1", "b x 1", "c x 1", "d x 1"]):
        d.ingest(i, t.split())
    assert set(d.roots[3].children) == {"a", None}


def test_drain_delimiters(lines):
    assert mined(drain.drain(lines("a:b=c", "a:b=d"), extra_delimiters=[":", "="])) == [("a", "b", O)]


def test_unknown_method(lines):
    with pytest.raises(NotImplementedError):
        frequency.va(lines("a"), "other", 1)
    with pytest.raises(KeyError):
        parser("nothing")


def test_parse_list():
    assert parser("drain").parse(["a b c", "a b d"]) == [("a", "b", O)]
    assert parser("drain", depth=5).identifier() == {"name": "drain", "depth": 5}


@pytest.mark.parametrize("text", ["  a b\tc\n", "", " x y\u0085z　w\x1cq ", "one"])
def test_tokenize_is_python_split(spark, text):
    row = spark.createDataFrame([(text,)], "line string").select(tokenize("line").alias("t")).first()
    assert row["t"] == text.split()


def test_parse_goes_on(spark):
    for name, params in (("drain", {}), ("lfa", {}), ("dlog", {}), ("fttree", {}), ("shiso", {"threshold": 0.5, "max_child": 4})):
        p, whole = parser(name, **params), parser(name, **params)
        p.parse(["a b c", "a b d"])
        assert p.parse(["a b q", "x y z"]) == whole.parse(["a b c", "a b d", "a b q", "x y z"]), name
        p.reset()
        assert p.parse(["k l"]) == parser(name, **params).parse(["k l"])
    p = parser("lenma", threshold=0.9)
    p.parse(["ab cd"])
    assert p.parse(["x"]) == [("x",)]


def test_fttree_with_a_function(lines):
    """A function that does what a named message type does gives its templates, online too."""
    from loglathe.operators.bucketed import OnlineFtTree

    texts = [f"{'get' if i % 3 else 'put'} i {i % 4} x{i % 6}" for i in range(60)]
    for name, kind in (("top", lambda p: (p[0], p[1:])), ("length", lambda p: (len(p), p)), ("none", lambda p: (None, p))):
        want = sorted(map(str, bucketed.fttree(lines(*texts), 3, 1, name).collect()))
        assert sorted(map(str, bucketed.fttree(lines(*texts), 3, 1, kind).collect())) == want
        online = OnlineFtTree(3, 1, kind)
        for i, t in enumerate(texts):
            online.ingest(i, t.split())
        assert {tuple(t) for t, _, _ in online.templates()} == {tuple(r["template"]) for r in bucketed.fttree(lines(*texts), 3, 1, name).collect()}
    with pytest.raises(ValueError):
        bucketed.fttree(lines("a"), message_type="other")


def test_dlog_deep_lines(lines):
    one, two = " ".join(f"w{i}" for i in range(120)), " ".join("z" if i == 60 else f"w{i}" for i in range(120))
    got = mined(bucketed.dlog(lines(one, two)))
    assert len(got) == 1 and len(got[0]) == 120 and got[0][60] is None


def test_masked_in_place_and_by_join(lines, monkeypatch):
    texts = [f"a {i % 7} b{i % 3} c d {i}" for i in range(90)] + [""]
    ways = [lambda d: frequency.slct(d, 10, 1), lambda d: frequency.va(d, "static", 20), lambda d: frequency.va(d, "relative-line", 0.1), lambda d: frequency.logcluster(d, 30)]
    few = [sorted(map(str, w(lines(*texts)).collect())) for w in ways]
    monkeypatch.setattr(frequency, "IN_PLACE", 0)
    assert [sorted(map(str, w(lines(*texts)).collect())) for w in ways] == few


def test_ingest_tells_what_changed():
    from loglathe.operators.bucketed import Lenma
    from loglathe.operators.ordered import Shiso, Spell, letter_counts

    for miner, texts, want in (
        (Lenma(0.9), ["ab cd", "ab cd", "ab xy"], ["cluster_created", "none_update", "cluster_template_changed"]),
        (Spell(0.5), ["a b c d", "a b c d", "a b x y"], ["cluster_created", "none_update", "cluster_template_changed"]),
        (Shiso(0.5, 2, letter_counts), ["ab x", "ab x", "ab y"], ["cluster_created", "none_update", "cluster_template_changed"]),
    ):
        assert [miner.ingest(i, t.split())[2] for i, t in enumerate(texts)] == want


def test_logsig_runs_until_it_is_stable(lines):
    texts = [f"a {i % 3} b {i % 2}" for i in range(24)]
    assert mined(search.logsig(lines(*texts), 3)) == mined(search.logsig(lines(*texts), 3, max_pass=1000))


@pytest.mark.parametrize("near", [0.2, 0.5, 0.9, 1.5])
def test_lke_links_shapes_as_all_pairs_do(lines, near, monkeypatch):
    """Lines that differ in words of their own are one shape; its links connect what the links of all pairs connect, in blocks too."""
    from loglathe.functions.sequences import late_edit_distance
    from loglathe.plans.components import components

    texts = [f"{'get' if i % 3 else 'put'} id{i} of h{i % 4} {'ok' if i % 2 else 'late again'}" for i in range(40)] + ["", "x y x", "y x x", "x x", "one", "two"]
    shaped = lke.shapes(lines(*texts))
    assert shaped.select("lo").distinct().count() < 30
    dist = {(a, b): late_edit_distance(texts[a].split(), texts[b].split()) for b in range(len(texts)) for a in range(b)}
    component = list(range(len(texts)))
    for (a, b), d in dist.items():
        if d < near:
            x, y = sorted((component[a], component[b]))
            component = [x if c == y else c for c in component]
    for block in (lke.BLOCK, 4):
        monkeypatch.setattr(lke, "BLOCK", block)
        assert {r["dist"] for r in lke.distances(shaped).collect()} == set(dist.values())
        got = {r["id"]: r["component"] for r in components(lke.links(shaped, near)).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == component


def test_lke_patterns_of_long_lines(lines):
    """More places than the bits of a word."""
    from loglathe.functions.sequences import late_edit_distance

    texts = [[f"w{(i * j) % 7}" for j in range(5 + i % 9)] for i in range(40)]
    for i, j, dist, number in lke._patterns(texts, texts):
        assert all(dist[number[a, b]] == late_edit_distance(texts[x], texts[y]) for a, x in enumerate(i) for b, y in enumerate(j))
