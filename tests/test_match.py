from loglathe.operators import match
from pyspark.sql import functions as F


def table(spark, *templates):
    return spark.createDataFrame([(i, t) for i, t in enumerate(templates)], "template_id long, template array<string>")


def test_four_utilities(spark, lines):
    logs, tpls = lines("a x", "b", "c", "c"), table(spark, ["a", None], ["b"])
    assert {tuple(r[0]): len(r[1]) for r in match.template_line_lists(logs, tpls).collect()} == {("a", None): 1, ("b",): 1}
    assert {tuple(r[0]): [tuple(t) for t in r[1]] for r in match.lines_to_templates(logs, tpls).collect()} == {("a", "x"): [("a", None)], ("b",): [("b",)], ("c",): []}
    assert sorted(r["line"] for r in match.missed_lines(logs, tpls).collect()) == ["c", "c"]
    assert match.missed_templates(logs, tpls).count() == 0


def test_empty_matches_empty(spark, lines):
    assert match.missed_lines(lines("", "a"), table(spark, [])).select("line").collect()[0][0] == "a"


def test_word_none_is_no_wildcard(spark, lines):
    assert match.match_pairs(lines("None", "x"), table(spark, ["None"])).count() == 1


def test_fallback_join_gives_the_same(spark, lines, monkeypatch):
    logs, tpls = lines("a b", "a c", "d c", "d"), table(spark, ["a", None], [None, "c"], [None, None], ["d"], ["q"])
    found = lambda: {(r["line_id"], r["template_id"]) for r in match.match_pairs(logs, tpls).collect()}
    fast = found()
    monkeypatch.setattr(match, "MASKS", 0)
    assert fast == found() and len(fast) == 8


def test_covers(spark):
    tpls = table(spark, ["a", None], ["a", "b"], [None, None], ["a"])
    pairs = {(r["parent_id"], r["child_id"]) for r in match.cover_pairs(tpls).collect()}
    assert pairs == {(0, 1), (2, 0), (2, 1)}
    assert {r["template_id"] for r in match.remove_covered(tpls).collect()} == {2, 3}


def test_repeated_templates_stay(spark, lines):
    tpls = table(spark, ["a", None], ["a", None])
    got = match.lines_to_templates(lines("a x"), tpls).first()
    assert len(got["templates"]) == 2
    assert match.missed_templates(lines("b"), tpls).count() == 2


def test_lists_in_line_order(spark, lines):
    got = match.template_line_lists(lines("a 1", "a 2", "a 1"), table(spark, ["a", None])).first()
    assert [t[1] for t in got["lines"]] == ["1", "2", "1"]
    assert F is not None
