"""What bounds the memory of the tasks that read their lines in order: sorted runs, look-ups, leaders, packed micro-batches."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from loglathe.operators import bucketed, drain, frequency, iplom, ordered, sequential
from loglathe.operators.sequential import in_order
from loglathe.streaming import online


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fan_in", [2, 64])
def test_runs_are_merged_in_order(monkeypatch, fan_in):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, f"line {i} é") for i in range(5000)]
    r.shuffle(rows)
    monkeypatch.setattr(sequential, "RUN_BYTES", 4000)
    monkeypatch.setattr(sequential, "FAN_IN", fan_in)
    monkeypatch.setattr(sequential, "RUN_BATCH", 50)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "line_id", "line"), x, strict=True)) for x in rows[low : low + 70]]) for low in range(0, len(rows), 70)]
    assert list(in_order(batches, ["key", "line_id"])) == sorted(rows)
    assert list(in_order([], ["line_id"])) == []


@pytest.mark.parametrize("mine", [drain.drain, bucketed.lenma, ordered.spell, lambda d: ordered.shiso(d, 0.8, 4), ordered.logmine, bucketed.ael, bucketed.fttree])
def test_no_sort_of_all_lines_in_front_of_a_miner(lines, mine):
    assert "Sort [" not in plan(mine(lines("a b c", "a b d"))).split("MapInArrow")[1]


MINERS = [
    lambda: drain.Drain(4, 0.4), lambda: drain.Drain(4, 0.6), lambda: drain.Drain(5, 0.7, 6), lambda: ordered.Spell(0.5), lambda: ordered.Spell(0.8),
    lambda: ordered.Shiso(0.8, 4, ordered.letter_counts), lambda: ordered.Shiso(0.6, 2, ordered.letter_counts), lambda: ordered.Logmine(0.4, 2), lambda: ordered.Logmine(0.2, 3),
]


def corpus(seed):
    r = random.Random(seed)
    if seed % 2:
        return [f"user {r.randrange(50)} {r.choice(['view', 'error', 'buy'])} props {r.randrange(9)}".split() for _ in range(1200)]
    return [[r.choice("abcé") for _ in range(r.randrange(6))] + ["of", r.choice("xy")] * r.randrange(2) for _ in range(600)]


@pytest.mark.parametrize("seed", range(4))
def test_looked_up_lines_do_what_searched_ones_do(monkeypatch, seed):
    texts = corpus(seed)
    for make in MINERS:
        seen = []
        for calm in (sequential.CALM, 10**9):
            monkeypatch.setattr(sequential, "CALM", calm)
            m = make()
            m_add = getattr(m, "ingest", m.add)
            told = [m_add(i, list(t)) for i, t in enumerate(texts)]
            if isinstance(m, ordered.Logmine) and calm == 10**9:  # its look-ups do not wait
                m = make()
                for i, t in enumerate(texts):
                    m.settled.changed()
                    m.add(i, list(t))
            seen.append((m.templates(), [x[1:] if isinstance(m, drain.Drain) else x for x in told]))
        assert seen[0] == seen[1]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("threshold", [0.9, 0.99])
def test_lenma_by_definition(seed, threshold):
    n = 5 if seed % 2 else 3
    miner, clusters = bucketed.Lenma(threshold), []
    for i, tokens in enumerate(t for t in corpus(seed) if len(t) == n):
        own, best, at = [len(t) for t in tokens], -1.0, None
        for c in clusters:
            dot = sum(a * b for a, b in zip(own, c[1], strict=True))
            same = all(w is None or w == t for w, t in zip(c[0], tokens, strict=True))
            score = 1.0 if same else dot / (sum(a * a for a in own) ** 0.5 * sum(a * a for a in c[1]) ** 0.5)
            if score >= threshold and score > best:
                best, at = score, c
        if at is None:
            clusters.append([list(tokens), own, 1, i])
        else:
            at[0], at[1], at[2] = [w if w == t else None for w, t in zip(at[0], tokens, strict=True)], own, at[2] + 1
        miner.ingest(i, tokens)
    assert [(list(t), c, f) for t, c, f in miner.templates()] == [(c[0], c[2], c[3]) for c in clusters]


@pytest.mark.parametrize("share", [0.25, 0.5])
@pytest.mark.parametrize("least", [3, 5000])
def test_ael_keeps_leaders_only(share, least):
    """The rows of leaders that take later free lines, from a miner that keeps no other line."""
    texts = [t for t in corpus(1) if len(t) == 5]
    free, want = list(enumerate(texts)), Counter()
    while free:
        (i, lead), rest = free[0], free[1:]
        apart = lambda t: sum(a != b for a, b in zip(t, lead, strict=True))
        taken = [(j, t) for j, t in rest if 0 < apart(t) <= share * 5] if len(texts) >= least else []
        free = [x for x in rest if x not in taken]
        want[tuple(w if all(t[k] == w for _, t in taken) else None for k, w in enumerate(lead))] += 1 + len(taken)
    miner = bucketed.Ael(share, least)
    for i, t in enumerate(texts):
        miner.add(i, t)
    got = Counter()
    for t, n, _ in miner.templates():
        got[tuple(t)] += n
    assert got == want
    assert least > len(texts) or len(miner.about) + len(miner.early) < len(texts) / 4


def test_a_micro_batch_is_packed_before_it_is_grouped(spark, tmp_path):
    rows = [(i, f"user {i % 37} does {i % 3}") for i in range(3000)]
    spark.createDataFrame(rows, "line_id long, line string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, line string").parquet(str(tmp_path / "in"))
    events = online.run_available(online.spell_stream(stream), str(tmp_path / "run"))
    assert events.count() == 3000 and events.select("line_id").distinct().count() == 3000
    assert sorted(map(str, online.final_templates(events).collect())) == sorted(map(str, ordered.spell(spark.createDataFrame(rows, "line_id long, line string")).collect()))
    packed = list(online._packed([pa.RecordBatch.from_pylist([{"key": "", "line_id": i, "line": t} for i, t in reversed(rows)])]))
    assert [b.num_rows for b in packed] == [1] and packed[0].nbytes < 20_000
    assert [r for b in online._unpacked(b.to_pandas() for b in packed) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == rows
    assert "none_update" in {r[0] for r in events.select("update_type").distinct().collect()}


def test_lookup_in_place_and_by_join(spark, lines, monkeypatch):
    """The most wildcards, then the oldest; lines without a template have no row. No line is shuffled where templates are few."""
    texts = ["a b c", "a x c", "a b", "", "q", "a b c d", "a b d", "z b c"]
    rows = [(3, ["a", None, "c"]), (5, [None, "b", "c"]), (4, ["a", None, None]), (2, ["a", "b", "c"]), (9, ["a", None, None]), (7, []), (8, [None]), (6, [None, None, "c"])]
    templates = spark.createDataFrame(rows, "first_line_id long, template array<string>")
    got = drain.drain_lookup(lines(*texts), templates)
    assert "Sort" not in plan(got) and "Join" not in plan(got)
    want = {0: 4, 1: 4, 3: 7, 4: 8, 6: 4, 7: 6}
    assert {r[0]: r[1] for r in got.collect()} == want
    monkeypatch.setattr(drain, "IN_PLACE", 2)
    assert {r["line_id"]: r["first_line_id"] for r in drain.drain_lookup(lines(*texts), templates).collect()} == want


@pytest.mark.parametrize("words", [bucketed.WORDS, 1])
@pytest.mark.parametrize("seed", range(6))
def test_dlog_of_beginnings(lines, monkeypatch, seed, words):
    """Cut lines give what whole lines give, and there are fewer of them."""
    r = random.Random(seed)
    if seed < 3:
        texts = [f"u {r.randrange(12)} {r.choice('xyz')} props k {r.randrange(40)} {i}" for i in range(300)] + ["u 99 x props k 5 7"] * (seed * 2)
    else:
        texts = [" ".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(10 + 20 * seed)] + ["a b c a b c a"] * 2
    whole = {}
    for i, t in enumerate(texts):
        whole.setdefault(t.split(" ")[0], bucketed.DLog()).add(i, t.split())
    want = {}
    for t, n, first in (x for m in whole.values() for x in m.templates()):
        old = want.get(tuple(t), (0, first))
        want[tuple(t)] = (old[0] + n, min(old[1], first))
    monkeypatch.setattr(bucketed, "WORDS", words)
    assert {tuple(x["template"]): (x["n_lines"], x["first_line_id"]) for x in bucketed.dlog(lines(*texts)).collect()} == want


def test_dlog_cuts_lines(lines):
    d = tokens_of(lines(*(f"u {i % 5} x {i % 3} {i}" for i in range(200))))
    assert bucketed._constant_words(d)[0] == 3


def tokens_of(df):
    return sequential.tokenized(df).groupBy("tokens").agg({"*": "count", "line_id": "min"}).toDF("tokens", "n", "line_id")


def test_counts_in_place_and_by_join(lines, monkeypatch):
    """No line is joined where words are few; else only tokens that are not among the most frequent are. All ways give the same rows."""
    texts = [f"a {i % 7} b{i % 3} c a {i} {i // 2}" for i in range(90)] + ["", "a", "b1 b1"]
    ways = [frequency.lfa, lambda d: frequency.va(d, "relative-variable", 0.5), lambda d: frequency.slct(d, 1, 0), lambda d: frequency.logcluster(d, 2)]
    few = [sorted(map(str, w(lines(*texts)).collect())) for w in ways]
    assert all("Join" not in plan(w(lines(*texts))) for w in ways)
    monkeypatch.setattr(frequency, "IN_PLACE", 0)
    for most in (10**6, 20, 5, 0):
        monkeypatch.setattr(frequency, "COUNTED", most)
        assert [sorted(map(str, w(lines(*texts)).collect())) for w in ways] == few


def test_iplom_broadcasts_what_it_tells_of_partitions(spark, lines, monkeypatch):
    texts = [f"user {i % 11} {'get' if i % 3 else 'put'} k {i % 4}" for i in range(90)] + ["", "a b", "a c d"]
    stage = lambda: iplom.stage3(iplom.stage2(iplom.stage1(lines(*texts))))
    shown = lambda df: sorted(map(str, df.collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" not in plan(stage())
        want = shown(stage()), shown(iplom.iplom(lines(*texts)))
        monkeypatch.setattr(iplom, "BROADCAST", 0)
        assert (shown(stage()), shown(iplom.iplom(lines(*texts)))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
