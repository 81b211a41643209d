"""Ids that are null or beyond 2**53, extra columns with the operators' own names, and rows that repeat ids, through every operator and stage."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, frame, words

from loglathe.llm import chat, decontaminate, langid, lines, lm, minhash, order, packing, sharding, vectors

BIG = 2**61
IDS = [BIG + 1, None, BIG + 3, 2**53 + 1, -(2**62) + 1, 0]
CLASHING = ("score", "rejected", "lang_pred", "language", "n_lines", "n_removed", "kept", "__kept", "lines", "stay", "version", "again", "class_id", "no_id", "queue", "row", "shard", "slot", "dot.ted")


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(31)
    return [" ".join(words(int(n), r)) for n in (40, 60, 80, 50, 30, 20)]


@pytest.fixture(scope="module")
def big(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(IDS, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).coalesce(1)


def key(x):
    return (x is None, x or 0)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=key)


def test_large_and_null_ids(spark, big, tmp_path):
    want = sorted(IDS, key=key)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(big).collect()}
    assert got == {i: (i, True) for i in IDS}
    assert ids(lm.score_documents(big)) == want
    assert set(ids(packing.pack(big))) == set(IDS)
    order.write_shards(big, str(tmp_path / "o"), length=64, per_shard=2)
    assert {r["doc_id"] for r in order.read_spans(spark, str(tmp_path / "o"), 64, 2).collect()} == set(IDS)
    assert ids(sharding.assign_shards(big)) == want
    assert ids(langid.predict(big, langid.fit(big.select("text", "lang")))) == want
    assert ids(langid.op8_query.__globals__["predict"](big.select("doc_id", langid.held_out().alias("h"), "text"), langid.train([], [])).where("h is not null")) == want
    assert ids(lines.dedup_lines(big)) == want
    bench = spark.createDataFrame([(BIG + 7, big.where(f"doc_id = {BIG + 1}").first()["text"])], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.find_leaks(big, bench).collect()] == [(BIG + 1, BIG + 7)]


def test_large_and_null_ids_of_conversations_and_vectors(spark):
    rows = [(i, t, "assistant" if t else "user", f"{i} {t}") for i in IDS for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r["conv_id"]: r["loss_chars"] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {i: len(f"{i} 1") for i in IDS}
    e = [(i, [1.0, float(k)], 0) for k, i in enumerate(IDS)] + [(None, [1.0, 0.0], 0), (BIG + 9, [1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in vectors.link_vectors(spark.createDataFrame(e, "vec_id long, embedding array<float>, label int").coalesce(1)).collect()), key=lambda r: key(r[0]))
    by = {r[0]: r[1:] for r in got if r[0] is not None}
    assert len(got) == len(e) and [r for r in got if r[0] is None] == [(None, 0, None, True)] * 2
    assert by[BIG + 9] == (1, BIG + 1, False) and by[BIG + 1] == (1, BIG + 1, True) and by[BIG + 3][1] in by


def test_clashing_columns_pass_every_stage(spark, big, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of the kind is in these documents at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = big
    for name in CLASHING:
        df = df.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.dtypes == df.dtypes, name
        rows = out.collect()
        assert sorted((r["doc_id"] for r in rows), key=key) == sorted(IDS, key=key), name
        assert all(r[c] == c for r in rows for c in CLASHING)
    assert set(ids(corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)))) == set(IDS)
    out = lines.dedup_lines(df)
    assert out.columns[-2:] == ["n_lines_", "n_removed_"]


def test_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


def test_written_shards_have_every_row(spark, big, tmp_path):
    """Null ids, and rows that share an id with another text, are written once each, in their text's shard."""
    more = big.unionByName(big.withColumn("text", F.concat("text", F.lit(" again")))).unionByName(big.limit(2)).withColumn("shard", F.lit("x"))
    sharding.write_shards(more, str(tmp_path / "w"), 3)
    back = spark.read.parquet(str(tmp_path / "w"))
    rows = lambda df: sorted(map(str, df.select(*more.columns).collect()))
    assert rows(back) == rows(more)
    assert back.groupBy("text").agg(F.count_distinct("shard_").alias("n")).where("n > 1").count() == 0


def test_shards_of_the_query_are_near_equal(spark):
    from loglathe.llm.queries import QUERIES

    rows = QUERIES["op1_bin_pack_shards"](spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(rows) == 8 and max(r["b"] for r in rows) <= 1.01 * min(r["b"] for r in rows) and all(r["m"] == r["n"] - 1 for r in rows)


def test_repeated_rows_and_several_texts_of_an_id(spark, texts):
    a, b, c = texts[0], texts[1], texts[2]
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, c, "en", "s", 1), (3, a, "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=lambda r: key(r[0]))
    assert got == [(1, 1, True), (2, 2, True), (3, 1, False), (None, None, True), (None, None, True)]
    stay = sorted(((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(spark, df, "").collect()), key=lambda r: (key(r[0]), r[1]))
    assert stay == sorted([(1, a), (2, b), (2, c), (None, a), (None, a)], key=lambda r: (key(r[0]), r[1]))
    scores = defaultdict(set)
    for r in lm.score_documents(df).collect():
        scores[r["doc_id"], r["n_tokens"]].add(round(r["pll"], 3))
    assert all(len(x) == 1 for x in scores.values()) and len(scores) == 5
    bench = spark.createDataFrame([(5, a)], "item_id long, text string")
    assert sorted(tuple(r)[:2] for r in decontaminate.find_leaks(df, bench).collect()) == [(1, 5), (3, 5)]


def test_short_items_and_other_numerals(spark):
    bench = spark.createDataFrame([(1, "Name the largest planet"), (2, "a train of 12 wagons needs 40 minutes to cross this old bridge"), (3, "Xylophone"), (4, "In 1990")], "item_id long, text string")
    arabic = "a train of \u0661\u0665 wagons needs \u0664\u0662 minutes to cross this old bridge"
    docs = frame(spark, ["please name the LARGEST planet of all", arabic, "one xylophone here", "in 1991 nothing was said", "long " * 30_000 + "name the largest planet " + "long " * 10])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 2): False, (2, 3): True, (4, 1): True}


@pytest.mark.parametrize("repeats", [1, 10, 1000])
def test_recall_at_the_threshold(spark, repeats):
    """Pairs of 46 words and the same 46 with five more, over and over (Jaccard about 0.8): none is lost, however often the five are repeated."""
    rows = []
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(46)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"p{k}x{i}" for i in range(5)] * repeats))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    from test_operators import classes_by_brute_force

    want = classes_by_brute_force([t for _, t in rows])
    assert got == want and sum(a != b for a, b in want.items()) == 40
