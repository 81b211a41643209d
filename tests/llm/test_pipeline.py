"""The pipeline against its stages by brute force, over a folder of small tables."""

import zlib

import numpy as np
import regex
from pyspark.sql import functions as F
from test_operators import DOCS, classes_by_brute_force, ids_of, kept_by_brute_force, words


def texts():
    r, out = np.random.default_rng(21), []
    for _ in range(15):
        own = [" ".join(words(int(r.integers(12, 40)), r)) for _ in range(3)]
        out.append("\n".join(own))
        out.append("\n".join([own[0], " ".join(words(30, r))]))  # repeats a line
        near = own[1].split()
        near[3] = "changed"
        out.append(" ".join(near) + "\n" + " ".join(words(4, r)))  # a similar line
    out += [out[0], "", None, "123 !!", "\n\n"]
    return out


ITEM = "what is the name of the river that runs through the old town of the north"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = texts()
    rows.append("some start " + ITEM + " some end")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(rows)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    state, stages = docs, dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        state = stages[name](spark, state, str(tmp_path))
        assert state.dtypes == docs.dtypes, name
    left = {r["doc_id"]: r["text"] for r in state.collect()}

    letters = [(i, t) for i, t in enumerate(rows) if t and regex.search(r"\p{L}", t)]
    kept = kept_by_brute_force(letters)
    want = {}
    for i, t in letters:
        parts = t.split("\n")
        stay = [p for k, p in enumerate(parts) if k in kept[i] or not regex.search(r"[\p{L}\p{M}\p{N}]", p)]
        if kept[i]:
            want[i] = "\n".join(stay)
    order = sorted(want)
    classes = classes_by_brute_force([want[i] for i in order])
    want = {order[k]: want[order[k]] for k in classes if classes[k] == k}
    want = {i: t for i, t in want.items() if ITEM not in t}
    assert left == want

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(want)
    for i, t in want.items():
        ids, at = np.array([*ids_of(t), 0], dtype="<u4"), 0
        for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert F is not None


def test_contract_columns(spark):
    from loglathe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    need = {
        "op1_bin_pack_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op3_itq_embeddings": "vec_id n_links component_id kept",
        "op6_mixture_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op8_language_id": "doc_id held_out lang_pred score",
        "op9_chat_windows": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    }
    for name, columns in need.items():
        df = QUERIES[name](spark, sf)
        assert set(columns.split()) <= set(df.columns), name
        assert df.count() > 0
