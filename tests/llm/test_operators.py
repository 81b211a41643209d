"""Each operator against brute force on small fixtures, with the edge cases its docstring defines."""

import hashlib
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loglathe.llm import chat, components, decontaminate, langid, lines, lm, minhash, order, packing, sharding, vectors
from loglathe.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(0)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(300)]


def words(n, r):
    return [VOCABULARY[i] for i in r.integers(0, len(VOCABULARY), n)]


def corpus():
    """Copies, near copies, empty and null texts, marks only, one word, a long text, repeated rows."""
    r, texts = np.random.default_rng(1), []
    for _ in range(12):
        base = words(60, r)
        texts.append(" ".join(base))
        for k in range(3):
            near = list(base)
            near[int(r.integers(0, 60))] = f"edit{k}"
            texts.append(" ".join(near))
    texts += [texts[0], texts[0], "", None, None, "!!! ???", "word", "word", "Zürich Straße élan", " ".join(words(6000, r))]
    return texts


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # Extra columns whose names clash with the operators' own.
    for name in ("n", "key", "pos", "ids", "shard", "slot", "band", "__group", "words", "hash", "component"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- sharding


def test_shards(docs):
    rows = sharding.assign_shards(docs, 4).collect()
    texts = corpus()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    homes, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1
        assert r["text_crc32"] == zlib.crc32((t or "").encode())
        homes[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_repeated_rows_and_nothing(docs, empty):
    rows = sharding.assign_shards(docs.unionByName(docs), 4).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) == 2 * len(corpus())
    assert sharding.assign_shards(empty, 4).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes, capacity = r.integers(1, 50, 80).tolist(), 100
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(free, b) for b, free in enumerate(bins) if free >= sizes[i]]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append(capacity)
            bins[b] -= sizes[i]
            want[i] = b
        assert sharding.best_fit_decreasing(sizes, capacity) == want
    loads = np.bincount(sharding.pack_into(sizes, 8), sizes, 8)
    assert loads.max() <= 1.15 * loads.mean()


# --- line dedup


def kept_by_brute_force(texts):
    """Of (doc_id, text): the kept line numbers of each document."""
    seen, out = [], {}
    for i, t in texts:
        out.setdefault(i, [])
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            s = frozenset(regex.findall(r"[\p{L}\p{M}\p{N}]+", line.lower()))
            if not s:
                continue
            if not any(5 * len(s & q) >= 4 * len(s | q) for q in seen):
                out[i].append(k)
            seen.append(s)
    return out


def test_line_dedup_against_brute_force(spark):
    r, texts = np.random.default_rng(5), []
    base = [words(int(n), r) for n in r.integers(1, 40, 60)]
    for _ in range(60):
        own = []
        for _ in range(int(r.integers(0, 8))):
            w = list(base[int(r.integers(0, len(base)))])
            for _ in range(int(r.integers(0, 3))):
                w[int(r.integers(0, len(w)))] = VOCABULARY[int(r.integers(0, 300))]
            own.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w) + ".")
        texts.append("\n".join(own))
    texts += ["", None, "\n\n***", "one", "One!", " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(2900))]
    df = frame(spark, texts)
    want = kept_by_brute_force(list(enumerate(texts)))
    got = {x["doc_id"]: x["kept"] for x in lines.kept_lines(df).collect()}
    assert {i: got.get(i, []) for i in want} == want
    out = {x["doc_id"]: x for x in lines.dedup_lines(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        parts = (t or "").split("\n")
        stay = [p for k, p in enumerate(parts) if k in want[i] or not regex.search(r"[\p{L}\p{M}\p{N}]", p)]
        assert out[i]["text"] == (None if t is None else "\n".join(stay))
    assert out[0]["key"] == "x"


def rows_generated(spark, what):
    """The rows that all Generate nodes so far with ``what`` in their description have made."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate" and what in node.desc():
                got = values.get(node.metrics().apply(0).accumulatorId())
                total += int(got.get().replace(",", "")) if got.isDefined() else 0
    return total


def test_line_dedup_compares_a_family_by_its_members(spark, monkeypatch):
    """Copies that the first round leaves to the join: each is read again with its closest candidate, not in all pairs."""
    monkeypatch.setattr(lines, "FAMILY", 1000)  # no first round
    own = [f"base{i}" for i in range(30)]
    texts = [" ".join([*own[: i % 30], f"new{i}", *own[i % 30 + 1 :]]) for i in range(200)]
    texts += [" ".join([*own[:20], *(f"far{i}x{k}" for k in range(10))]) for i in range(3)]  # shares words, similar to none
    want, before = kept_by_brute_force(list(enumerate(texts))), rows_generated(spark, "array(pos")
    got = {x["doc_id"]: x["kept"] for x in lines.kept_lines(frame(spark, texts)).collect()}
    assert {i: got.get(i, []) for i in want} == want
    assert [i for i in want if want[i]] == [0, 200, 201, 202]
    assert 0 < rows_generated(spark, "array(pos") - before <= 4 * len(texts)


def test_line_dedup_tokenises_once_and_groups_by_hash(spark):
    """The sets are grouped without a sort of their arrays, and each is split into words once."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert lines.kept_lines(frame(spark, ["a b c d e\na b c d e", "A B C D E F", "x y z"])).count() == 2
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    graphs = [store.planGraph(runs.apply(k).executionId()).allNodes() for k in range(before, runs.size())]
    nodes = [(n.name(), n.desc()) for g in graphs for n in (g.apply(i) for i in range(g.size()))]
    grouped = [name for name, desc in nodes if "Aggregate" in name and "k1" in desc]
    assert grouped and set(grouped) == {"HashAggregate"}
    assert not [desc for name, desc in nodes if name == "Filter" and "split(lower" in desc]


def test_line_dedup_has_small_plans(spark, docs):
    """The places of the buckets come from a table: only the statement that writes it describes them, and no row of a line holds them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert lines.kept_lines(docs).count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    texts = [runs.apply(k).physicalPlanDescription() for k in range(before, runs.size())]
    assert len(texts) > 10 and sum(len(t) > 200_000 for t in texts) == 1, sorted(map(len, texts))[-4:]
    assert [t for t in texts if "Subquery" in t] and not [t for t in texts if re.search(r"ubquery#\d+(, \[id=#\d+\])? AS places#", t)]


def test_line_dedup_with_a_sampled_order_and_any_letters(spark, monkeypatch):
    """Rarity from few of the documents changes no result; lines of ASCII and others are split alike; sets around the bitmap's change of width."""
    monkeypatch.setattr(lines, "RARITY_DOCS", 5)
    r, texts = np.random.default_rng(9), ["\u212a b c d \u00e9", "k,b;c_d \u00c9!", "k b c d e", "a\u0301 b 1\u00b2 d", "A\u0301-b-1\u00b2-d", "", "_", None]
    for n in (9, 31, 32, 39, 40, 63, 80, 95, 96, 97, 110, 127, 130, 160):
        for size in (n, n + n // 4, n + n // 4 + 1):
            own = [f"w{n}x{k}" for k in range(size)]
            r.shuffle(own)
            texts.insert(int(r.integers(0, len(texts))), " ".join(own))
    want = kept_by_brute_force(list(enumerate(texts)))
    for family in (8, 0):
        monkeypatch.setattr(lines, "FAMILY", family)
        got = {x["doc_id"]: x["kept"] for x in lines.kept_lines(frame(spark, texts)).collect()}
        assert {i: got.get(i, []) for i in want} == want


def test_line_dedup_with_large_ids(spark):
    rows = [(2**61 + i, t, None, None, None) for i, t in enumerate(["a b c d e", "a b c d e", "a b c d f g h"])]
    got = {r["doc_id"]: r["kept"] for r in lines.kept_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {2**61: [0], 2**61 + 2: [0]}


def test_line_dedup_of_nothing(empty):
    assert lines.dedup_lines(empty).count() == 0


# --- embeddings


def links_by_brute_force(rows):
    links, parent = defaultdict(int), {v: v for v, _, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ok = [(v, np.array(e, dtype=float), y) for v, e, y in rows if y is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    for i, (a, x, y) in enumerate(ok):
        for b, z, w in ok[i + 1 :]:
            if y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {v: (links[v], top(v)) for v, _, _ in rows}


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # groups of more than a block
    r, rows = np.random.default_rng(7), []
    for c in range(30):
        centre = r.normal(size=16)
        for _ in range(40 if c == 0 else int(r.integers(1, 6))):
            rows.append((len(rows), [float(x) for x in np.float32(centre + r.normal(size=16) * 0.12)], int(c % 4)))
    rows += [(len(rows) + i, e, y) for i, (e, y) in enumerate([(rows[0][1], 0), (rows[0][1], 0), (rows[0][1], None), (None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([None] * 16, 0), ([], 0), ([1.0, 2.0], 0), ([float("inf")] * 16, 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).repartition(3)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.link_vectors(df.unionByName(df.limit(5))).collect()}
    want = links_by_brute_force(rows)
    found, there = sum(g for g, _ in got.values()), sum(w for w, _ in want.values())
    assert there > 500 and all(got[v][0] <= want[v][0] for v in want)
    assert found >= 0.99 * there and len(got) == len(rows)
    assert sum(got[v][1] == want[v][1] for v in want) >= 0.99 * len(want)


def test_embeddings_of_nothing(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# --- scores


def test_scores_of_all_documents(docs, empty):
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    for i, t in enumerate(corpus()):
        n = len(regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]", (t or "").lower()))
        assert got[i]["n_tokens"] == n
        assert (got[i]["mean_pll"] is None) == (n == 0)
        assert got[i]["pll"] <= 0
    assert got[0]["pll"] == pytest.approx(got[48]["pll"])
    assert lm.score_documents(empty).count() == 0


def test_counts_come_as_columns(spark):
    """The driver gets numbers, not an object for each of up to a million ids."""
    rows = spark.range(300_000).select((F.col("id") % 7 - 1).alias("doc_id"), F.lit(False).alias("no_id"), F.array((F.col("id") * 3).cast("int")).alias("ids"))
    tracemalloc.start()
    try:
        counts = lm.count_tokens(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counts.sum() == 300_000 and set(np.flatnonzero(counts)) == set(range(0, 900_000, 3))
    assert most < 24e6, most


def test_scores_by_brute_force(spark, monkeypatch):
    """One token at a time, from the definition, given the same vocabulary and weights."""
    texts = [t for t in corpus() if t and len(t) < 2000][:20] + ["one"]
    tokens = lm.tokenised(frame(spark, texts))
    vocab = lm.Vocabulary(lm.count_tokens(tokens))
    net = lm.train(tokens, vocab)
    got = {r["doc_id"]: r["pll"] for r in lm.score(tokens, net, vocab).collect()}
    for row in tokens.collect():
        ids, total = row["ids"], 0.0
        for i, t in enumerate(ids):
            h = np.zeros(lm.DIM)
            for slot, j in enumerate((i - 2, i - 1, i + 1, i + 2)):
                h += net.emb[slot][vocab.context[ids[j]] if 0 <= j < len(ids) else lm.PAD]
            h = np.tanh(h)
            for z, k in ((h @ net.out + net.bias, vocab.cls[t]), (h @ net.out_part + net.bias_part[vocab.cls[t]], vocab.part[t])):
                total += z[k] - np.log(np.exp(z).sum())
            total += vocab.inside[t]
        assert got[row["doc_id"]] == pytest.approx(total, rel=1e-4)


def test_vocabulary_is_a_distribution():
    """Inside the counted parts the tokens' probabilities sum to one, and every frequent token has its own context."""
    r = np.random.default_rng(15)
    counts = np.zeros(lm.VOCAB)
    counts[r.permutation(lm.VOCAB)[:20_000]] = (r.pareto(1.0, 20_000) * 3 + 1).astype(int)
    v = lm.Vocabulary(counts)
    seen = np.flatnonzero(counts)
    cell = v.cls[seen].astype(int) * lm.PARTS + v.part[seen]
    sums = np.bincount(cell, np.exp(v.inside[seen].astype(float)), lm.CLASSES * lm.PARTS)
    assert np.allclose(sums[np.unique(cell)], 1, atol=1e-3) and np.allclose(np.exp(v.first).sum(axis=1)[np.unique(v.cls[seen])], 1, atol=1e-3)
    assert len(set(v.context[np.argsort(-counts)[: lm.OWN]])) == lm.OWN and len(np.unique(v.cls[seen])) > lm.CLASSES // 2


def test_scores_beat_word_frequencies(spark):
    """On text with order, predicting from both sides gains on the words' frequencies, on documents it has not seen."""
    r = np.random.default_rng(16)
    follow = {w: VOCABULARY[(i * 7 + 3) % 300] for i, w in enumerate(VOCABULARY)}

    def text():
        out = []
        while len(out) < 120:
            w = VOCABULARY[int(r.integers(0, 300))]
            out += [w, follow[w], follow[follow[w]]]
        return " ".join(out)

    seen, unseen = frame(spark, [text() for _ in range(400)]), frame(spark, [text() for _ in range(40)])
    tokens = lm.tokenised(seen)
    counts = lm.count_tokens(tokens)
    vocab = lm.Vocabulary(counts)
    rows = lm.score(lm.tokenised(unseen), lm.train(tokens, vocab, rounds=12), vocab).collect()
    mean = sum(x["pll"] for x in rows) / sum(x["n_tokens"] for x in rows)
    share = counts[counts > 0] / counts.sum()
    assert mean > (share * np.log(share)).sum() + 0.5


def test_network_learns_both_sides():
    """Classes decided by the neighbours on either side are predicted far better than by chance."""
    r = np.random.default_rng(2)
    x = np.tile(np.array([5, 900, 77, 1500], dtype=np.int32), 3000)
    x[r.random(len(x)) < 0.05] = 3000
    flat, at = lm._flat([x])
    context, cls, part = np.where(flat >= 0, flat, lm.PAD), flat % lm.CLASSES, flat // 7 % lm.PARTS
    net = lm.Network()
    before = net.log_target(lm._windows(context, at), cls[at], part[at]).mean()
    for _ in range(3):
        for some in lm._steps(r.permutation(at), 1024):
            net.step(lm._windows(context, some), cls[some], part[some], lm.RATE)
    after = net.log_target(lm._windows(context, at), cls[at], part[at]).mean()
    assert before < -7 and after > -2.0


def test_gradient():
    net, r = lm.Network(seed=3), np.random.default_rng(4)
    net.out_part = r.normal(0, 0.1, net.out_part.shape).astype(np.float32)
    window = [r.integers(0, 50, 8) for _ in range(2 * lm.SIDE)]
    cls, part = r.integers(0, lm.CLASSES, 8), r.integers(0, lm.PARTS, 8)
    loss = lambda: -net.log_target(window, cls, part).mean()
    for name, at in (("bias", (3,)), ("bias_part", (int(cls[0]), 5)), ("out", (2, 7)), ("out_part", (1, int(part[0])))):
        before, old = loss(), getattr(net, name).copy()
        getattr(net, name)[at] += 1e-2
        up = loss()
        getattr(net, name)[at] = old[at]
        saved = [a.copy() for a in net._arrays()]
        net.step(window, cls, part, 1e-3)
        slope = (old[at] - getattr(net, name)[at]) / 1e-3
        net.emb, net.out, net.bias, net.out_part, net.bias_part = saved
        assert slope == pytest.approx((up - before) / 1e-2, abs=5e-2), name


# --- token ids


def ids_of(text):
    return Encoder().exact.encode(text or "", add_special_tokens=False).ids


def test_fast_and_exact_tokens_agree():
    enc = Encoder()
    texts = [*corpus(), "a  b\n\n c\t d", "it's 3.5€ we'll", "naïve œuvre ﬁn", "日本語 text", "a <|endoftext|> b", "x y\u0085z", "ALL CAPS!!", "​zero", "tab\x1fsep", "  lead", "trail  "]
    assert enc.encode_batch(texts) == [ids_of(t) for t in texts]


@pytest.mark.parametrize(("wave", "waves"), [(order.WAVE, order.WAVES), (3, 1)])
def test_training_order_round_trip(spark, docs, tmp_path, monkeypatch, wave, waves):
    monkeypatch.setattr(order, "WAVE", wave)
    monkeypatch.setattr(order, "WAVES", waves)
    path = str(tmp_path / "s")
    shards = order.write_shards(docs, path, length=64, per_shard=8)
    rows = order.read_spans(spark, path, 64, 8).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["slot"] // 8 == r["shard"] and r["byte_at"] == r["slot"] % 8 * order.stride(64)
        by[r["doc_id"]].append(r)
    every = list(order.read_from(spark, path, 0, 10**6, 64, 8))
    for i, t in enumerate(corpus()):
        ids, at = np.array([*ids_of(t), order.END], dtype="<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert (every[r["slot"]][r["offset"] : r["offset"] + r["length"]] == part).all()
            at += r["length"]
        assert at == len(ids)
    slots = {r["slot"] for r in rows}
    assert slots == set(range(len(slots))) and shards == -(-len(slots) // 8)
    rest = list(order.read_from(spark, path, 13, 5, 64, 8))
    assert len(every) == len(slots) and all((a == b).all() for a, b in zip(every[13:18], rest, strict=True))


def test_training_order_of_nothing(spark, empty, tmp_path):
    assert order.write_shards(empty, str(tmp_path / "s")) == 0
    assert order.read_spans(spark, str(tmp_path / "s")).count() == 0
    assert list(order.read_from(spark, str(tmp_path / "s"), 0, 5)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    x = order.permute(np.arange(n), n, 9)
    assert sorted(x) == list(range(n))
    assert (order.permute(x, n, 9, inverse=True) == np.arange(n)).all()


# --- packing


@pytest.mark.parametrize("targets", [None, {"src0": 0.6, "src1": 0.3, "src2": 0.05, None: 0.05}])
def test_packing(docs, targets):
    rows = packing.pack(docs, targets).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(corpus()):
        ids, at = np.array([*ids_of(t), packing.END], dtype="<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE


def test_packing_of_many_sources(spark, monkeypatch):
    """Beyond MAX_QUEUES sources, targets hold and pieces name their source."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    monkeypatch.setattr(packing.Mixture.__init__, "__defaults__", (None, 1024, 1.0))
    texts = ["one two three " * 300 for _ in range(24)]
    source = lambda i: "a" if i < 8 else "b" if i < 16 else None if i == 16 else f"s{i}"
    df = spark.createDataFrame([(i, t, source(i)) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    for targets, want in [({"a": 0.75, "b": 0.25}, {"a": 0.75, "b": 0.25}), (None, {"a": 1 / 3, "b": 1 / 3})]:
        rows = packing.pack(df, targets).collect()
        assert all(r["source"] == source(r["doc_id"]) for r in rows) and {r["doc_id"] for r in rows} == set(range(24))
        first = [r for r in rows if r["sequence_id"] < 5]
        for s, share in want.items():
            assert sum(r["length"] for r in first if r["source"] == s) / sum(r["length"] for r in first) == pytest.approx(share, abs=0.01)
    for wrong in ({"a": 0.2, "b": 0.2, "s20": 0.6}, {"missing": 1.0}):
        with pytest.raises(ValueError):
            packing.pack(df, wrong)


def test_mixture_follows_its_targets():
    totals = {"a": 500_000, "b": 300_000, "c": 40_000}
    m = packing.Mixture(totals, {"a": 0.5, "b": 0.25, "c": 0.25}, window=4096)
    place = [m.place[q] for q in "abc"]
    share = np.array([(m.served(k + 1)[0] - m.served(k)[0])[place] for k in range(m.n_windows)])
    assert share.sum(axis=0).tolist() == [500_000, 300_000, 40_000]
    assert np.abs(share.sum(axis=1)[:-1] - 4096).max() <= 3
    assert np.abs(share[:30] / share[:30].sum(axis=1, keepdims=True) - [0.5, 0.25, 0.25]).max() < 0.002
    for q in "abc":
        for token in range(0, totals[q], 9973):
            k = m.window_of(m.place[q], token)
            assert m.served(k)[0][m.place[q]] <= token < m.served(k + 1)[0][m.place[q]]


def test_mixture_tiles_the_stream():
    """Whatever the queues, shares, windows and cuts, every place of the stream is taken once."""
    r = np.random.default_rng(0)
    for trial in range(60):
        totals = {f"q{i}": int(r.integers(0, 3000)) for i in range(int(r.integers(1, 30)))} | {"last": 1}
        targets = None if trial % 3 == 0 else {q: float(r.random()) if r.random() < 0.7 else 0.0 for q in totals} | {"last": 0.1}
        m = packing.Mixture(totals, targets, window=int(r.choice([64, 300, 4096])), temper=float(r.choice([1, 0.5])))
        taken = np.zeros(m.total, dtype=int)
        for q, n in totals.items():
            at = 0
            while at < n:
                some = min(n - at, int(r.integers(1, 400)))
                for _, length, sequence, offset in packing.cut(m, q, at, some):
                    taken[sequence * 1024 + offset :][:length] += 1
                at += some
        assert (taken == 1).all()


def test_packing_query_holds_the_hot_source_back(spark):
    """Shares go by the square roots of the sources' tokens while all last."""
    df = spark.createDataFrame([(i, "one two three " * 300, "hot" if i % 10 else "small") for i in range(400)], "doc_id long, text string, source string").repartition(4)
    rows = packing.pack_stage(spark, df, "").collect()
    first = [r for r in rows if r["sequence_id"] < 2 * packing.WINDOW_SEQUENCES]  # two windows
    assert sum(r["length"] for r in first if r["source"] == "small") / sum(r["length"] for r in first) == pytest.approx(1 / (1 + 9**0.5), abs=0.01)


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


# --- near duplicates


def classes_by_brute_force(texts):
    sets, parent = {}, {i: i for i in range(len(texts))}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in enumerate(texts):
        w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in parent}


def test_near_duplicates_against_brute_force(docs):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == classes_by_brute_force(corpus())


def test_near_duplicate_chains(spark):
    """A chain of documents of which only neighbours are alike is one class, whatever the pivots."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"x{i}" if i < 18 * k else w for i, w in enumerate(base)) for k in range(12)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == classes_by_brute_force(texts) and len(set(got.values())) == 1


def test_near_duplicates_with_repeated_passages(spark):
    """What one of two near copies does not share occurs in it a hundred times."""
    texts = []
    for k in range(30):
        base = [f"a{k}x{i}" for i in range(104)]
        texts += [" ".join(base), " ".join(base + [f"b{k}x{i}" for i in range(20 if k % 3 else 30)] * 100)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == classes_by_brute_force(texts) and len(set(got.values())) == 40


def test_prob_minhash_estimates_jaccard():
    r = np.random.default_rng(8)
    a = r.integers(0, 2**62, 900).astype(np.uint64)
    x, y = a[:800], a[100:]
    h, d, c = minhash.weighted(np.concatenate([x, y]), np.repeat([0, 1], 800))
    sig = minhash.prob_minhash(h, d, 1 + np.log(c), 2, m=4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(700 / 900, abs=0.03)


def test_prob_minhash_weighs_shingles():
    """Probability Jaccard: the sum over elements of 1 / (sum over all of the larger ratio)."""
    w1, w2 = np.array([1.0, 2.0, 5.0]), np.array([4.0, 2.0, 1.0])
    want = sum(1 / np.maximum(w1 / w1[k], w2 / w2[k]).sum() for k in range(3))
    h = np.tile(np.array([11, 22, 33], dtype=np.uint64), 2)
    sig = minhash.prob_minhash(h, np.repeat([0, 1], 3), np.concatenate([w1, w2]), 2, m=8192)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


# --- language


def test_language(spark):
    r = np.random.default_rng(9)
    sets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstü"}
    make = lambda letters: " ".join("".join(r.choice(list(letters), 5)) for _ in range(30))
    rows = [(i, make(sets[y]), y, "s", 1) for i, y in enumerate(list(sets) * 60)]
    rows += [(1000, None, "aa", "s", 1), (1001, "12 !!", "aa", "s", 1), (1002, "", None, "s", 1), (1003, make(sets["aa"]), None, "s", 1), (1004, make(sets["bb"]) * 800, "bb", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("score", "rejected", "lang_pred", "language"):
        df = df.withColumn(name, F.lit("x"))
    model = langid.fit(df.where(~langid.held_out()).select("text", "lang"))
    judged = langid.predict(df, model)
    assert judged.columns[-1] == "language_"
    got = {x["doc_id"]: x for x in judged.select("doc_id", "lang", "language_.*").collect()}
    held = [x for x in got.values() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and x["doc_id"] < 1000]
    assert len(held) > 10 and all(x["lang_pred"] == x["lang"] for x in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[1000]["rejected"] and not got[1003]["rejected"]


def test_language_rejects_foreign_and_exchanged_letters(spark):
    r = np.random.default_rng(12)
    stems = {"aa": ["".join(r.choice(list("abcdefgaeiou"), 5)) for _ in range(150)], "bb": ["".join(r.choice(list("lmnoprstaeiou"), 5)) for _ in range(150)]}
    make = lambda y, n: " ".join(r.choice(stems[y], n))
    rows = [(i, make(y, int(r.integers(8, 80))), y, "s", 1) for i, y in enumerate(["aa", "bb"] * 150)]
    rows += [(1000, make("aa", 30) + " " + make("bb", 30), None, "s", 1), (1001, "xkqz vvrw pqkx zzkq jjxw qqvk " * 5, None, "s", 1), (1002, "кто это написал и зачем это здесь " * 3, None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    model = langid.fit(df.select("text", "lang"))
    got = {x["doc_id"]: x["language"] for x in langid.predict(df, model).collect()}
    assert sum(got[i]["rejected"] for i in range(300)) <= 3
    assert not got[1000]["rejected"] and got[1001]["rejected"] and got[1002]["rejected"]
    assert model.rates["clean"] <= 0.05 and model.rates["exchanged"] >= 0.95
    assert sorted(x["doc_id"] for x in langid.keep_identified(spark, df.where("doc_id >= 1000 or doc_id < 100"), "").collect() if x["doc_id"] >= 1000) == [1000]


def test_language_training_holds_few_bytes_a_character():
    """The driver trains: what it holds beyond the model is a few bytes for each character of the sample."""

    def peak(n):
        r = np.random.default_rng(3)
        texts = ["".join(r.choice(list("abcdefgh " if i % 2 else "ijklmnop "), 4000)) for i in range(n)]
        tracemalloc.start()
        langid.train(texts, ["x" if i % 2 else "y" for i in range(n)], epochs=1)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(400) - peak(100) < 15 * 300 * 4000


def test_language_prediction_by_plain_numpy(spark):
    """The folded table, histograms and classes of lengths against a prediction of one text at a time."""
    r = np.random.default_rng(13)
    texts = [" ".join(words(int(n), r)) for n in r.integers(1, 60, 60)] + [" ".join(words(12_000, r))]
    model = langid.train(texts, ["x" if i % 2 else "y" for i in range(len(texts))])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["language"] for x in langid.predict(df, model).collect()}
    for i, t in enumerate(texts):
        data = " ".join(re.sub(r"[\x00-@\[-`{-\x7f]+", " ", f" {t.lower()} ").split(" ")).encode()
        grams = [int.from_bytes(data[k : k + n], "big") * int(langid._MIX[n - 2]) % 2**32 >> (32 - langid.BITS) for n in (2, 3, 4) for k in range(len(data) - n + 1)]
        mean = model.table[grams].mean(axis=0)
        kind = len(grams).bit_length() - 1
        e = np.exp((mean[:-1] + model.bias) / model.temperature[kind])
        assert got[i]["lang_pred"] == model.labels[int(e.argmax())] and got[i]["score"] == pytest.approx(e.max() / e.sum(), abs=1e-6)
        assert got[i]["rejected"] == (mean[-1] < model.limit[kind])


def test_language_sample_counts_texts_not_copies(spark):
    """A hot text of a label and texts longer than the sample's pieces leave the label's other texts their place."""
    rows = [("hot text of a", "a")] * 3000 + [(f"own text {i} of a", "a") for i in range(50)] + [("long " * 40_000 + str(i), "b") for i in range(5)]
    sample = langid.sample_labelled(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert (sample["lang"] == "a").sum() >= 45 and (sample["lang"] == "b").sum() == 5 and sample["text"].str.len().max() <= langid.SAMPLE_CHARS


def test_language_without_labels(spark, empty):
    df = spark.createDataFrame([(1, "abc def", None, "s", 1)], DOCS)
    assert langid.predict(df, langid.fit(df.select("text", "lang"))).first()["language"]["lang_pred"] == "und"
    assert langid.predict(empty, langid.fit(empty.select("text", "lang"))).count() == 0


# --- chat


def digest(turns):
    full, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in turns:
        full.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return full.hexdigest(), loss.hexdigest(), sum(len(t) for r, t in turns if r == "assistant")


@pytest.mark.parametrize(("budget", "history"), [(60, 0), (60, 2), (100_000, 2)])
def test_chat_round_trip(spark, budget, history):
    r, rows = np.random.default_rng(10), []
    trap = "\\### Assistant: </turn> ok"
    for c in range(12):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * int(r.integers(1, 6))
        rows += [(c, t, role, " ".join(words(int(r.integers(0, 30)), r)) + (trap if r.random() < 0.3 else "")) for t, role in enumerate(roles)]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, None, "x\n### A: b</turn>\n"), (52, 0, "a:b\n", "é" * 3000), (53, 1, "user", "tie"), (53, 1, "user", "tie"), (None, 0, "assistant", "who?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(4)
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_conversations(df, budget, history)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        full, loss, n = digest([(role, text) for _, role, text in sorted(turns)])
        assert (got[c]["turns_sha256"], got[c]["loss_sha256"], got[c]["loss_chars"], got[c]["n_turns"]) == (full, loss, n, len(turns))
    assert set(got) == set(by)


def test_chat_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be kind"), *((1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x " * (60 if i % 2 else 8)) for i in range(1, 9))]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 140, 1).orderBy("window").collect()
    assert len(windows) > 2 and all("be kind" in w["formatted"] for w in windows)
    assert all(not w["fresh"][0] for w in windows[1:])
    assert any(sum(not f for f in w["fresh"]) == 2 for w in windows[1:])  # the system turn and one turn of history
    assert all(w["n_tokens"] <= 140 for w in windows)


def test_chat_budget_counts_the_formatted_text(spark):
    """Marks and escapes count: no window exceeds the budget but those whose one new turn does, with the system turn."""
    r, rows = np.random.default_rng(14), []
    for c in range(20):
        rows += [(c, t, "user" if t % 2 else "assistant", "".join(r.choice(list("<#:\\ab \n"), int(r.integers(0, 900 if t == 3 else 150))))) for t in range(12)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 2).collect()
    enc = Encoder()
    for w in windows:
        assert w["n_tokens"] == len(enc.encode(w["formatted"]))
        assert w["n_tokens"] <= 200 or sum(w["fresh"]) == len(w["fresh"]) == 1
    assert any(not all(w["fresh"]) for w in windows) and any(w["n_tokens"] > 200 for w in windows)
    assert "a:b" in chat.escape("a:b")


@pytest.mark.parametrize("text", ["", "\\", "\\\\<#", "### User: x</turn>\n", "a:b"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"(?<!\\)[<#]", chat.escape(text).replace("\\\\", ""))


# --- decontamination


def test_leaks(spark):
    item = "Anna bought 12 kg of apples and 7 kg of pears on the market in Rome before she went home again with her brother"
    other = "Bert bought 30 lb of apples and 9 lb of pears on the market in Oslo before she went home again with her brother"
    far = "some words that have nothing to do with the question that is asked above at all"
    texts = [f"noise before {item} noise after", item.lower(), item.upper(), other, far, "", None, "12 kg", item[:20], f"{far} {other} {far} {item}"]
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Too short here"), (3, None), (4, "seven words are all there is here")], "item_id long, text string")
    bench = bench.withColumn("hash", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.find_leaks(frame(spark, [*texts, "yes Seven words are all there is here."]), bench).collect()}
    assert got == {(0, 1): True, (1, 1): True, (2, 1): True, (3, 1): False, (9, 1): True, (10, 4): True}


def test_slots_must_map_one_to_one(spark):
    item = "the train number 7 leaves from a north gate and train number 8 leaves from there too"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("7", "5").replace("8", "6"), item.replace("7", "5").replace("8", "5"), item.replace("7", "8").replace("number 8 leaves from there", "number 7 leaves from there")]
    got = {r["doc_id"]: (r["exact"], r["n_windows"]) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    assert got[0] == (False, 10) and got[2] == (False, 10)
    # Two numbers of the item became one: only the plain window between them counts.
    assert got[1] == (False, 1)


def test_leaks_of_short_and_slot_dense_items(spark):
    items = ["What is 12 times 7", "How many days are in 3 weeks", " ".join(f"w{'abcdefgh'[i]} {i + 10}" for i in range(8)), "Add 1 2 3 4 5 6 7 8 9 now", "11 22 33 44 55"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = ["What is 5 times 9", "How many days are in 6 weeks", " ".join(f"w{'abcdefgh'[i]} {i + 70}" for i in range(8)), "Add 21 22 23 24 25 26 27 28 29 now", "1 2 3 4 5"]
    texts = [f"before {x} after" for x in [*other, *items, "What is 5 plus 9"]]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    # An item of slots alone has its plain form only.
    assert got == {(0, 0): False, (1, 1): False, (2, 2): False, (3, 3): False, **{(5 + i, i): True for i in range(5)}}


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark, ["a one two three four five six seven eight nine b", "x"]), bench).count() == 1


def test_leaks_of_nothing(spark, empty, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
