"""Neighbours, language model, toxicity and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import hmm, neighbours, toxicity
from pulsegrid.llm.common import crc_bucket
from tests.llm import plain


# ------------------------------------------------------------ neighbours

def exact(rows, k, asks):
    ok = {i: np.array(v, float) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if asks(q):
            found = sorted((-sum(a * b for a, b in zip(ok[q].tolist(), v.tolist())), i) for i, v in ok.items()
                           if i != q and len(v) == len(ok[q]))
            out[q] = [(i, pytest.approx(-s, abs=1e-12)) for s, i in found[:k]]
    return {q: v for q, v in out.items() if v}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    f = lambda n: rng.standard_normal(n).astype(np.float32).tolist()
    rows = [(i, f(8)) for i in range(60)] + [(60 + i, [1.0] * 8) for i in range(40)]
    rows += [(200 + i, f(3)) for i in range(4)] + [(300, f(5))]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [None] + [1.0] * 7), (480, [float("nan")] * 8),
             (500, [float("inf")] * 8), (None, f(8))]
    got = neighbours.nearest(vectors(spark, rows), 20, is_query=F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(got):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found == exact(rows, 20, lambda q: q % 20 == 0)


def test_neighbours_of_nothing_and_of_repeats(spark):
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, [(1, [1.0])])).count() == 0
    twice = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = sorted(tuple(r) for r in neighbours.nearest(vectors(spark, twice)).collect())
    assert got == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]


def test_graph_search_recall_beyond_one_block(spark, monkeypatch):
    for name, value in (("BLOCK", 128), ("DEGREE", 16), ("BEAM", 64), ("STEP", 16), ("QUERY_BLOCK", 30)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.random.default_rng(3).standard_normal((1500, 16)).astype(np.float32)
    x *= np.random.default_rng(4).uniform(0.5, 2, (1500, 1)).astype(np.float32)  # of different lengths
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest(vectors(spark, rows), 10, is_query=F.col("vec_id") % 20 == 0).collect()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    hits = sum(r["vec_id"] in np.argsort(-s[r["query_id"]])[:10] for r in got)
    assert len(got) == 750 and hits / 750 >= 0.9


@pytest.mark.parametrize("longest", [1, 1e6])
def test_graph_recall_of_a_poor_first_graph_and_beside_a_long_vector(spark, monkeypatch, longest):
    for name, value in (("BLOCK", 32), ("PASSES", 2), ("DEGREE", 12)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.random.default_rng(5).standard_normal((2000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= longest
    nodes = neighbours._vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                                      "node long, vector array<float>"))
    graph = neighbours._graph(nodes, len(x)).where("node <> 7 and other <> 7").collect()
    s = x.astype(float) @ x.astype(float).T
    s[:, 7] = -np.inf
    np.fill_diagonal(s, -np.inf)
    near = [set(np.argsort(-row)[:10].tolist()) for row in s]
    hits = sum(r["other"] in near[r["node"]] for r in graph)
    assert hits / 10 / (len(x) - 1) >= 0.9


# ------------------------------------------------------------ language model

def small_model(rng):
    model = hmm.first_model(np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    ratio = rng.uniform(0.2, 3, model.ratio.shape)
    moves = rng.uniform(0.1, 1, model.moves.shape)
    start = rng.uniform(0.1, 1, hmm.STATES)
    return hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), ratio)


def test_forward_is_the_sum_over_all_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    rng = np.random.default_rng(0)
    model = small_model(rng)
    sequences = [np.array(s, np.uint16) for s in ([5], [1, 2, 3, 4, 1, 1], [7, 7], list(range(9)))]
    for s, got in zip(sequences, hmm.log_ratios(sequences, model)):
        total = 0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.ratio[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.moves[path[t - 1], path[t]] * model.ratio[s[t], path[t]]
            total += p
        assert got == pytest.approx(np.log10(total))
    long = rng.integers(0, 50, 3000).astype(np.uint16)
    assert np.isfinite(hmm.log_ratios([long], model)[0])


def test_expected_counts_are_those_of_all_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    model = small_model(np.random.default_rng(2))
    sequences = [np.array([1, 2, 1, 3], np.uint16), np.array([3, 3], np.uint16)]
    totals = {"start": np.zeros(2), "moves": np.zeros((2, 2)), "emit": np.zeros((hmm.CLASSES, 2))}
    hmm.expected_counts(sequences, model, totals)
    start, moves, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2))
    for s in sequences:
        paths = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.ratio[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.moves[path[t - 1], path[t]] * model.ratio[s[t], path[t]]
            paths[path] = p
        z = sum(paths.values())
        for path, p in paths.items():
            start[path[0]] += p / z
            for t, state in enumerate(path):
                emit[s[t], state] += p / z
                if t:
                    moves[path[t - 1], state] += p / z
    np.testing.assert_allclose(totals["start"], start, rtol=1e-4)
    np.testing.assert_allclose(totals["moves"], moves, rtol=1e-4)
    np.testing.assert_allclose(totals["emit"], emit, rtol=1e-4, atol=1e-6)


def test_model_beats_the_base_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LOOKUP_WORDS", 60)  # the others are joined
    rng = random.Random(1)
    tongues = [[a + b + c for b in "aeiou" for c in "nmrst"] for a in "bdf"]
    texts = [None, "", "Unseen WORDS only", "\t\n"] + [
        " ".join(rng.choice(rng.choice(tongues[i % 3:i % 3 + 1])) for _ in range(rng.randint(1, 80))) for i in range(300)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "ban", 1.0)],
                               "doc_id long, text string, score double")
    held = crc_bucket(F.col("doc_id"), 10) == 0
    got = hmm.score(df, ~held).withColumn("held", held).collect()
    assert len(got) == len(texts) + 1
    import math
    import zlib
    from collections import Counter
    count = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            count.update([w.encode() for w in plain.BLANK.findall(plain.lower(t))] + [None])
    n, v = sum(count.values()), len(count)
    base = score = 0
    for r in got:
        words = [w.encode() for w in plain.BLANK.findall(plain.lower(texts[r["doc_id"]] if r["doc_id"] is not None else "ban"))]
        words.append(None)
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(want) and np.isfinite(r["score"])
        if r["held"] and r["n_tokens"] > 5:
            base, score = base + r["base_score"], score + r["score"]
    assert score > 0.9 * base  # both negative: closer to zero by a tenth at least


def test_language_model_without_training_rows(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    got = hmm.score(df, F.lit(False)).collect()
    assert all(np.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    assert hmm.score(df.where("false"), F.lit(True)).count() == 0


# ------------------------------------------------------------ toxicity

def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    model = {"moves": np.exp(rng.standard_normal((2, 2)))}
    sequences = [rng.standard_normal(n) for n in (1, 5, 9, 0, 3)]
    for u, got in zip(sequences, toxicity.marginals(sequences, model)):
        weights = {}
        for path in itertools.product((0, 1), repeat=len(u)):
            w = np.exp(sum(x * y for x, y in zip(u, path)))
            for a, b in zip(path, path[1:]):
                w *= model["moves"][a, b]
            weights[path] = w
        z = sum(weights.values())
        want = [sum(w for p, w in weights.items() if p[t]) / z for t in range(len(u))]
        np.testing.assert_allclose(got, want)


def test_toxic_texts_are_told_from_others(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["wretch", "vermin", "Fool"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 5 == 0)
        for _ in range(rng.randint(1, 3) * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", "s", "!", ","])
        rows.append((i, "É, " + " ".join(text), 0.0))
        labels += [(i, 1, toxic)] if i < 300 else []
    rows += [(900, None, 0.0), (901, "", 0.0), (None, "vermin vermin wretch", 0.0), (902, "?!", 0.0)]
    labels += [(None, 1, 1), (3, None, None), (7, 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    right = [(got[i]["score"] >= 0.5) == (i % 5 == 0) for i in range(300, 400)]
    assert sum(right) >= 97
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] < 0.5 <= got[None]["score"]
    for i, text, _ in rows[:300]:
        for s in got[i]["toxic_spans"]:
            assert any(b.lower() in text[s["start"]:s["end"]].lower() for b in bad)
    kept = toxicity.drop_toxic(docs, table, None)
    assert kept.columns == docs.columns
    assert {r["score"] for r in kept.collect()} == {0.0}  # a column of the input, not the operator's
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(
        i for i in got if i is not None and got[i]["score"] < 0.5)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_toxicity_with_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


# ------------------------------------------------------------ pipeline

def test_stages_against_plain_versions(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "bpe encoding and decoding"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    def rows(df):
        assert df.columns == docs.columns
        return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])

    def table(dicts):
        return spark.createDataFrame(dicts, docs.schema)

    given = rows(docs)
    kept = rows(stages[0](spark, docs, sf001))
    assert all(r in given for r in kept) and 0 < len(kept) < len(given)
    after = plain.line_dedup(kept)
    lines = rows(stages[1](spark, table(kept), sf001))
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in lines] == [
        (r["doc_id"], r["text"], len(r["text"])) for r in after]
    near = rows(stages[2](spark, table(lines), sf001))
    assert near == plain.near_dedup(lines)
    clean = rows(stages[3](spark, table(near), sf001))
    found = plain.contamination([r["text"] for r in near], items)
    want = [plain.cut_out(r["text"], hit) for r, (_, hit, _) in zip(near, found)]
    assert [r["text"] for r in clean] == want
    tokens = sorted(tuple(r) for r in stages[4](spark, table(clean), sf001).collect())
    assert tokens == sorted((r["doc_id"], *plain.digests(r["text"])) for r in clean)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf001).collect()) == tokens


def test_stages_of_odd_documents(spark, sf001):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30000, "en", "s", 1),
                                 (3, "word " * 30000, "en", "s", 1), (None, "x y z", None, "s", 5)], schema)
    for df in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            n, df = df.count(), stage(spark, df, sf001)
            assert df.count() <= n


def test_all_words_have_a_probability_of_one(spark):
    """The known words and one unknown, of a class drawn evenly, in any state."""
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i}") for i in range(40)], "doc_id long, text string")
    counts = hmm.word_counts(docs)
    vocab = hmm.vocabulary(counts, 40)
    mass = hmm.class_masses(counts, vocab)
    model = hmm.first_model(mass)
    own = {w: i for i, w in enumerate(vocab.words[:hmm.OWN_CLASSES])}
    total = np.zeros(hmm.STATES)
    for r in counts.collect():
        total += (r.n + hmm.ALPHA) / vocab.mass * model.ratio[own.get(bytes(r.word), hmm.shared_class(bytes(r.word)))]
    total += (vocab.ends + hmm.ALPHA) / vocab.mass * model.ratio[hmm.END]
    total += hmm.ALPHA / vocab.mass * model.ratio[hmm.OWN_CLASSES:hmm.END].mean(axis=0)
    assert np.allclose(total, 1, atol=1e-9)
