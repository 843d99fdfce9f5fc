"""Filter audit, hard negatives and quality rules against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import hard_negatives as H
from pulsegrid.llm import quality_rules as Q
from pulsegrid.llm.filter_audit import audit, audit_documents, count_copies, removal_steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------ filter audit

@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_removal_steps(n):
    orders, steps = removal_steps(n)
    assert sorted(map(tuple, orders)) == sorted(permutations(range(n)))
    for mask in range(1 << n):
        for o, order in enumerate(orders):
            gone = [i + 1 for i, f in enumerate(order) if mask >> f & 1]
            assert steps[mask, o] == (gone[0] if gone else n + 1)


def plain_audit(rows, names, weights):
    """rows: (part, set of failed names, {weight: bool})"""
    out = {}
    for part in {p for p, _, _ in rows}:
        shapley, lines = Counter(), []
        for order in permutations(names):
            left = [(f, w) for p, f, w in rows if p == part]
            everyone = left
            for step, name in enumerate(order, 1):
                here = [(f, w) for f, w in left if name in f]
                left = [(f, w) for f, w in left if name not in f]
                shapley[name] += len(here)
                lines.append((("".join(order), step), name, [
                    len(left), len(here), sum(name in f for f, _ in everyone) - len(here),
                    sum(f == {name} for f, _ in everyone)] + [sum(w[x] for _, w in here) for x in weights]))
        for key, name, values in lines:
            out[(part, *key)] = (*values, shapley[name])
    return out


def plain_documents(docs, labels):
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and (s or "") == t for j, s, _ in docs):
            f.add("E")
        rows.append((lang or "", f, {"good": any(j == i and q == 1 for j, q, _ in labels if i is not None),
                                     "toxic": any(j == i and x == 1 for j, _, x in labels if i is not None)}))
    return plain_audit(rows, "ABCDE", ["good", "toxic"])


def audit_cases():
    rng = random.Random(5)
    texts = [None, "", "Ab", "x # y", "É ü x\u0085z", " ".join(f"w{i}" for i in range(120)),
             " ".join(f"w{i % 60}" for i in range(120)), "A" * 30 + " " + " ".join(f"v{i}" for i in range(99)),
             "word " * 30000, "A\tB\x0bC\x1cD"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [docs[3], (7, texts[1], "de"), (None, texts[2], "en"), (None, texts[2], "en"), (3, "Ab", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return docs, labels


def audited(spark, docs, labels, extra=""):
    d = spark.createDataFrame([(*r, "m") for r in docs], "doc_id long, text string, lang string, mask string")
    got = audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in got.collect()}


def test_audit_documents(spark):
    docs, labels = audit_cases()
    got = audited(spark, docs, labels)
    assert got == plain_documents(docs, labels)
    assert len(got) == 600 * 3


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


def test_audit_any_filters(spark):
    rows = [("p", 0, 3, 1), ("p", 5, 2, 0), ("p", 5, 1, 1), (None, 2, 4, 4), (None, None, 1, None)]
    got = audit(spark.createDataFrame(rows, "part string, mask int, n long, good long"), "xyz", ["good"]).collect()
    want = plain_audit([(p, {f for i, f in enumerate("xyz") if (m or 0) >> i & 1}, {"good": j < (g or 0)})
                        for p, m, n, g in rows for j in range(n)], "xyz", ["good"])
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley)
            for r in got} == want
    with pytest.raises(ValueError):
        audit(spark.createDataFrame(rows, "part string, mask int, n long, good long"), "abcdefgh", [])


def test_copies_of_a_hot_text(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(
        F.col("id").cast("string")).alias("digest"), F.lit(2).alias("mask"), (F.col("id") % 2).alias("n"))
    got = {(r[0], r[1]): r[2] for r in count_copies(rows.select("doc_id", "digest", "mask", F.col("n").alias("half")), 8)
           .groupBy("half", "mask").agg(F.sum("n")).collect()}
    assert got == {(0, 2): 6667, (1, 2): 6667, (0, 10): 3333, (1, 10): 3333}


# ------------------------------------------------------------ hard negatives

def test_spanning_tree_is_least():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 30):
        v = rng.integers(-20, 20, (n, 3))
        v[n // 2:] = v[:n - n // 2]  # ties and equal points
        order, parent, depth, edge = H.spanning_tree(v)
        assert sorted(order) == list(range(n)) and parent[0] == -1
        assert all(0 <= parent[i] < i and depth[i] == depth[parent[i]] + 1 for i in range(1, n))
        away = np.sqrt(((v[:, None] - v[None]).astype(float) ** 2).sum(axis=2))
        joined, total = {0}, 0.0
        while len(joined) < n:  # Prim on the full matrix
            a, b = min(((i, j) for i in joined for j in range(n) if j not in joined), key=lambda p: away[p])
            joined.add(b)
            total += away[a, b]
        assert np.isclose(edge.sum(), total)


def plain_negatives(rows, is_anchor, k=5, low=80, high=100):
    out = []
    anchors = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    rows = [r for r in rows if None not in r]
    for a, (label, v) in anchors.items():
        def first(where):
            score = {}
            for i, other, w in rows:
                s = sum(x * y for x, y in zip(v, w))
                if len(v) == len(w) and where(i, other, s):
                    score[i] = max(score.get(i, s), s)
            return sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]
        for p, s in first(lambda i, other, _: other == label and i != a):
            near = first(lambda i, other, t: other != label and low * s <= 100 * t <= high * s)
            out += [(a, p, rank, n, s, t) for rank, (n, t) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, modulo):
    df = spark.createDataFrame([(*r, "r") for r in rows], "vec_id long, label long, vector array<long>, rank string")
    return sorted(tuple(r) for r in H.hard_negatives(df.repartition(4), F.col("vec_id") % modulo == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "GROUP", 17)
    monkeypatch.setattr(H, "PAIRS", 11)
    rng = np.random.default_rng(3)
    centres = rng.integers(-6, 7, (6, 5))
    rows = [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + rng.integers(-1, 2, 5)).tolist())
            for i in range(300)]
    rows += [(i, 1, rows[20][2]) for i in range(300, 340)]               # ties
    rows += [(40, 2, [9, 9, 9, 9, 9]), (40, 2, [9, 9, 9, 9, 9]), (43, 1, [1, 2, 3, 4, 5])]  # repeated ids
    rows += [(400, 0, [0] * 5), (420, 3, [5, 5]), (421, 2, [4, 5]), (422, 3, [4, 4]), (440, 1, []), (441, 1, [])]
    rows += [(None, 1, [1] * 5), (460, None, [1] * 5), (480, 1, None)]
    assert mined(spark, rows, 20) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_hard_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.integers(-1 << 29, 1 << 29, 4).tolist()) for i in range(60)]  # sums beyond 2^53
    assert mined(spark, rows, 10) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 1, [1]), (2, 2, [1])], 10) == []            # no anchor
    assert mined(spark, [(10, 1, [1]), (2, 2, [1])], 10) == []           # no positive


def test_pruned_scores_are_few_on_clusters():
    """Near anchors: the bounds leave few candidates to score."""
    import pandas as pd
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1000, (8, 16))
    v = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 5, (400, 16))).astype(np.int64)
    block = pd.DataFrame({"block": 0, "id": np.arange(40) * 10, "label": np.repeat(np.arange(8), 5), "vector": list(v[::10])})
    tree = H.Tree(H._plant(block))
    full = tree.vectors @ v.T
    low = np.partition(full, -6, axis=1)[:, -6].astype(float)
    met = np.zeros(full.shape, bool)
    for r, c, s in tree.descend(v, lambda p: np.ones((len(p), len(v)), bool), low, np.full(40, np.inf)):
        assert (s == full[r, c]).all()
        met[r, c] = True
    assert met[full >= low[:, None]].all() and met.mean() < 0.3


def test_quantised(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf")],), ([],), ([1e300],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(H.quantised("v")).collect()]
    assert got == [[128, -1], None, None, None, None, [], [(1 << 63) - 1]]


# ------------------------------------------------------------ quality rules

def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            len(lines), len(re.findall("[A-Z]", t)), sum(a == b for a, b in zip(w, w[1:])))


def rule_texts():
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a", "ä € 𝄞 x", "#*$%&|<> A<b>", "one\ntwo\none\n\n \r\n\r\none ", "x " * 7, "x " * 8,
             "x " * 9, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "AB CD " * 40, "word " * 50000,
             "a\x1cb c d\x0be\x0cf"]
    for _ in range(60):
        words = [rng.choice("abc") if rng.random() < 0.5 else rng.choice(["dd", "É", "|", "Zz"]) for _ in range(rng.randint(0, 90))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return texts


@pytest.mark.parametrize("group", [1 << 20, 50])
def test_measures(spark, group, monkeypatch):
    monkeypatch.setattr(Q, "GROUP", group)
    texts = rule_texts()
    df = spark.createDataFrame([(i, t, "q", "z") for i, t in enumerate(texts)],
                               "doc_id long, text string, failed_bits string, n_words string")
    lines = Q.ledger(df).orderBy("doc_id").collect()
    assert [tuple(r[m] for m in Q.MEASURES.fieldNames()) for r in lines] == [plain_measures(t) for t in texts]
    for r in lines:
        values = {m: r[m] for m in Q.MEASURES.fieldNames()}
        assert r.failed_bits == sum(eval(rule, {}, values) << i for i, rule in enumerate(Q.RULES.values()))


def test_policies_and_ablations(spark):
    rng = random.Random(2)
    masks = [rng.choice([0, 0, rng.randrange(256)]) for _ in range(500)]
    lines = spark.createDataFrame([(m,) for m in masks], "failed_bits long")

    def keeps(p, m, without=0):
        m &= ~without
        return not m & Q.bits(p.rules) and bin(m & Q.bits(p.counted)).count("1") <= p.allowed

    for p in Q.POLICIES:
        assert [r[0] for r in lines.select(Q.kept(p)).collect()] == [keeps(p, m) for m in masks]
    got = {(r.policy, r.version): (r.rows, r.kept, r.dropped, r.failed_any) for r in Q.apply_policies(lines).collect()}
    for p in Q.POLICIES:
        out = [m for m in masks if not keeps(p, m)]
        assert got[(p.name, p.version)] == (500, 500 - len(out), len(out), int(np.bitwise_or.reduce(out)))
    for r in Q.ablations(lines).collect():
        p = next(p for p in Q.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit = Q.bits([r.rule])
        assert (r.failing, r.kept, r.kept_without) == (sum(m & bit > 0 for m in masks), sum(keeps(p, m) for m in masks),
                                                       sum(keeps(p, m, bit) for m in masks))


def test_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.ledger(empty).count() == 0
    assert Q.apply_policies(Q.ledger(empty)).count() == 0


def test_rules_agree_with_labels(spark, sf01):
    """Junk of the test table goes, the rest stays (short texts aside, which
    the base rule drops whatever their label)."""
    from pulsegrid.llm.queries import op13_quality_rules
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    got = op13_quality_rules(spark, sf01).join(labels, "doc_id").where("not base_failed")
    assert got.where("kept <> (quality = 1)").count() == 0
