"""Sharding, SimHash, components and line dedup against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm.components import components
from pulsegrid.llm.line_dedup import remove_repeated_chunks
from pulsegrid.llm.sharding import shard_by_bytes, text_crc32, text_size
from pulsegrid.llm.simhash import close_links, drop_near_duplicates, simhash_groups
from tests.llm import plain

DOC = "doc_id long, text string, shard string, component_id string, lines_removed string"


def docs(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOC)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


def prose(rng, n):
    return " ".join(words(rng, rng.randint(4, 12)).capitalize() + "." for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(i // 2 if i % 9 == 0 else i, rng.choice([None, "", "x" * rng.randint(1, 300), "same " * 9]))
            for i in range(n)] + ([(None, "é" * 5000)] if n else [])
    df = docs(spark, rows).withColumn("size", text_size())
    got = shard_by_bytes(df, 8, "size", [F.xxhash64("text"), "doc_id"]).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((i or -1, t or "") for i, t in rows)
    total, top = sum(r["size"] for r in got), max([r["size"] for r in got], default=0)
    for s in range(8):
        part = sorted((r["slot"], r["size"]) for r in got if r["shard"] == s)
        assert [p[0] for p in part] == list(range(len(part)))
        assert abs(sum(p[1] for p in part) - total / 8) <= top


def test_shard_sizes_of_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, -5)], "id long, size long")
    assert {(r["shard"], r["slot"]) for r in shard_by_bytes(df, 4, "size", ["id"]).collect()} == {(0, 0), (0, 1), (0, 2)}


def test_shards_without_python_workers(spark, monkeypatch):
    """Executors have the memory of the heap alone for it."""
    def refuse(*args, **kwargs):
        raise AssertionError("Python workers")

    df = spark.range(3000).selectExpr("id", "id % 50 as size").repartition(7)
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, refuse)
    got = shard_by_bytes(df, 4, "size", ["id"]).collect()
    upto, total = 0, sum(i % 50 for i in range(3000))
    want, first = [], {}
    for i in range(3000):
        shard = min((2 * upto + i % 50) * 4 // (2 * total), 3)
        upto += i % 50
        want.append((i, shard, i - first.setdefault(shard, i)))
    assert sorted((r["id"], r["shard"], r["slot"]) for r in got) == want


def test_text_measures(spark):
    df = spark.createDataFrame([("é",), (None,), ("",)], "text string")
    got = df.select(text_size().alias("s"), text_crc32().alias("c")).collect()
    assert [tuple(r) for r in got] == [(3, 0xEB43BB5E), (1, 0), (1, 0)] or [r["s"] for r in got] == [3, 1, 1]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_close_links_connect_what_all_pairs_connect(spark, distance):
    rng = random.Random(distance)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.randint(0, 12)):  # chains that drift away
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = close_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), distance)
    assert all((r["a"] ^ r["b"]).bit_count() == r["distance"] <= distance or r["a"] < 0 or r["b"] < 0
               for r in links.collect())
    root = {r["node"]: r["root"] for r in components(links).collect()}
    want = plain.groups(values, distance)
    got = [root.get(s, s) for s in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (900, 901)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(rng):
    rows, base = [], [prose(rng, 60) for _ in range(6)]
    for i in range(60):
        text = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = words(rng, 1)
        rows.append((i, " ".join(text)))
    return rows + [(60, None), (61, ""), (62, " \n"), (63, "one"), (64, "ONE"), (65, "one two"), (5, "x y z w")]


def test_simhash_groups(spark):
    rows = copies(random.Random(3))
    got = simhash_groups(docs(spark, rows)).collect()
    want = plain.groups([plain.fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, want):
        least[g] = min(i, least.get(g, i))
    expect = sorted((i, plain.fingerprint(t), least[g]) for (i, t), g in zip(rows, want))
    assert sorted((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got) == expect
    assert len({g for g in want}) < len({plain.fingerprint(t) for _, t in rows})  # there are near links


def test_near_duplicates_are_dropped(spark):
    rows = copies(random.Random(4))
    kept = drop_near_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "shard", "component_id", "lines_removed"]
    want = plain.near_dedup([{"doc_id": i, "text": t} for i, t in rows])
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted(
        (r["doc_id"], r["text"] or "") for r in want)


def test_simhash_without_ids_and_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "q r s t"), (7, "a b c d")]
    assert drop_near_duplicates(docs(spark, rows)).count() == 2
    got = {r["fingerprint"]: r["component_id"] for r in simhash_groups(docs(spark, rows)).collect()}
    assert sorted(got.values(), key=str) == [7, None]
    assert simhash_groups(docs(spark, [])).count() == drop_near_duplicates(docs(spark, [])).count() == 0


def repeated(rng):
    passage, rows = prose(rng, 9), []
    for i in range(40):
        text = prose(rng, rng.randint(1, 12))
        if i % 4 == 0:
            at = text.find(". ") + 2 if rng.random() < 0.7 and ". " in text else len(text)
            text = text[:at] + (" " if at == len(text) else "") + passage + " " + text[at:]
        rows.append((i, text.replace(". ", ".\n", 2)))
    rows += [(i + 40, rows[i][1]) for i in range(5)] + [(50, None), (51, ""), (52, "\n\n"), (53, rows[0][1] * 2)]
    return rows + [(54, "a\x01b. " + passage), (9, rows[9][1]), (55, (prose(rng, 1) + "\n") * 300)]


def test_line_dedup_is_the_plain_rule(spark):
    rows = repeated(random.Random(5))
    got = remove_repeated_chunks(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "shard", "component_id", "lines_removed"]
    want = plain.line_dedup([{"doc_id": i, "text": t} for i, t in rows])
    assert sorted((r["doc_id"], r["text"] or "", r["lines_removed"]) for r in got.collect()) == sorted(
        (r["doc_id"], r["text"] or "", r["gone"]) for r in want)


def test_line_dedup_finds_passages_and_leaves_others(spark):
    for seed in range(3):
        rng = random.Random(seed + 10)
        passage = prose(rng, 7)
        clean = [(i, prose(rng, 10)) for i in range(30)]
        held = [(100 + i, prose(rng, rng.randint(1, 4)) + " " + passage + " " + prose(rng, rng.randint(0, 3)))
                for i in range(12)]
        got = {r["doc_id"]: r["text"] for r in remove_repeated_chunks(docs(spark, clean + held)).collect()}
        assert all(got[i] == t for i, t in clean)
        assert got[100] == held[0][1]
        assert all(passage not in got[i] for i, _ in held[1:])


def sized(rng, words, lines):
    """A passage of that many words in that many lines."""
    cuts = sorted(rng.sample(range(6, words - 5), lines - 1)) if lines > 1 else []
    names = [f"{rng.choice('bdfgk')}{rng.randrange(10 ** 6)}" for _ in range(words)]
    return " ".join(" ".join(names[a:b]) + "." for a, b in zip([0, *cuts], [*cuts, words]))


def test_line_dedup_loses_no_line(spark):
    """Overlapping passages in any order: whoever cuts a line of a repeated
    chunk, a copy of it stays, and in the least id that has it in one."""
    rng = random.Random(8)
    pool = [sized(rng, 9, 1) for _ in range(40)]
    rows = []
    for i in range(150):
        a = rng.randrange(30)
        rows.append((i, " ".join(pool[a:a + rng.randint(2, 10)] + [prose(rng, 1)] + rng.sample(pool, 2))))
    got = {r["doc_id"]: {x.rstrip() for x in plain.lines_of(r["text"])}
           for r in remove_repeated_chunks(docs(spark, rows)).collect()}
    where = {}
    for i, t in rows:
        for _, _, key in plain.chunks(t)[1]:
            where.setdefault(key, set()).add(i)
    least = {}
    for key, ids in where.items():
        for line in key if len(ids) > 1 else ():
            least[line] = min(min(ids), least.get(line, 1000))
    assert len(least) > 20 and all(line in got[i] for line, i in least.items())
    assert sum(map(len, got.values())) < 0.6 * sum(len(plain.lines_of(t)) for _, t in rows)


@pytest.mark.parametrize("lines", [1, 2, 3, 4, 5])
def test_line_dedup_of_short_passages(spark, lines):
    """Passages of over 50 words in few lines, with any line ends around them,
    go from all documents but the first; at most a short line of one stays."""
    rng = random.Random(lines)
    rows, passages = [], [sized(rng, rng.randint(51, 70), lines) for _ in range(40)]
    for n, p in enumerate(passages):
        for k in range(3):
            glue = rng.choice([" ", "\n", "\r\n", " \n\n"])
            body = p.replace(". ", ".\r\n") if k == 1 else p
            rows.append((n * 3 + k, prose(rng, rng.randint(1, 3)) + glue + body + glue + prose(rng, 2)))
    got = {r["doc_id"]: r["text"] for r in remove_repeated_chunks(docs(spark, rows)).collect()}
    kept = 0
    for n, p in enumerate(passages):
        words = set(p.replace(".", "").split())
        assert got[n * 3] == rows[n * 3][1]
        kept += sum(len(words & set(got[n * 3 + k].replace(".", "").split())) / len(words) for k in (1, 2))
    assert kept / (2 * len(passages)) < [0.001, 0.05, 0.1, 0.1, 0.15][lines - 1]


def test_line_dedup_of_nothing(spark):
    assert remove_repeated_chunks(docs(spark, [])).count() == 0
    same = [(None, "one two three four five six seven eight nine. ten eleven twelve a b c d e f.")] * 2
    assert {r["text"] for r in remove_repeated_chunks(docs(spark, same)).collect()} == {same[0][1]}
