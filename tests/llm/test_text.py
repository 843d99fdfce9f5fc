"""Decontamination, tokenizing, PII, HTML: against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bpe
from pulsegrid.llm.decontaminate import FMIndex, find_contamination, hit_words, remove_contamination
from pulsegrid.llm.private_data import BASE, KINDS, find_private_data, reliabilities, span_text
from pulsegrid.llm.queries import VOCABULARY, op6_pii
from pulsegrid.llm.style_tree import Page, extract_main_text, host_of, main_text
from tests.llm import plain


# ------------------------------------------------------------ decontamination

@pytest.mark.parametrize("seed", range(4))
def test_fm_index_finds_every_place(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 4 + seed * 5, rng.integers(1, 30)) for _ in range(20)] + [np.ones(40, int)]
    symbols = np.concatenate([np.append(r, 0) for r in runs])
    index = FMIndex(symbols)
    for n in (1, 2, 3, 7):
        phrases = rng.integers(1, 25, (40, n))
        phrases[::2] = [symbols[i:i + n] for i in rng.integers(0, len(symbols) - n, 20)]
        phrases = phrases[(phrases > 0).all(axis=1)]
        low, high = index.search(phrases, np.full(len(phrases), n))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(symbols) - n + 1) if (symbols[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def benchmark(spark, rng):
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß9", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)))
             for i, n in enumerate([30, 25, 14, 10, 9, 3, 60])]
    items += [(7, None), (8, ""), (9, "?!"), (10, items[0][1].upper()), (None, items[2][1] + " tail"), (11, items[5][1])]
    texts = [None, "", "...", items[0][1], f"a {items[1][1]}, b. {items[1][1].upper()}!"]
    for _ in range(60):
        text = [rng.choice(vocabulary + ["out"]) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.5:
            words = (rng.choice(items[:7])[1]).split()
            a = rng.randrange(len(words))
            at = rng.randint(0, len(text))
            text[at:at] = words[a:a + rng.randint(1, 25)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(text))
    docs = spark.createDataFrame([(i, t, "n", "h") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_words string, item string")
    return docs, texts, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("block", [16 << 20, 150])
def test_contamination(spark, block):
    docs, texts, bench, items = benchmark(spark, random.Random(1))
    got = find_contamination(docs, bench, block_bytes=block).select(
        "doc_id", "n_words", hit_words(F.col("hit_spans")).alias("hit"), "item_ids", "hit_spans", "item").collect()
    want = plain.contamination(texts, items)
    assert any(h for _, h, _ in want) and not all(h for _, h, _ in want)
    for r in got:
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["hit"], set(r["item_ids"]), r["item"]) == (n, len(hit), ids, "h")
        assert {i for s in r["hit_spans"] for i in range(s["start"], s["end"])} == hit
        assert all(a["end"] < b["start"] for a, b in zip(r["hit_spans"], r["hit_spans"][1:]))


def test_contamination_is_cut_out(spark):
    docs, texts, bench, items = benchmark(spark, random.Random(2))
    got = remove_contamination(docs, bench)
    assert got.columns == docs.columns
    want = [plain.cut_out(t, hit) for t, (_, hit, _) in zip(texts, plain.contamination(texts, items))]
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == want
    assert {r["n_words"] for r in got.collect()} == {"n"}  # a column of the input, not the operator's


def test_contamination_of_and_by_nothing(spark):
    docs, texts, bench, _ = benchmark(spark, random.Random(3))
    none = find_contamination(docs, bench.where("false")).where("size(hit_spans) > 0 or size(item_ids) > 0")
    assert none.count() == 0
    assert find_contamination(docs.where("false"), bench).count() == 0
    assert remove_contamination(docs.where("false"), bench).count() == 0


# ------------------------------------------------------------ BPE

TEXTS = [None, "", " ", "\n\n  \n x", "It's we'll 'S DON'T", "a<|endoftext|>b <|endoftext|>", "naïve Ünï 123 ½²",
         "日本語 текст עברית 👩‍👩‍👧 🇩🇪", "tab\tnb sp em \x1c\x85 end", "x" * 5000, "ab " * 4000, "İ ﬁ",
         "á è", "  leading", "trailing  ", "1 22 333 4444,5.6", "\x00\x01", "#$%^ &&& ***"]


def test_tokens_are_those_of_the_library(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, token_ids int")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(df, VOCABULARY, ["doc_id"]).collect()}
    assert got == {i: plain.digests(t) for i, t in enumerate(TEXTS * 3)}
    whole = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).collect()
    assert [r["decoded"] for r in sorted(whole)] == [t or "" for t in TEXTS * 3]
    assert bpe.digests(df.where("false"), VOCABULARY, ["doc_id"]).count() == 0


def test_word_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 3)
    with open(VOCABULARY, encoding="utf-8") as f:
        table = bpe.WordTable(f.read())
    for text in [t for t in TEXTS if t]:
        ids, _ = bpe.gather(*(lambda which: (table.ids, table.at, which))(table.numbers(table.split(text))))
        assert ids.tolist() == plain.TOKENIZER.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_bytes_and_nulls(spark):
    lone = plain.TOKENIZER.encode("é").ids[:1]
    half = [i for i, p in enumerate(bpe.pieces(VOCABULARY)) if p == b"\xc3"]
    df = spark.createDataFrame([(lone,), (half,), ([],), (None,)], "token_ids array<int>")
    got = [r["decoded"] for r in bpe.decode(df, VOCABULARY).collect()]
    assert got == [plain.TOKENIZER.decode(lone), "�", "", ""]


# ------------------------------------------------------------ personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if p.isdigit()),
                    "card": 13 <= len(digits) <= 19 and sum(double) % 10 == 0,
                    "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def private_texts():
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f.g", "é@x.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.255",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (706) 555-3138", "+49-(0)30.123456",
            "+1", "12 34", "joe [at] mail [dot] com", "706 555 3138", "1[.]2[.]3[.]4", "word", "Zürich", "👍", "\n", ".", ",",
            "call", "email:", "%+-", "9" * 40, "1 " * 30, "+" + "1" * 20]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    return [None, "", "a." * 20000 + "@", "1 2-3 " * 5000, "1.2.3." * 3000, "a@" + "b." * 5000 + "c"] + texts


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = private_texts()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, private_data string")
    got = find_private_data(df)
    assert got.columns == ["doc_id", "text", "private_data"]
    for r in got.collect():
        spans = r["private_data"]
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == plain_spans(texts[r["doc_id"]])
        keys = [(KINDS.index(s["kind"]), s["start"]) for s in spans]
        assert keys == sorted(keys)
        base = [(s["start"], s["end"]) for s in spans if s["base"]]
        assert all(s["end"] <= a or s["start"] >= b for s in spans if not s["base"] for a, b in base)


def test_private_data_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_private_data(df).count() == 0
    one = spark.createDataFrame([(1, "nothing here"), (None, None)], df.schema)
    assert [r["private_data"] for r in find_private_data(one).collect()] == [[], []]
    assert one.select(span_text(F.expr("cast(array() as array<struct<kind: string, start: long, end: long>>)")).alias("t")
                      ).first()["t"] == ""


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    true = rng.random(20000) < 0.4
    right = [0.95, 0.8, 0.9, 0.7, 0.85]
    votes = np.array([np.where(rng.random(len(true)) < p, true, ~true) for p in right]).T.astype(int)
    votes = [tuple(None if rng.random() < 0.2 and j == 2 else int(v) for j, v in enumerate(row)) for row in votes]
    counts = {}
    for v in votes:
        counts["ip", v] = counts.get(("ip", v), 0) + 1
    belief = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    guess = np.array([belief["ip", v] >= 0.5 for v in votes])
    assert (guess == true).mean() > 0.96
    assert reliabilities([]) == {}


# ------------------------------------------------------------ HTML

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="x"><header><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy!</div><div id="cookie-notice">We use cookies</div><article><h1>A &amp;amp; B</h1>
<p>One<br>two &nbsp; three<p><b>Bold.<br><p>next <i>in</i>line 1 < 2 &lt;b&gt; &am</p><form><input value=">">Name</form>
<aside>Side</aside><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><section class="comments"><p>Nice!</p></section>
<div style="display:none">hid</div><noscript>js</noscript></article><div class="sidebar">S</div><footer>F</footer></body></html>"""


def test_main_text_of_an_article():
    assert main_text(ARTICLE.encode(), None).split("\n") == [
        "A &amp; B", "One two three", "Bold.", "next inline 1 < 2 <b> &am", "x", "y", "c1", "c2"]


@pytest.mark.parametrize("cut", range(0, len(ARTICLE), 13))
def test_pages_cut_anywhere(cut):
    text = main_text(ARTICLE[:cut].encode(), None)
    assert "\n" not in text or all(line == " ".join(line.split()) for line in text.split("\n"))
    assert "no" not in text.split("\n") and "var" not in text


def test_site_tree_removes_what_a_site_repeats(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, want = [], {}
    for i in range(60):
        own = [" ".join(word() for _ in range(8)) for _ in range(rng.randint(1, 5))]
        html = ("<html><body><div class='top'><span>Start</span> <span>Shop</span></div><div class='body'>"
                + "".join(f"<p>{o}</p>" for o in own) + "</div><div class='end'><p>All rights</p><p>Imprint</p></div>")
        host = "a.com" if i < 40 else f"h{i}.org"
        rows.append((i, f"https://{host}:80/p/{i}", html, "t", 0))
        want[i] = "\n".join(own)
    rows += [(100, None, None, "t", 0), (101, "odd", "", "t", 0), (102, "http://a.com/", "plain text &lt;", "t", 0)]
    want |= {100: "", 101: "", 102: "plain text <"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row_no int")
    got = extract_main_text(pages)
    assert set(got.columns) == {"page_id", "url", "row_no", "text"}
    assert {r["page_id"]: r["text"] for r in got.collect()} == want
    assert extract_main_text(pages.where("false")).count() == 0


def test_site_tree_decides_inside_and_beside_articles(spark):
    rng = random.Random(2)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8))
    rows, want = [], {}
    for i in range(40):
        lead, own = say(), [say() for _ in range(rng.randint(1, 5))]
        html = (f"<html><body><div class='lead'>{lead}</div><div class='top'>Start Shop</div><article>"
                + "".join(f"<p>{o}</p>" for o in own) + "<div class='end'>Our house style</div></article></body></html>")
        rows.append((i, "http://a.com/" + str(i), html))
        want[i] = "\n".join([lead, *own])
    for i in range(100, 110):  # copies of one page: nothing tells text from frame
        rows.append((i, "http://b.com/" + str(i), "<body><div>Top</div><article><p>One</p><p>Two</p></article></body>"))
        want[i] = "One\nTwo"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()} == want


@pytest.mark.parametrize("around", [
    "<body class='has-sidebar'><article>{}</article>", "<body class='no-sidebar comments-open'><main>{}</main>",
    "<html class='header'><main class='with-menu'>{}</main>", "<article class='social share'>{}</article>",
    "<div class='ad'>Buy</div><div id='modal'><div class='widget'><main><article class='promo'>{}</article></main></div></div>"])
def test_class_words_do_not_take_the_main_text(around):
    text = main_text(around.format("<p>One<div class='ad'>Buy</div><p>Two").encode(), None)
    assert text == "One\nTwo"
    assert main_text(b"<article><p>One</p><article class='comment'>Nice</article></article>", None) == "One"


def test_hosts(spark):
    urls = ["http://A.b.C/x", "https://u:p@h.org:8080?q", "ftp://h", "no host", None, "//x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of("url")).collect()] == ["a.b.c", "h.org", "h", "", "", ""]


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [b[2] for b in Page(deep).blocks] == ["x"]
    assert len(Page("<p>a b" * 20000).blocks) == 20000
    assert Page("<a title='" * 2000 + "<b").blocks is not None


def test_base_patterns_cover_the_kinds():
    assert list(BASE) == KINDS and callable(op6_pii)


def test_base_emails_need_no_letter(spark):
    df = spark.createDataFrame([(1, "x -@-.- y"), (2, "%@--.-"), (3, "a@b")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.private_data if s.base] for r in find_private_data(df).collect()}
    assert got == {1: [("email", 2, 7)], 2: [("email", 0, 6)], 3: []}


def test_very_deep_pages(spark):
    """A page of 60,000 nested elements costs no more than its length."""
    deep = "<div class='a'>" * 60000 + "x"
    page = Page(deep)
    assert [b[2] for b in page.blocks] == ["x"] and len({p for p, _ in page.styles}) > 59990
    pages = spark.createDataFrame([(1, "http://a.b/1", deep), (2, "http://a.b/2", "<p>y</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_main_text(pages).collect()}.keys() == {1, 2}
