"""Main text of web pages by a style tree of each site."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import as_bytes, extend, fresh, stored

CONTENT_SHARE = 0.7  # of a branch's importance; the rest is its presentation's
THRESHOLD = 0.5
MAIN_WEIGHT = 0.15   # more for a branch in an article or main element, less for one beside it
SITE_PAGES = 8       # pages' worth of the tree of all sites in a site's judgement

# Elements by their role in a page.
BLOCKS = set("""address article aside blockquote body center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
    optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript noframes iframe xmp template svg math object".split())
NOISE_TAGS = set("nav aside footer form button select menu dialog head".split())
NOISE_ROLES = set("""alert alertdialog banner complementary contentinfo dialog form menu menubar
    navigation search status toolbar""".split())
NOISE_WORDS = set("""ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment
    comments consent cookie cookies discussion disqus foot footer gdpr login masthead menu modal nav
    navbar navigation newsletter notice notices overlay pager pagination popup promo recommended
    related replies reply respond share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription toolbar topbar widget""".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html", "menu", "select"}

_TAG = re.compile(r"""<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)
    (?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>)""", re.X)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")


def _signature(name: str, attrs: str, in_main: bool) -> tuple[str, bool, bool, bool]:
    """(style of an element, is it noise, is it by its words, does it hold the main text)."""
    noise, worded, main, first = name in NOISE_TAGS, False, name in ("article", "main"), ""
    if name == "header":
        noise = not in_main
    for m in _ATTR.finditer(attrs) if attrs.strip() else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words = _TOKEN.findall(value)
            first = first or (words[0] if words and key == "class" else "")
            worded |= not NOISE_WORDS.isdisjoint(words)
            worded |= "header" in words and not in_main
        elif key == "role":
            noise, main = noise or value in NOISE_ROLES, main or value in ("main", "article")
        elif key == "style":
            noise |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            noise |= key == "hidden" or value == "true"
    return (f"{name}.{first}" if first else name), noise, worded and name not in ("html", "body"), main and not noise


class Page:
    """Text blocks of a page in order, and the styles of its elements.

    ``blocks``: (path, parent's path, text, in noise, in main); ``styles``:
    (path, children's styles). A path is the number of a chain of styles from
    the root, made step by step, so that a deep page costs no more than a wide
    one.
    Optional end tags are filled in, other tags without a partner ignored;
    what an open comment or raw element holds goes to the page's end. Class
    words make no noise of html, body, an article or main element, or what is
    around one; an article in an article (a comment) is like other elements.
    """

    def __init__(self, source: str):
        self.blocks, self.styles = [], []
        # name, path, noise, main (2: article), children, is a block, innermost element of noise words
        self.stack = [["", _step(0, ""), False, 0, [], True, -1]]
        self.open_names: Counter = Counter()
        self.worded: list[list] = []  # of such elements: the next one around, is it noise
        self.text: list[str] = []
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self.text.append(source[at:])
                break
            if lt > at:
                self.text.append(source[at:lt])
            after = source[lt + 1:lt + 2]
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif after in ("!", "?"):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            elif m := _TAG.match(source, lt):
                name = (m["name"] or m["name2"]).lower()
                at = m.end()
                if m["close"] or m["close2"]:
                    self.close(name)
                elif name in RAW:
                    end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(source, at)
                    at = end.end() if end else n
                    self.text.append(" ")
                else:
                    self.open(name, m["attrs"] or m["attrs2"] or "")
            elif after.isascii() and (after.isalpha() or after == "/"):
                at = n  # a tag that the page's end cuts off
            else:
                self.text.append("<")
                at = lt + 1
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        for w in self.worded:  # outer ones first
            w[1] = w[1] or (w[0] >= 0 and self.worded[w[0]][1])
        self.blocks = [(path, parent, text, noise or (w >= 0 and self.worded[w][1]), main)
                       for path, parent, text, noise, main, w in self.blocks]

    def flush(self):
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if text:
                i = len(self.stack) - 1
                while not self.stack[i][5]:
                    i -= 1
                _, path, noise, main, _, _, _ = self.stack[i]
                self.blocks.append((path, self.stack[max(0, i - 1)][1], text, noise or self.stack[-1][2], main > 0,
                                    self.stack[-1][6]))

    def open(self, name: str, attrs: str):
        block = name in BLOCKS
        if block:
            self.flush()
            if name in CLOSES_P:
                self.until({"p"})
            if name in SAME:
                self.until(SAME[name])
        elif name == "br":
            self.text.append(" ")
        if name in VOID:
            return
        top = self.stack[-1]
        style, noise, worded, main = _signature(name, attrs, top[3] > 0)
        at = top[6]
        if main and top[3] < 2 and not top[2]:
            worded, i = False, at
            while i >= 0 and self.worded[i][1]:
                self.worded[i][1] = False
                i = self.worded[i][0]
        elif worded:
            main = False
        if (noise or worded or main) and not block:
            self.flush()
        top[4].append(style)
        if worded:
            self.worded.append([at, True])
            at = len(self.worded) - 1
        self.open_names[name] += 1
        self.stack.append([name, _step(top[1], style), top[2] or noise, max(top[3], (2 if name == "article" else 1) if main else 0),
                           [], block or noise or worded or main, at])

    def until(self, names: set):
        """Closes the innermost open element of ``names``, unless a scope is inside."""
        if not any(self.open_names[n] for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in SCOPE:
                return

    def close(self, name: str):
        if not self.open_names[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                while len(self.stack) > i:
                    self.pop()
                return

    def pop(self):
        if self.stack[-1][5]:
            self.flush()
        name, path, _, _, children, _, _ = self.stack.pop()
        self.open_names[name] -= 1
        if children:
            self.styles.append((path, ",".join(children)))


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _step(path: int, style: str) -> int:
    """Number of the path that goes on from ``path`` to an element of this style."""
    return xxhash.xxh64_intdigest(style.encode("utf-8", "replace"), path + (1 << 63)) - (1 << 63)


def host_of(url: str) -> F.Column:
    """Host of a URL, lower-case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)),
                      F.lit(""))


_MARK = "row long, host string, path long, parent long, content boolean, feature long, first int, side int"


def _marks(pages: DataFrame) -> DataFrame:
    """What each page adds to the tree of its site: once for each path and
    text (content) or path and children (presentation). ``first`` is 1 on one
    of the rows of a page and path, and ``side`` there 1 for text in an article
    or main element, -1 for text beside it. Input: (row, host, html)."""
    def run(batches):
        for b in batches:
            out = []
            for row, host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                if not source:
                    continue
                page, seen = Page(source.decode()), set()
                kept = [b for b in page.blocks if not b[3]]
                inside = {b[0] for b in kept if b[4]}
                found = {(p, q, True, t) for p, q, t, _, _ in kept}
                found |= {(p, 0, False, c) for p, c in page.styles}
                for path, parent, content, feature in found:
                    first = (path, content) not in seen
                    seen.add((path, content))
                    side = (1 if path in inside else -1) if first and content and inside else 0
                    out.append((row, host, path, parent, content, _number(feature), int(first), side))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["row", "host", "path", "parent", "content", "feature", "first", "side"])

    return pages.mapInArrow(run, _MARK)


def _importance(marks: DataFrame, site: list[str]) -> DataFrame:
    """(site..., path, importance, pages) of the paths that hold text.

    Content: one less the mean entropy of its texts over the pages that have
    the path, so what repeats on every page counts nothing. Presentation:
    entropy of the children of the element around it, so a fixed frame counts
    nothing. Both are 1 on a single page. MAIN_WEIGHT is added by the share of
    pages on which the path is in an article or main element, and taken by the
    share on which it is beside one.
    """
    by_feature = marks.groupBy(*site, "path", "parent", "content", "feature").agg(
        F.count("*").alias("k"), F.sum("first").alias("m"), F.sum("side").alias("side"))
    by_path = by_feature.groupBy(*site, "path", "parent", "content").agg(
        F.sum("m").alias("m"), F.sum("side").alias("side"), F.avg(F.log("k")).alias("mean_log"),
        F.sum(F.col("k") * F.log("k")).alias("k_log"))
    many = F.col("m") > 1
    content = by_path.where("content").select(
        *site, "path", "parent", F.col("m").alias("pages"), (F.col("side") / F.col("m")).alias("side"),
        F.when(many, 1 - F.col("mean_log") / F.log("m")).otherwise(1.0).alias("text"))
    frame = by_path.where("not content").select(
        *site, F.col("path").alias("parent"),
        F.when(many, 1 - F.col("k_log") / F.col("m") / F.log("m")).otherwise(1.0).alias("frame"))
    both = content.join(frame, [*site, "parent"], "left")
    mix = CONTENT_SHARE * F.col("text") + (1 - CONTENT_SHARE) * F.coalesce("frame", F.lit(1.0)) \
        + MAIN_WEIGHT * F.col("side")
    return both.groupBy(*site, "path").agg(F.max(mix).alias("importance"), F.sum("pages").alias("pages"))


def main_text(source: bytes | None, low: list[int] | None) -> str:
    """Blocks that are kept, one on a line: those in no branch of ``low``
    importance; blocks in noise elements never. A page with an article or main
    element of which nothing would be left is a copy, and keeps what is in it."""
    if not source:
        return ""
    blocks = [b for b in Page(source.decode()).blocks if not b[3]]
    dropped = set(low or ())
    kept = [b for b in blocks if b[0] not in dropped] if dropped else blocks
    if any(b[4] for b in blocks) and not any(b[4] for b in kept):
        kept = [b for b in blocks if b[4]]
    return "\n".join(b[2] for b in kept)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with its html replaced by ``text``, the main text.

    The elements of all pages of a host are merged to one tree by their chain
    of styles (tag and first class). Each branch gets an importance from the
    entropy of its texts and of its frame; branches below THRESHOLD go from
    each page. The same branch in the tree of all sites counts like SITE_PAGES
    further pages of the site, so that few pages do not decide alone. Menus, headers, footers, asides, forms, scripts and the
    like stand outside of this and have no importance; article and main
    elements count as MAIN_WEIGHT in it.

    Character references are decoded, white space in a block becomes one
    space, blocks are joined by one line break. Null or empty html gives an
    empty text; a null or odd url is a site of its own; repeated pages are
    each returned. A column named ``text`` is replaced.
    """
    pages = pages.drop("text") if html != "text" else pages
    row, low = fresh(pages, "row_no"), fresh(pages, "low")
    numbered = pages.withColumn(row, F.monotonically_increasing_id())
    marks = stored(_marks(numbered.select(F.col(row).alias("row"), host_of(url).alias("host"),
                                          F.col(html).alias("html"))), "marks")
    site = _importance(marks, ["host"])
    everywhere = _importance(marks, []).select("path", F.col("importance").alias("overall"))
    poor = stored(site.join(everywhere, "path")
                  .where((F.col("importance") * F.col("pages") + F.col("overall") * SITE_PAGES)
                         / (F.col("pages") + SITE_PAGES) < THRESHOLD).select("host", "path"), "poor")
    per_row = (marks.where("content").select("row", "host", "path").distinct().join(poor, ["host", "path"])
               .groupBy("row").agg(F.collect_list("path").alias(low)).withColumnRenamed("row", row))
    joined = numbered.join(per_row, row, "left")
    pair = fresh(joined, "pair")
    joined = joined.withColumn(pair, F.struct(F.encode(html, "UTF-8").alias("html"), F.col(low).alias("low")))

    def work(batches):
        for rows in batches:
            yield [(main_text(r["html"], r["low"]),) for r in rows]

    return extend(joined, pair, T.StructType([T.StructField("text", T.StringType())]), work,
                  [c for c in pages.columns if c != html])
