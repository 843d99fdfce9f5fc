"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import extend, forget, fresh, stored
from pulsegrid.llm.sharding import shard_by_bytes, text_size

WINDOW = 10
SHARD_BYTES = 8 << 20   # text indexed at once in a task; one document at least
BLOCK_BYTES = 16 << 20  # benchmark text that is sent to the tasks at once
SAMPLE = 8              # every so many suffix positions are kept in an index

# ASCII letters are lowered, digits and all bytes of other characters stay,
# any other ASCII character parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_END = b"Z"  # after a document; no word holds a capital

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class FMIndex:
    """Suffixes of a sequence of small ints, for exact search of phrases.

    ``symbols`` ends every run with 0, which no phrase holds. Suffixes are
    sorted by prefix doubling, the runs' ends in order of position. The last
    column is held as a wavelet matrix: one bit row with its running count for
    each bit of a symbol.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        rank = np.unique(rank, return_inverse=True)[1]
        order, step = np.argsort(rank, kind="stable"), 1
        while n and rank.max() < n - 1:
            second = np.zeros(n, np.int64)
            second[:n - step] = rank[step:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            step *= 2
        self.n, last = n, symbols[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1))))
        starts = np.concatenate(([0], ends[:-1] + 1)) if n else ends
        run_start = np.repeat(starts, np.diff(np.append(starts, n)))
        self.marked = (order - run_start[order]) % SAMPLE == 0
        self.before_mark = np.concatenate(([0], np.cumsum(self.marked)))
        self.sample = order[self.marked]
        self.last, self.levels, column = last, [], last
        for bit in range(max(1, int(symbols.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (column >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones)))))
            column = np.concatenate((column[ones == 0], column[ones == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before ``upto``."""
        low, high = np.zeros_like(upto), upto.copy()
        for bit, ones in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            zeros = self.n - ones[-1]
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (right-aligned rows): their row ranges."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - back]
            known = symbol + 1 < len(self.first)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row: steps back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        away = np.flatnonzero(~self.marked[rows])
        while len(away):
            symbol = self.last[rows[away]]
            rows[away] = self.first[symbol] + self.rank(symbol, rows[away])
            steps[away] += 1
            away = away[~self.marked[rows[away]]]
        return self.sample[self.before_mark[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple], window: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i:i + window]), set()).add(item)
        self.items = [[x for x in v if x is not None] for v in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.rows = np.array([(0,) * (window - len(k)) + k for k in found],
                             np.int64).reshape(-1, window)
        self.shortest = int(self.lengths.min(initial=window))

    def hits(self, texts: list):
        """For each text: number of words, merged hit spans in words, items.

        A word that no item holds parts the text, so the index holds only the
        runs of benchmark words that are as long as the shortest window.
        """
        parts = []
        for t in texts:
            parts += [t.translate(_WORDS) if t else b"", _END]
        words = b" ".join(parts).split()
        code = np.fromiter(map((self.number | {_END: -1}).get, words, repeat(0)), np.int64, len(words))
        del parts, words
        ends = np.flatnonzero(code < 0)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        edges = np.diff(np.concatenate(([0], (code > 0).astype(np.int8), [0])))
        begin, stop = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        long_enough = stop - begin >= self.shortest
        begin, stop = begin[long_enough], stop[long_enough]
        spans, items = [[] for _ in texts], [set() for _ in texts]
        if len(begin) and len(self.rows):
            size = stop - begin + 1
            where = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) \
                + np.arange(size.sum())
            symbols = np.where(where == np.repeat(stop, size), 0, code[where])
            index = FMIndex(symbols)
            low, high = index.search(self.rows, self.lengths)
            phrase = np.repeat(np.arange(len(low)), high - low)
            if len(phrase):
                rows = np.arange(len(phrase)) - np.repeat(
                    np.cumsum(high - low) - (high - low), high - low) + low[phrase]
                at = where[index.locate(rows)]
                doc = np.searchsorted(ends, at)
                for d, p in np.unique(np.stack((doc, phrase), 1), axis=0).tolist():
                    items[d].update(self.items[p])
                cover = np.zeros(len(code) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + self.lengths[phrase], -1)
                edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
                first, after = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                for d, a, b in zip(np.searchsorted(ends, first).tolist(), first.tolist(), after.tolist()):
                    spans[d].append((a - int(starts[d]), b - int(starts[d])))
        return list(zip((ends - starts).tolist(), spans, items))


def _groups(texts: list):
    """Slices of a batch with at most SHARD_BYTES of text, or one document."""
    begin = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > SHARD_BYTES:
            yield texts[begin:i]
            begin, held = i, 0
        held += size + 1
    yield texts[begin:]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges), ``item_ids``.

    Each task indexes its documents shard by shard and searches every window
    of the benchmark there: backward search over wavelet-tree ranks gives the
    suffix rows of a window, sampled suffix positions give its places, and
    overlapping places of a document merge to one span. ``item_ids`` are the
    distinct items that have a window in the document, in no order. A window
    is ``window`` consecutive words of an item, or the whole item if it has
    fewer; words: see ``_WORDS``.

    The benchmark is sent in blocks of about ``block_bytes`` (plus one item at
    most), whose size is checked before; one pass over ``docs`` for each block,
    whose result is stored before the next.
    Null texts have no words; items without words match nothing; a null
    ``item_id`` hits words but is not listed; equal items are each listed.
    Columns that have one of the three names are replaced. Nothing is shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("words"))
    total = items.agg(F.sum(text_size("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    if n_blocks > 1:
        items = shard_by_bytes(items.withColumn("size", text_size("words")), n_blocks, "size",
                               [F.xxhash64("words"), F.col("item")])
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN),
                          T.StructField("item_ids", T.ArrayType(benchmark.schema[item_id].dataType))])
    out, keep = docs.drop(*found.fieldNames()), [c for c in docs.columns if c not in found.fieldNames()]
    if text not in keep:
        raise ValueError(f"the text column cannot be named {text}")
    held = None
    for block in range(n_blocks):
        if block:  # the block before is done and its windows are let go
            last = stored(out, "contamination")
            sent.unpersist()
            if held is not None:
                forget(held)
            held = out = last
        rows = items.where(F.col("shard") == block) if n_blocks > 1 else items
        sent = spark.sparkContext.broadcast(
            [(r[0], r[1].encode()) for r in rows.select("item", "words").collect() if r[1]])

        def work(batches, sent=sent):
            phrases = Phrases(sent.value, window)
            for texts in batches:
                yield [(n, s, list(i)) for part in _groups(texts) for n, s, i in phrases.hits(part)]

        if block == 0:
            out = extend(out, text, found, work, keep)
            continue
        words, spans, ids = (fresh(out, c) for c in ("n_words", "hit_spans", "item_ids"))
        before = out.withColumnsRenamed({"n_words": words, "hit_spans": spans, "item_ids": ids})
        out = (extend(before, text, found, work)
               .withColumn("item_ids", F.array_union(ids, "item_ids"))
               .withColumn("hit_spans", merged(F.concat(F.col(spans), F.col("hit_spans"))))
               .drop(words, spans, ids))
    return out


def merged(spans: F.Column) -> F.Column:
    """An array of spans in order, overlapping and touching ones as one."""
    start = F.array().cast(SPAN)

    def put(done, s):
        tail = F.element_at(done, F.greatest(F.size(done), F.lit(1)))
        joined = F.struct(tail["start"].alias("start"),
                          F.greatest(tail["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
                      ).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, put)


def hit_words(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every hit word of its text cut out, from the first letter
    of a span to the last; texts without a hit stay as they are, byte by byte."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in rest]).alias("row"),
                       F.col(f"`{text}`").alias("text"))  # so that no column is replaced
    found = find_contamination(rows, benchmark, **options)
    cut = T.StructType([T.StructField("text", T.StringType())])

    def work(batches):
        for pairs in batches:
            yield [(_cut(p["text"], p["spans"]),) for p in pairs]

    pair = F.struct("text", F.col("hit_spans").alias("spans"))
    hit = extend(found.where("size(hit_spans) > 0").withColumn("pair", pair), "pair", cut, work, ["row"])
    clean = found.where("size(hit_spans) = 0").select("row", "text")
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return hit.union(clean).select(*columns)


def _cut(text: str, spans: list) -> str:
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_WORDS))]
    out, at = [], 0
    for s in spans:
        out.append(raw[at:places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()
