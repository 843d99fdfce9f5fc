"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import as_bytes, extend, forget, stored
from pulsegrid.llm.decontaminate import _WORD, _WORDS, SPAN

FIT_ROWS = 20_000     # labelled rows the model is fitted on, at most
SEGMENT = 256         # words of a training sequence; a text gives as many as it needs
LEAST_SHARE = 0.01    # of the toxic texts that must have a feature, and LEAST_TEXTS
LEAST_TEXTS = 4
KEEP_PRECISION, GOLD_PRECISION = 0.4, 0.7
ROUNDS = 24           # gradient steps
FLOOR = 0.05          # a word counts for its text from this marginal on
CELLS = 2_000_000     # of a padded block of sequences
CACHED_WORDS = 500_000


def words_of(text: bytes | None) -> list[str]:
    """Lower-case words: digits, letters a-z and all non-ASCII characters."""
    if not text:
        return []
    return text.decode().lower().encode().translate(_WORDS).decode().split()


def features(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in range(4, 8) if len(word) > n]


def _padded(sequences: list[np.ndarray], block: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a block by (time, sequence), longest first, all ending at the
    last time; and the time at which each begins."""
    height = len(sequences[block[0]])
    unary = np.zeros((height, len(block)))
    starts = np.array([height - len(sequences[i]) for i in block])
    for k, i in enumerate(block):
        unary[starts[k]:, k] = sequences[i]
    return unary, starts


def _odds(unary, starts, moves):
    """exp of the scores, and the odds of label 1 forward and backward.

    Places before a sequence's start have forward odds 0, so they are label 0
    and do not reach into it. ``moves``: transition weights, as exp.
    """
    (a00, a01), (a10, a11) = moves
    e = np.exp(unary)
    ahead, back = np.zeros_like(e), np.ones_like(e)
    begun = np.searchsorted(starts, np.arange(len(e) + 1), "right")  # sequences running at each time
    for t in range(len(e)):
        n = begun[t - 1] if t else 0
        r = ahead[t - 1, :n]
        ahead[t, :n] = np.minimum(e[t, :n] * (a01 + r * a11) / (a00 + r * a10), 1e150)
        ahead[t, n:begun[t]] = e[t, n:begun[t]]
    for t in range(len(e) - 1, 0, -1):
        n = begun[t - 1]
        x = e[t, :n] * back[t, :n]
        back[t - 1, :n] = (a10 + a11 * x) / (a00 + a01 * x)
    return e, ahead, back


def _blocks(sequences: list[np.ndarray]):
    """Numbers of sequences of like length, at most CELLS padded cells a block."""
    order, held = sorted(range(len(sequences)), key=lambda i: -len(sequences[i])), []
    for i in order:
        if held and (len(held) + 1) * len(sequences[held[0]]) > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def marginals(sequences: list[np.ndarray], model: dict) -> list[np.ndarray]:
    """Probability of label 1 at every place, by forward-backward."""
    out: list = [None] * len(sequences)
    for block in _blocks(sequences):
        unary, starts = _padded(sequences, block)
        _, ahead, back = _odds(unary, starts, model["moves"])
        odds = ahead * back
        p = odds / (1 + odds)
        for k, i in enumerate(block):
            out[i] = p[starts[k]:, k]
    return out


class Scorer:
    """Unary scores of words under a model, with a bounded memory of words."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def score(self, word: str) -> float:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        weights = self.model["weights"]
        s = self.model["bias"] + sum(weights.get(f, 0.0) for f in features(word))
        self.known[word] = s
        return s

    def sequence(self, words: list[str]) -> np.ndarray:
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            found = [known[w] if w in known else self.score(w) for w in words]
        return np.array(found, float)

    def texts(self, texts: list) -> list[tuple]:
        """For each text: number of words, sum and maximum of the marginals of
        FLOOR and more, word numbers of marginals of a half and more. A text
        of which no word scores above the bias is skipped where that cannot
        reach FLOOR."""
        sequences, skipped = [], []
        for t in texts:
            s = self.sequence(words_of(t))
            skipped.append(self.model["quiet"] and not (s > self.model["bias"]).any())
            sequences.append(s)
        lengths = [len(s) for s in sequences]
        found = iter(marginals([s for s, x in zip(sequences, skipped) if not x], self.model))
        out = []
        for n, skip in zip(lengths, skipped):
            p = np.empty(0) if skip else next(found)
            p_high = p[p >= FLOOR]
            out.append((n, float(p_high.sum()), float(p_high.max(initial=0)),
                        np.flatnonzero(p >= 0.5).tolist()))
        return out


def _fit_lexicon(sample: DataFrame) -> dict[str, float]:
    """Features of words -> precision for toxic texts.

    First the number of texts of either label that have a feature; for those
    that are common and precise enough, the number of different words that
    come before it in texts of either label, so that copies of one text are
    no evidence. At most 1 / LEAST_SHARE times the features of a text remain.
    """
    n_toxic = sample.where("toxic = 1").count()
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_toxic))

    def texts_with(batches):
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                seen[toxic].update({f for w in set(words_of(text)) for f in features(w)})
            if len(seen[0]) + len(seen[1]) > CACHED_WORDS:
                yield from counted(seen)
                seen = {0: Counter(), 1: Counter()}
        yield from counted(seen)

    def counted(seen):
        for toxic, c in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()),
                 pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "n"])

    plain = sample.select("text", "toxic")
    a, b = (F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)) for t in (1, 0))
    common = {r[0] for r in plain.mapInArrow(texts_with, "feature string, toxic int, n long")
              .groupBy("feature").agg(a.alias("a"), b.alias("b"))
              .where((F.col("a") >= least) & (F.col("a") >= KEEP_PRECISION * (F.col("a") + F.col("b"))))
              .select("feature").collect()}

    def contexts(batches):
        for b in batches:
            rows = set()
            for text, toxic in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                words = words_of(text)
                for before, w in zip(["", *words], words):
                    rows.update((f, before, toxic) for f in features(w) if f in common)
            rows = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()),
                                              pa.array(rows[2], pa.int32())], names=["feature", "before", "toxic"])

    if not common:
        return {}
    one = F.lit(1)
    rows = (plain.mapInArrow(contexts, "feature string, before string, toxic int").distinct()
            .groupBy("feature").agg(F.count(F.when(F.col("toxic") == 1, one)).alias("a"),
                                    F.count(F.when(F.col("toxic") == 0, one)).alias("b")).collect())
    return {r["feature"]: r["a"] / (r["a"] + r["b"] + 1) for r in sorted(rows)
            if r["a"] >= least and r["a"] >= KEEP_PRECISION * (r["a"] + r["b"] + 1)}


def _fit_chain(sample: DataFrame, lexicon: dict[str, float]) -> dict:
    """Weights of the features, the bias and the transitions.

    Labelled words: in a toxic text those with a feature of GOLD_PRECISION,
    elsewhere none. Each round every partition runs forward-backward over its
    segments and returns its gradient (one small row); steps follow the sign
    of the summed gradient and grow or shrink as it keeps or changes sign.
    """
    names = list(lexicon)
    number = {f: i for i, f in enumerate(names)}
    gold = {f for f, p in lexicon.items() if p >= GOLD_PRECISION}
    n = len(names)

    def encode(batches):
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text)
                known = {w: f for w in set(words) if (f := [x for x in features(w) if x in number])}
                at = [k for k, w in enumerate(words) if w in known]
                out.append((len(words), at, [[number[x] for x in known[words[k]]] for k in at],
                            [int(any(x in gold for x in known[words[k]])) for k in at]))
            yield out

    ints = T.ArrayType(T.IntegerType())
    coded = stored(extend(sample, "text", T.StructType([
        T.StructField("n", T.LongType()), T.StructField("at", ints), T.StructField("found", T.ArrayType(ints)),
        T.StructField("gold", ints)]), encode, ["toxic"]), "coded")

    def gradient(params):
        weights, bias, moves = params[:n], params[n], params[n + 1:].reshape(2, 2)

        def run(batches):
            total, places = np.zeros(n + 5), 0
            for b in batches:
                sequences, labels, active = [], [], []
                for toxic, size, at, found, is_gold in zip(*(c.to_pylist() for c in b.columns)):
                    u, y = np.full(size, bias), np.zeros(size, int)
                    u[at] += [weights[f].sum() for f in found]
                    y[at] = np.array(is_gold, int) * toxic
                    first = len(sequences)
                    for i in range(0, size, SEGMENT):
                        sequences.append(u[i:i + SEGMENT])
                        labels.append(y[i:i + SEGMENT])
                        active.append([])
                    for k, f in zip(at, found):
                        active[first + k // SEGMENT].append((k % SEGMENT, f))
                for block in _blocks(sequences):
                    unary, starts = _padded(sequences, block)
                    real, truth = np.zeros_like(unary), np.zeros(unary.shape, int)
                    for k, i in enumerate(block):
                        real[starts[k]:, k], truth[starts[k]:, k] = 1, labels[i]
                    e, ahead, back = _odds(unary, starts, np.exp(moves))
                    odds = ahead * back
                    miss = (truth - odds / (1 + odds)) * real
                    total[n] += miss.sum()
                    places += real.sum()
                    for k, i in enumerate(block):
                        for at, fs in active[i]:
                            total[fs] += miss[starts[k] + at, k]
                    (a00, a01), (a10, a11) = np.exp(moves)
                    r, x = ahead[:-1], e[1:] * back[1:]
                    pair = np.stack((a00 + 0 * r, a01 * x, a10 * r, a11 * r * x))
                    pair /= pair.sum(axis=0)
                    was = 2 * truth[:-1] + truth[1:]
                    inside = real[:-1]
                    total[n + 1:] += [((was == j) * inside).sum() - (pair[j] * inside).sum() for j in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([float(places)])],
                                             names=["g", "places"])

        rows = coded.select("toxic", "n", "at", "found", "gold") \
                    .mapInArrow(run, "g array<double>, places double").collect()
        return np.sum([r["g"] for r in rows], axis=0) if rows else np.zeros(n + 5)

    params, step, last = np.zeros(n + 5), np.full(n + 5, 0.5), np.zeros(n + 5)
    params[n], params[:n] = -3.0, 1.0
    for _ in range(ROUNDS if n else 0):
        g = gradient(params) - 0.05 * params  # a weak prior keeps weights finite
        same = np.sign(g) * np.sign(last)
        step = np.clip(np.where(same > 0, step * 1.3, np.where(same < 0, step * 0.4, step)), 1e-4, 1.0)
        params = params + np.sign(g) * step
        last = g
    forget(coded)
    moves = np.exp(params[n + 1:].reshape(2, 2))
    model = {"weights": dict(zip(names, params[:n].tolist())), "bias": float(params[n]), "moves": moves}
    quiet = marginals([np.full(SEGMENT, model["bias"])], model)[0].max()
    return model | {"quiet": bool(quiet < FLOOR)}


def _inputs(n, total, top):
    return np.stack((np.ones_like(total), np.log1p(total), top, total / np.maximum(n, 1)), axis=-1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        label: str = "toxic", train: F.Column | None = None, rows: int = FIT_ROWS) -> dict:
    """The model of toxic spans and texts, from labelled texts.

    At most ``rows`` labelled rows, those of the least hash of the id among
    ids that ``train`` admits (default: all), are read; null and other labels
    than 0 and 1 are no labels, equal texts of one label count once. Without
    labelled rows, or with one class only, all texts score the share of it.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("toxic"))
    ids = ids.where("id is not null and toxic in (0, 1)").distinct()
    if train is not None:
        ids = ids.where(train(F.col("id")))
    chosen = ids.orderBy(F.xxhash64("id"), "id", "toxic").limit(rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")) \
                 .join(F.broadcast(chosen), "id").select("text", "toxic").distinct()
    sample = stored(sample.repartition(32, F.xxhash64("text")), "labelled")
    model = _fit_chain(sample, _fit_lexicon(sample))
    scored = extend(sample, "text", _RAW, _raw(model), ["toxic"]).select(
        "toxic", "n_words", "toxic_sum", "toxic_max").collect()
    forget(sample)
    y = np.array([r["toxic"] for r in scored], float)
    x = _inputs(*(np.array([r[c] for r in scored], float) for c in ("n_words", "toxic_sum", "toxic_max"))) \
        if len(y) else np.zeros((0, 4))
    beta = np.zeros(4)
    for _ in range(30):  # Newton steps of a logistic regression with a weak prior
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        beta = beta + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta), -2, 2)
    return model | {"beta": beta.tolist()}


_RAW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("toxic_sum", T.DoubleType()),
                     T.StructField("toxic_max", T.DoubleType())])


def _raw(model):
    def work(batches):
        scorer = Scorer(model)
        for texts in batches:
            yield [r[:3] for r in scorer.texts(texts)]

    return work


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``toxic_spans``.

    Marginals of label 1 over the words of the whole text are aggregated to
    their sum, maximum and share, on which the score rests; null and empty
    texts have no words and get the score of that. ``toxic_spans`` are the
    runs of words with a marginal of a half or more, as code points of the
    text, end exclusive. Columns of either name are replaced; nothing is
    shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", SPAN)])

    def work(batches):
        scorer, beta = Scorer(sent.value), np.array(sent.value["beta"])
        for texts in batches:
            rows = scorer.texts(texts)
            if not rows:
                yield []
                continue
            n, total, top = (np.array([r[j] for r in rows], float) for j in range(3))
            p = 1 / (1 + np.exp(-np.clip(_inputs(n, total, top) @ beta, -30, 30)))
            yield [(s, _spans(t, r[3])) for s, t, r in zip(p.tolist(), texts, rows)]

    return extend(docs, text, added, work, keep)


def _spans(text: bytes, hit: list[int]) -> list[tuple]:
    """Runs of word numbers as code point ranges of the text."""
    if not hit:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_WORDS))]
    out, at, points = [], 0, 0
    runs = np.split(np.array(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
    for run in runs:
        a, b = places[run[0]][0], places[run[-1]][1]
        points += len(text[at:a].decode())
        end = points + len(text[a:b].decode())
        out.append((points, end))
        at, points = b, end
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, train, text: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score below a half, as they were."""
    model = fit(docs, labels, id_col, text, train=train)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text}`").alias("text"))  # so that no column is replaced
    return score(rows, model, keep=["row"]).where("score < 0.5").select("row.*")
