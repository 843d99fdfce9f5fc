"""Hidden Markov language model: training by Baum-Welch, exact text likelihood."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import as_bytes, forget, fresh, stored

STATES = 8
ROUNDS = 5
LOOKUP_WORDS = 200_000   # most frequent words, whose counts are sent to all tasks
OWN_CLASSES = 49_151     # of them, as many have a class each; one class is the end
SHARED_CLASSES = 16_384  # all other words share these by their first and last letters
CLASSES = OWN_CLASSES + SHARED_CLASSES + 1
END = CLASSES - 1
PRIOR = 1000.0           # words' worth of the overall distribution in each state's counts
SEGMENT, SEQUENCES = 256, 1024
RANGES = 64              # parts in which the counts of classes are added up
ALPHA = 0.1              # the base model's extra count
FLUSH = 250_000          # distinct words a task counts before it passes them on
ROWS = 500               # texts that a task works on at once


def _rows(batches):
    """The batches in parts of ROWS rows, which bounds a task's memory."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered; the end is not among them."""
    return text.lower().split() if text else []


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts. Tasks add up their own words before the shuffle."""
    def run(batches):
        seen: Counter = Counter()
        for b in _rows(batches):
            for t in as_bytes(b.column(0)):
                seen.update(tokens(t))
            if len(seen) > FLUSH:
                yield batch(seen)
                seen = Counter()
        yield batch(seen)

    def batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()),
                                           pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "word binary, n long") \
               .groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals of the training words, and the most frequent of them in order."""

    total: int        # training tokens, ends included
    distinct: int     # distinct ones, the end included
    ends: int         # training texts
    words: list[bytes]
    counts: np.ndarray

    @property
    def mass(self) -> float:
        return self.total + ALPHA * (self.distinct + 1)


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    """The words of at least the count that not more than LOOKUP_WORDS reach.

    That count comes from a histogram over steps of an eighth of a doubling,
    a few hundred rows at any size of the corpus.
    """
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("n").alias("n"),
                                                   F.min("n").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["k"]
        if held > LOOKUP_WORDS:
            break
        least = r["least"]
    rows = counts.where(F.col("n") >= least).select("word", "n").collect()
    rows = sorted(((r["n"], bytes(r["word"])) for r in rows), key=lambda r: (-r[0], r[1]))
    return Vocabulary(sum(r["n"] for r in steps) + n_texts, sum(r["k"] for r in steps) + (n_texts > 0),
                      n_texts, [w for _, w in rows], np.array([n for n, _ in rows], np.int64))


def shared_class(word: bytes) -> int:
    return OWN_CLASSES + zlib.crc32(word[:3] + b" " + word[-3:]) % SHARED_CLASSES


def encoded(docs: DataFrame, vocab: Vocabulary, text: str, row: str, train: str) -> DataFrame:
    """Each text as classes of its tokens, what the frequent words add to the
    base score, and its other words with their number, for a join."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocab)

    def run(batches):
        v = sent.value
        number = {w: i for i, w in enumerate(v.words)}
        logs = np.log10((v.counts + ALPHA) / v.mass)
        end_log = math.log10((v.ends + ALPHA) / v.mass)
        for b in _rows(batches):
            out = []
            for t in as_bytes(b.column(2)):
                words = tokens(t)
                at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                classes = np.empty(len(words) + 1, np.uint16)
                classes[:-1], classes[-1] = np.where(at < OWN_CLASSES, at, 0), END
                for i in np.flatnonzero((at < 0) | (at >= OWN_CLASSES)).tolist():
                    classes[i] = shared_class(words[i])
                rare = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                known = at[at >= 0]
                out.append((len(words) + 1, len(known) + (v.ends > 0), float(logs[known].sum()) + end_log,
                            classes.tobytes(), list(rare), list(rare.values())))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["row", "train", "n_tokens", "n_known", "base", "classes", "rare", "times"])

    return docs.select(F.col(row).alias("row"), F.col(train).alias("train"), F.col(f"`{text}`")).mapInArrow(
        run, "row long, train boolean, n_tokens long, n_known long, base double, classes binary, "
             "rare array<binary>, times array<long>")


def class_masses(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Base probability of each class; the shared classes hold an equal part of
    the one unknown word each, so that all known words and the unknown one, of
    whatever class, have a probability of 1 together in every state."""
    own = vocab.words[:OWN_CLASSES]
    mass = np.zeros(CLASSES)
    mass[:len(own)] = vocab.counts[:OWN_CLASSES] + ALPHA
    mass[OWN_CLASSES:END] = ALPHA / SHARED_CLASSES
    mass[END] = vocab.ends + ALPHA
    sent = counts.sparkSession.sparkContext.broadcast(set(own))

    def run(batches):
        sums = np.zeros(SHARED_CLASSES)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w not in sent.value:
                    sums[shared_class(w) - OWN_CLASSES] += n + ALPHA
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])],
                                         names=["class", "mass"])

    shared = counts.select("word", "n").mapInArrow(run, "class int, mass double") \
                   .groupBy("class").agg(F.sum("mass").alias("mass")).collect()
    for r in shared:
        mass[OWN_CLASSES + r["class"]] += r["mass"]
    return mass / mass.sum()


@dataclass
class Model:
    start: np.ndarray   # (state)
    moves: np.ndarray   # (state, state)
    ratio: np.ndarray   # (class, state): how much likelier a class is than in the base


def first_model(mass: np.ndarray) -> Model:
    """States that stay, and that differ by random factors of the classes."""
    rng = np.random.default_rng(7)
    emit = np.exp(0.7 * rng.standard_normal((CLASSES, STATES))) * mass[:, None]
    emit /= emit.sum(axis=0)
    moves = np.full((STATES, STATES), 0.03 / (STATES - 1))
    np.fill_diagonal(moves, 0.97)
    return Model(np.full(STATES, 1 / STATES), moves, emit / np.maximum(mass, 1e-300)[:, None])


def _blocks(sequences: list[np.ndarray], size: int):
    """Sequences of like length, longest first, at most ``size`` in a block:
    (places by time, number still running at each time)."""
    order = sorted(sequences, key=len, reverse=True)
    for i in range(0, len(order), size):
        block = order[i:i + size]
        lengths = np.array([len(s) for s in block])
        grid = np.zeros((lengths[0], len(block)), np.int64)
        for k, s in enumerate(block):
            grid[:len(s), k] = s
        running = len(block) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))
        yield grid, running


def expected_counts(sequences: list[np.ndarray], model: Model, totals: dict) -> None:
    """Adds the Baum-Welch counts of the sequences to ``totals``."""
    ratio, moves = model.ratio.astype(np.float32), model.moves.astype(np.float32)
    for grid, running in _blocks(sequences, SEQUENCES):
        emit = ratio[grid]
        ahead = np.zeros_like(emit)
        for t, n in enumerate(running):
            a = emit[0] * model.start.astype(np.float32) if t == 0 else (ahead[t - 1, :n] @ moves) * emit[t, :n]
            ahead[t, :n] = a / a.sum(axis=1, keepdims=True)
        back = np.full((grid.shape[1], STATES), 1 / STATES, np.float32)
        pairs = np.zeros((STATES, STATES))
        for t in range(len(grid) - 1, -1, -1):
            n = running[t]
            if t + 1 < len(grid):
                m = running[t + 1]
                x = emit_next[:m] * back[:m]
                heard = x @ moves.T
                of = ahead[t, :m]
                pairs += (of / (of * heard).sum(axis=1, keepdims=True)).T @ x
                back[:m] = heard / heard.sum(axis=1, keepdims=True)
            emit_next = emit[t].copy()
            p = ahead[t, :n] * back[:n]
            emit[t, :n] = p / p.sum(axis=1, keepdims=True)  # from here on: the posterior
            emit[t, n:] = 0
        totals["start"] += emit[0].sum(axis=0)
        totals["moves"] += pairs * model.moves
        where, posterior = grid.ravel(), emit.reshape(-1, STATES)
        for s in range(STATES):
            totals["emit"][:, s] += np.bincount(where, posterior[:, s], CLASSES)


def baum_welch(coded: DataFrame, mass: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` over all training texts.

    Every task runs forward-backward over its texts, in segments of SEGMENT
    tokens, and adds the expected counts to one table of classes and states;
    the tables are cut in RANGES and added up by range across all tasks. What
    reaches the driver is one such table, whatever the size of the corpus.
    """
    model, spark = first_model(mass), coded.sparkSession
    training = coded.where("train").select("classes")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            totals = {"start": np.zeros(STATES), "moves": np.zeros((STATES, STATES)),
                      "emit": np.zeros((CLASSES, STATES))}
            held, size = [], 0
            for b in batches:
                for c in b.column(0).to_pylist():
                    s = np.frombuffer(c, np.uint16)
                    held += [s[i:i + SEGMENT] for i in range(0, len(s), SEGMENT)]
                    size += len(s)
                    if size >= SEGMENT * SEQUENCES * 4:
                        expected_counts(held, sent.value, totals)
                        held, size = [], 0
            expected_counts(held, sent.value, totals)
            small = np.vstack((totals["start"], totals["moves"]))
            parts = [small, *np.array_split(totals["emit"], RANGES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()),
                 pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["part", "sums"])

        def add_up(frame):
            total = sum(np.frombuffer(x, np.float32).astype(float) for x in frame["sums"])
            frame = frame.iloc[:1].copy()
            frame["sums"] = [total.tobytes()]
            return frame

        rows = training.mapInArrow(run, "part int, sums binary").groupBy("part") \
                       .applyInPandas(add_up, "part int, sums binary").collect()
        sent.unpersist()
        if not rows:
            return model
        sums = [np.frombuffer(r["sums"], float).reshape(-1, STATES) for r in sorted(rows)]
        small, emit = sums[0], np.concatenate(sums[1:])
        emit = (emit + PRIOR * mass[:, None]) / (emit.sum(axis=0) + PRIOR)
        start, moves = small[0] + 1, small[1:] + 1
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True),
                      emit / np.maximum(mass, 1e-300)[:, None])
    return model


def log_ratios(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the likelihood of each whole sequence against the base, by the
    scaled forward recursion."""
    out, lengths = np.zeros(len(sequences)), np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    for i in range(0, len(order), SEQUENCES):
        block = order[i:i + SEQUENCES]
        running = len(block) - np.searchsorted(lengths[block][::-1], np.arange(1, lengths[block[0]] + 1))
        state = np.empty((len(block), STATES))
        total = np.zeros(len(block))
        for from_t in range(0, lengths[block[0]], SEGMENT):  # a strip of times is gathered at once
            upto = min(from_t + SEGMENT, lengths[block[0]])
            n0 = running[from_t]
            grid = np.zeros((upto - from_t, n0), np.int64)
            for k in range(n0):
                part = sequences[block[k]][from_t:upto]
                grid[:len(part), k] = part
            emit = model.ratio[grid]
            scale = np.ones((upto - from_t, n0))
            for t in range(from_t, upto):
                n = running[t]
                a = model.start * emit[0] if t == 0 else (state[:n] @ model.moves) * emit[t - from_t, :n]
                scale[t - from_t, :n] = a.sum(axis=1)
                state[:n] = a / scale[t - from_t, :n, None]
            total[:n0] += np.log10(scale).sum(axis=0)
        out[block] = total
    return out


def score(docs: DataFrame, train: F.Column, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``.

    The model learns from the rows for which ``train`` is true (not null). A
    text is its words and one end. ``base_score`` is the log10 probability
    under a unigram model with ALPHA added to each count and one unknown word;
    ``score`` that under the hidden Markov model, in which a state draws a
    class of words and the class draws the word as the base does. The classes
    cover every word, known or not, so each text has a finite score; a null
    or empty text is its end alone. Without training rows the base gives each
    token the same share. Repeated rows are each scored (and counted in
    training); an empty table gives an empty table. Columns that have one of
    the five names are replaced.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (text, *added)]
    row, use = fresh(docs, "row_no"), fresh(docs, "use")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()) \
                   .withColumn(use, F.coalesce(train, F.lit(False)))
    learnt = numbered.where(use)
    counts = stored(word_counts(learnt, text), "words")
    vocab = vocabulary(counts, learnt.count())
    coded = stored(encoded(numbered, vocab, text, row, use), "coded")
    model = baum_welch(coded, class_masses(counts, vocab))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def chain(batches):
        for b in batches:
            sequences = [np.frombuffer(c, np.uint16) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(log_ratios(sequences, sent.value))],
                                             names=["row", "gain"])

    gains = coded.select("row", "classes").mapInArrow(chain, "row long, gain double")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")) \
                .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    log = F.log10((F.coalesce("n", F.lit(0)) + ALPHA) / F.lit(vocab.mass))
    rest = (rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")))
    scored = (coded.select("row", "n_tokens", "n_known", "base").join(gains, "row").join(rest, "row", "left")
              .select(F.col("row").alias(row), "n_tokens",
                      (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(vocab.total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "gain"))
    return numbered.drop(text, *added).join(scored, row).select(
        *keep, *added[:4], (F.col("base_score") + F.col("gain")).alias("score"))
