"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. What it measured and a bit mask of
the rules that failed are stored; policies (named, versioned sets of rules)
and the question what a policy would keep without one of its rules are then
answered from the masks alone, without a second look at any text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import extend

WINDOW = 8          # words of a window that may not repeat
GROUP = 1 << 20     # bytes of texts that are measured together

_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a code point after its first

MEASURES = T.StructType([T.StructField(name, T.LongType()) for name in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_run_words")])

#: name -> failure condition over the measurements; the place is the bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "upper_case": "100 * n_upper > 30 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_runs": "100 * n_run_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A document is dropped if it fails a rule of ``rules``, or more than
    ``allowed`` of the rules ``counted``."""
    name: str
    version: int
    rules: tuple[str, ...]
    counted: tuple[str, ...] = ()
    allowed: int = 0


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("clean", 1, BASE.rules + ("symbols", "upper_case")),
    Policy("clean", 2, BASE.rules + ("symbols", "upper_case", "word_runs"),
           ("repeated_lines", "short_words", "long_words"), 1),
)


def bits(names) -> int:
    """The mask of the rules of these names."""
    order = list(RULES)
    return sum(1 << order.index(n) for n in set(names))


def repeated(code: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks the words that lie in a window found twice or more in their text.

    ``code``: a number per distinct word, ``doc``: the text of each word, in
    order. Only windows all of whose word pairs occur again in the text can
    repeat; those are compared word by word.
    """
    n = len(code)
    hit = np.zeros(n, bool)
    if n < window + 1:
        return hit
    same = doc[1:] == doc[:-1]
    base = int(code.max()) + 1
    _, pair, often = np.unique((doc[:-1] * base + code[:-1]) * base + code[1:]
                               if (int(doc[-1]) + 1) * base * base < 1 << 62
                               else _ranks(doc[:-1] * base + code[:-1]) * base + code[1:],
                               return_inverse=True, return_counts=True)
    alive = np.concatenate([[0], np.cumsum((often[pair] > 1) & same)])
    starts = np.nonzero(alive[window - 1:] - alive[:n - window + 1] == window - 1)[0]
    if not len(starts):
        return hit
    key = doc[starts]
    for j in range(window):
        key = _ranks(key * base + code[starts + j])
    starts = starts[np.bincount(key)[key] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _measured(texts: list[bytes]) -> list[tuple]:
    numbers = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # bytes.split: exactly the six blanks
    lengths = np.array([len(w) for w in words], np.int64)
    code = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    again = np.bincount(doc[repeated(code, doc)], minlength=len(texts))
    runs = np.bincount(doc[1:][(code[1:] == code[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    out = []
    for i, t in enumerate(texts):
        solid = t.translate(None, _BLANKS)
        lines = [line for line in t.split(b"\n") if line.strip(_BLANKS)]
        out.append((int(lengths[i]), len(solid.translate(None, _CONTINUED)),
                    len(solid) - len(solid.translate(None, _SYMBOLS)),
                    len(lines) - len(set(lines)), int(again[i]), len(lines),
                    len(solid) - len(solid.translate(None, _UPPER)), int(runs[i])))
    return out


def _measure(batches: Iterator[list]) -> Iterator[list[tuple]]:
    for texts in batches:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t or b"")
            size += len(group[-1])
            if size > GROUP:
                out += _measured(group)
                group, size = [], 0
        yield out + _measured(group)


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all), the measurements and ``failed_bits``.

    Words are runs of non-blank characters (blanks: space, tab, line feed,
    vertical tab, form feed, carriage return). A null text has none: it fails
    ``few_words``, as the empty text does. Every row has its own line,
    repeated rows too; an empty table gives none. Columns that have the name
    of a measurement or of ``failed_bits`` give way to it.
    """
    keep = [c for c in (keep or docs.columns) if c != "failed_bits"]
    measured = extend(docs, text, MEASURES, _measure, keep)
    failed = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = failed[0]
    for f in failed[1:]:
        total = total.bitwiseOR(f)
    return measured.withColumn("failed_bits", total.cast("long"))


def kept(policy: Policy, failed: str = "failed_bits") -> F.Column:
    """Whether the policy keeps a line of the ledger."""
    f = F.col(failed)
    return ((f.bitwiseAND(F.lit(bits(policy.rules))) == 0)
            & (F.bit_count(f.bitwiseAND(F.lit(bits(policy.counted)))) <= policy.allowed))


def failed(policy: Policy) -> F.Column:
    return ~kept(policy)


def apply_policies(lines: DataFrame, policies=POLICIES) -> DataFrame:
    """(policy, version, rows, kept, dropped, failed_any): one row a policy.
    ``failed_any`` is the union of the failure bits of the dropped lines."""
    return _over_patterns(lines, [(p, None) for p in policies]).select(
        "policy", "version", "rows", "kept", (F.col("rows") - F.col("kept")).alias("dropped"), "failed_any")


def ablations(lines: DataFrame, policies=POLICIES) -> DataFrame:
    """(policy, version, rule, failing, kept, kept_without): per policy and
    rule, how many lines fail it, how many the policy keeps, and how many it
    would keep without that rule."""
    cases = [(p, r) for p in policies for r in p.rules + p.counted]
    return _over_patterns(lines, cases).select("policy", "version", "rule", "failing", "kept", "kept_without")


def _over_patterns(lines: DataFrame, cases) -> DataFrame:
    """Aggregates over the distinct masks (at most 2^rules, pre-aggregated
    before the shuffle) for each case of a policy and one of its rules."""
    rows = [(p.name, p.version, r or "", bits(p.rules), bits(p.counted), p.allowed, bits([r]) if r else 0)
            for p, r in cases]
    case = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, (
        "policy", "version", "rule", "hard", "counted", "allowed", "bit"))]) for row in rows])
    patterns = lines.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    each = patterns.select("failed_bits", "n", F.explode(case).alias("c")).select("failed_bits", "n", "c.*")

    def verdict(mask: F.Column) -> F.Column:
        return ((mask.bitwiseAND(F.col("hard")) == 0)
                & (F.bit_count(mask.bitwiseAND(F.col("counted"))) <= F.col("allowed")))

    mask = F.col("failed_bits")
    less = mask.bitwiseAND(F.bitwise_not(F.col("bit").cast("long")))
    return each.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(mask.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(verdict(mask), F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(verdict(less), F.col("n")).otherwise(0)).alias("kept_without"),
        F.coalesce(F.bit_or(F.when(~verdict(mask), mask)), F.lit(0).cast("long")).alias("failed_any"))
