"""Interaction of filters: what each removes, in every order of application.

A row fails some of n filters. In an order of the filters the row is removed
by the one that it fails first, so its removal step is the least place that a
failed filter has in the order. For all masks of failed filters and all
orders at once that is the min-plus product of the matrix of masks (0 where a
filter fails the row, far away where it does not) with the matrix of the
places (the inverse permutations). Rows enter by the number that carry a mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import extend

MAX_FILTERS = 7  # 5,040 orders


def removal_steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of n filters, and per mask and order the step (from 1) at
    which a row of that mask is removed; n + 1: never."""
    orders = np.array(list(permutations(range(n))))
    places = np.argsort(orders, axis=1) + 1
    masks = np.where((np.arange(1 << n)[:, None] >> np.arange(n)) & 1, 0, n + 1)
    steps = np.full((1 << n, len(orders)), n + 1)
    for f in range(n):
        np.minimum(steps, masks[:, f, None] + places[None, :, f], out=steps)
    return orders, steps


def audit(masks: DataFrame, names: str, weights: list[str], part: str = "part") -> DataFrame:
    """One row per part, order of the filters and step of the order.

    ``masks``: (part, mask, n, ``weights``...): bit i of ``mask`` says that
    filter ``names[i]`` fails the rows, ``n`` how many rows the line stands
    for, a weight how many of these count for it; lines may repeat a mask.
    Returns part, filter_order, step, kept (after the step), removed (at it),
    redundant (failing its filter, removed earlier), unique_fails (failing
    its filter only), ``<weight>_lost`` (removed at it) and shapley (removed
    by its filter, summed over all orders). Null masks and counts stand for 0;
    a null part is a part of its own. No lines give no rows.
    """
    n = len(names)
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    columns = ["n", *weights]
    summed = masks.groupBy(F.col(part).alias("part"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask")).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"w{i}") for i, c in enumerate(columns)])
    lost = [f"{w}_lost" for w in weights]
    schema = T.StructType([T.StructField("part", masks.schema[part].dataType),
                           T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in
                             ("kept", "removed", "redundant", "unique_fails", *lost, "shapley")])

    def scatter(lines: pd.DataFrame) -> pd.DataFrame:
        orders, steps = removal_steps(n)
        rank = steps[lines["mask"].to_numpy()]                         # lines x orders
        place = rank + np.arange(len(orders)) * (n + 2)
        counts = []
        for i in range(len(columns)):
            total = np.zeros(len(orders) * (n + 2), np.int64)
            np.add.at(total, place, lines[f"w{i}"].to_numpy()[:, None])
            counts.append(total.reshape(len(orders), n + 2)[:, 1:n + 1])  # orders x steps
        removed = counts[0]
        rows = lines["w0"].to_numpy()
        fails = ((lines["mask"].to_numpy()[:, None] >> np.arange(n)) & 1).astype(np.int64)
        failing = rows @ fails
        alone = rows @ (fails * (fails.sum(axis=1, keepdims=True) == 1))
        shapley = np.zeros(n, np.int64)
        np.add.at(shapley, orders, removed)
        out = {"part": lines["part"].iloc[0], "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], n),
               "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
               "kept": (rows.sum() - np.cumsum(removed, axis=1)).ravel(), "removed": removed.ravel(),
               "redundant": (failing[orders] - removed).ravel(), "unique_fails": alone[orders].ravel(),
               **{c: counts[i + 1].ravel() for i, c in enumerate(lost)}, "shapley": shapley[orders].ravel()}
        return pd.DataFrame(out)

    return summed.groupBy("part").applyInPandas(scatter, schema)


_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SIGNS = b"#$%&*|"


def _judge(batches: Iterator[list]) -> Iterator[list[tuple]]:
    for texts in batches:
        out = []
        for t in texts:
            t = t or b""
            words = t.split()  # bytes.split: exactly the six blanks
            upper = len(t) - len(t.translate(None, _UPPER))
            out.append(((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
                        | (100 * upper > 10 * len(t.translate(None, _CONTINUED))) << 2
                        | (len(t.translate(None, _SIGNS)) < len(t)) << 3, hashlib.sha256(t).digest()))
        yield out


def text_failures(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """The key, the kept columns, ``mask`` of four filters (bit 0: under 100
    words; 1: under 80 % distinct words; 2: over 10 % upper case A-Z; 3: holds
    one of ``#$%&*|``) and ``digest`` (SHA-256) of every text; null: empty."""
    added = T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    return extend(docs, text, added, _judge, [key, *(keep or [])])


def count_copies(rows: DataFrame, bit: int, key: str = "doc_id") -> DataFrame:
    """Rows that are alike counted, with the failure bit of copies set.

    ``rows``: the key, ``digest``, ``mask`` and any other columns. Returns
    these others, ``mask`` and ``n``, the number of rows. A row fails if a
    smaller key has its digest anywhere in the table; rows of the least key
    do not, several of them included, nor do rows with a null key, which are
    no one's first copy. Groups are counted by their columns first, so a
    digest that a third of all rows carry is a few lines at the last step.
    """
    others = [c for c in rows.columns if c not in (key, "digest", "mask")]
    each = rows.select("digest", F.col(key).alias("key"), "mask", F.struct(F.lit(0), *others).alias("others"))
    of_key = each.groupBy("digest", "key", "mask", "others").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("key").isNotNull()
    alike = of_key.groupBy("digest", "mask", "others").agg(
        F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unknown"),
        F.min(F.when(known, F.struct("key", "n"))).alias("least"))
    first = F.min("least.key").over(Window.partitionBy("digest"))
    split = alike.select("mask", "others", "n", (F.col("unknown") + F.when(
        F.col("least.key") == first, F.col("least.n")).otherwise(0)).alias("passing"))
    lines = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
                    F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"),
                             (F.col("n") - F.col("passing")).alias("n")))
    return split.select("others", F.explode(lines).alias("line")).where("line.n > 0").select(
        *[F.col("others")[c].alias(c) for c in others], "line.mask", "line.n")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four text filters (A-D) and the copy filter (E) per
    language. Labels of a repeated id count if any of its rows has them; a
    document that has no label counts for none. A null language is the part
    ''. See ``audit``, ``text_failures`` and ``count_copies``."""
    judged = text_failures(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")),
                           keep=["part"])
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"),
                                         F.max(F.col("toxic") == 1).alias("toxic"))
    rows = judged.join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counted = count_copies(rows, bit=1 << 4).select(
        "part", "mask", "n", *[F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in ("good", "toxic")])
    return audit(counted, "ABCDE", ["good", "toxic"])
