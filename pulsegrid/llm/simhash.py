"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import extend, forget, fresh, stored
from pulsegrid.llm.components import components

SEED = 42
SEGMENTS = 4  # of 64 / SEGMENTS bits each
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text as a signed 64-bit number; 0 for null or no words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in
                  zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    parts = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(parts[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3,
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a long column ``fingerprint`` of the whole text.

    Lower-case A-Z, words split at ASCII blanks, shingles of ``shingle`` words
    with repeats (a shorter text is one shingle), XXH64 with seed 42; a bit is
    one if more than half of the hashes have it. Null, empty and blank texts
    have fingerprint zero.
    """
    def work(batches):
        for texts in batches:
            yield [(fingerprint(t, shingle),) for t in texts]

    return extend(docs, text, T.StructType([T.StructField("fingerprint", T.LongType())]),
                  work, keep)


def _ball(value: F.Column, radius: int) -> F.Column:
    """Array of all numbers within ``radius`` bits, built segment by segment.

    For radius 1 each segment is left as it is or has one of its bits flipped
    while the others stay; a wider ball flips on from there.
    """
    width = 64 // SEGMENTS
    bits = [_signed(1 << (s * width + b)) for s in range(SEGMENTS) for b in range(width)]
    masks = F.array(*[F.lit(m) for m in [0, *bits]])
    ball = F.array(value)
    for _ in range(radius):
        ball = F.array_distinct(F.flatten(F.transform(
            ball, lambda v: F.transform(masks, lambda m: v.bitwiseXOR(m)))))
    return ball


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def close_links(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (a, b, distance) that connect all distinct fingerprints within
    ``max_distance`` bits of each other.

    Two fingerprints differ in at most d bits exactly if some number lies
    within floor(d/2) bits of the one and ceil(d/2) of the other. So each
    fingerprint enters the table under every key of its floor(d/2) ball, asks
    for every key of its ceil(d/2) ball, and what meets under a key is linked
    to the least entry there: at most one link per row, whatever the size of
    a group, and each link's complete distance is verified. Balls hold at most
    65 keys for d = 2, and so no key can gather more than 65 fingerprints.
    ``prints``: one row for each distinct long ``fingerprint``.
    """
    near, far = max_distance // 2, max_distance - max_distance // 2
    table = prints.select("fingerprint", F.explode(_ball(F.col("fingerprint"), near)).alias("key"))
    if near == far:
        met = table.withColumn("a", F.expr("min(fingerprint) over (partition by key)"))
    else:
        least = table.groupBy("key").agg(F.min("fingerprint").alias("a"))
        asked = prints.select("fingerprint",
                              F.explode(_ball(F.col("fingerprint"), far)).alias("key"))
        met = asked.join(least, "key")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("fingerprint")))
    return (met.where("a <> fingerprint")
            .select("a", F.col("fingerprint").alias("b"), distance.alias("distance"))
            .where(F.col("distance") <= max_distance).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` without its text, with ``fingerprint``, ``component_id`` and
    ``component`` (the least fingerprint of the component, its identity).

    ``component_id`` is the least non-null id among all rows that can be
    reached over links of at most ``max_distance`` bits, the row itself
    included; it is null if all of them are null. Rows with equal texts have
    equal fingerprints and hence one component; repeated ids and rows are all
    returned. Only distinct fingerprints are linked, so copies cost nothing.
    An empty table gives an empty table. Columns that have one of the three
    names are replaced.
    """
    keep = [c for c in docs.columns
            if c not in (text, "fingerprint", "component_id", "component")]
    keep = keep if id_col != text else keep + [id_col]
    prints = stored(fingerprints(docs, text, shingle, keep), "fingerprints")
    least = fresh(prints, "least")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(id_col).alias(least)), "distinct")
    found = components(close_links(distinct.select("fingerprint"), max_distance))
    groups = distinct.join(found, distinct.fingerprint == found.node, "left").select(
        "fingerprint", least, F.coalesce("root", "fingerprint").alias("root"))
    group_ids = groups.groupBy("root").agg(F.min(least).alias("component_id"))
    named = stored(groups.join(group_ids, "root").select(
        "fingerprint", "component_id", F.col("root").alias("component")), "groups")
    forget(distinct)
    return prints.join(named, "fingerprint").select(*keep, "fingerprint", "component_id",
                                                    "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                         shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row of each SimHash component, with the columns of ``docs``.

    The row with the least id stays; of several rows with that id any one, and
    any one of a component that has no ids. Only ids are compared; the choice
    joins back by a row number, so the rows of a component never meet.
    """
    row = fresh(docs, "row_no")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    groups = simhash_groups(numbered.select(row, id_col, text), id_col, text, shingle, max_distance)
    chosen = (groups.where(F.col(id_col).eqNullSafe(F.col("component_id")))
              .groupBy("component").agg(F.min(row).alias(row)))
    return numbered.join(chosen.select(row), row, "left_semi").select(*docs.columns)
