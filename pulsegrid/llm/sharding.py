"""Balanced contiguous shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, stored


def shard_by_bytes(df: DataFrame, n_shards: int, size: str, order: list) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ... in it).

    Rows are put in the global ``order`` by one range shuffle; each partition
    adds up its own sizes; a prefix sum over the partitions' totals (one row
    for each partition) gives every row its byte offset in the whole table.
    The offsets are cut at equal targets: a row goes to the shard its middle
    byte falls in, so shards are contiguous in ``order`` and differ from the
    target by at most one row's size. Rows that tie in ``order`` go either way
    round. Equal keys may span partitions: give a unique last key for that.
    Null or negative sizes count as 0; if all sizes are 0, all rows are in
    shard 0. An empty table gives an empty table; columns named ``shard`` or
    ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    part, row, upto = (fresh(df, c) for c in ("part", "row_no", "upto"))
    names, weight = df.columns, fresh(df, "weight")
    # by ranges of the order, then one running sum a range: a window in Spark, as
    # Python workers beside the heap took an executor to its limit
    ranged = (df.withColumn(weight, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
              .repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    along = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = stored(ranged.select(*[F.col(f"`{c}`") for c in names], part,
                                 (F.count(F.lit(1)).over(along) - 1).alias(row), F.sum(weight).over(along).alias(upto)),
                   "shards")
    totals = local.groupBy(part).agg(F.max(upto).alias("bytes"), F.count("*").alias("rows"))
    before = totals.selectExpr(  # one row for each partition
        f"{part} as p", "sum(bytes) over (order by {0}) - bytes as bytes_before".format(part),
        "sum(rows) over (order by {0}) - rows as rows_before".format(part),
        "sum(bytes) over () as all_bytes")
    weight_of = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    middle = 2 * (F.col("bytes_before") + F.col(upto)) - weight_of
    target = F.nullif(2 * F.col("all_bytes"), F.lit(0))
    shard = F.least(F.coalesce(F.floor(middle * n_shards / target), F.lit(0)),
                    F.lit(n_shards - 1)).cast("int")
    cut = local.join(F.broadcast(before), F.col(part) == F.col("p")).withColumn("shard", shard) \
               .withColumn("slot", F.col("rows_before") + F.col(row))
    firsts = cut.groupBy("shard").agg(F.min("slot").alias("first_slot"))  # n_shards rows
    return (cut.join(F.broadcast(firsts), "shard")
            .select(*[F.col(f"`{c}`") for c in names], "shard",
                    (F.col("slot") - F.col("first_slot")).alias("slot")))


def text_size(text: str = "text") -> F.Column:
    """UTF-8 bytes of a text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: str = "text") -> F.Column:
    """Unsigned crc32 of the UTF-8 text; of no bytes for null."""
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
