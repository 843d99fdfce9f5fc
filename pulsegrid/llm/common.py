"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import drop_dir, shared_dir


def as_bytes(column) -> list:
    """UTF-8 bytes (or None) of each string of an Arrow column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def fresh(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def extend(df: DataFrame, source: str, added: T.StructType,
           work: Callable[[Iterator[list]], Iterator[list[tuple]]],
           keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns computed by Arrow batches from the column ``source``.

    ``work`` gets an iterator of batches of that column (bytes or None for
    strings, Python values otherwise) and yields, for each of them, one tuple
    of the ``added`` fields per row. ``keep`` names the columns that pass
    through unchanged (default: all). Names in ``added`` replace equal names.
    """
    keep = [c for c in (keep if keep is not None else df.columns)
            if c not in added.fieldNames()]
    text = isinstance(df.schema[source].dataType, T.StringType)
    schema = T.StructType([df.schema[c] for c in keep] + list(added.fields))
    src = fresh(df, "_src")
    n, kinds = len(keep), [_arrow_type(f.dataType) for f in added.fields]
    names = schema.fieldNames()

    def run(batches):
        held = []

        def columns():
            for b in batches:
                held.append(b)
                yield as_bytes(b.column(n)) if text else b.column(n).to_pylist()

        for rows in work(columns()):
            b = held.pop(0)
            new = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(n)]
                + [pa.array(v, k) for v, k in zip(new, kinds)], names=names)

    return df.select(*[F.col(f"`{c}`") for c in keep],
                     F.col(f"`{source}`").alias(src)).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
            T.StringType: pa.string(), T.BinaryType: pa.binary(),
            T.BooleanType: pa.bool_()}[type(kind)]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back:
    computed once, read by any executor, and free of the lineage above it."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path  # for forget()
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    drop_dir(df.sparkSession, df.stored_path)


def release(spark) -> None:
    """Lets Spark delete the shuffle files of steps whose result is stored:
    its cleaner removes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_bucket(number: F.Column, n: int) -> F.Column:
    """crc32 of the decimal text of a number, modulo ``n``."""
    return F.crc32(F.encode(number.cast("string"), "UTF-8")) % n
