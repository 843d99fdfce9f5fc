"""Versioned registry snapshots without a transactional table format (K2).

Layout under ``root``::

    v=<n>/         one complete registry per version (Parquet)
    _versions/     append-only table of committed version numbers

A version is written first and committed by appending its number to
``_versions`` afterwards, so readers never see a half-written version; the
current registry is the highest committed version. Rewriting a version
(a replay) produces the same rows. The folder being read is never
overwritten by a different version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.session import path_exists


def write_version(registry: DataFrame, root: str, version: int, folded: dict[str, int] | None = None) -> str:
    """Write ``registry`` as version ``version`` and commit it, with the last
    batch of each status stream that it holds.

    Rows are range-partitioned and sorted by ``server_id``, so every file
    and row group covers a narrow id range: a lookup by id is a pushed
    Parquet filter that skips the rest by min/max statistics.
    """
    path = f"{root}/v={int(version)}"
    (registry.repartitionByRange("server_id").sortWithinPartitions("server_id")
     .write.mode("overwrite").parquet(path))
    spark = registry.sparkSession
    (spark.createDataFrame([(int(version), folded or {})], _VERSIONS).coalesce(1)
     .write.mode("append").parquet(f"{root}/_versions"))
    return path


_VERSIONS = "version long, folded map<string,long>"


def _current(spark: SparkSession, root: str):
    """(version, folded) of the newest committed version, or None."""
    if not path_exists(spark, f"{root}/_versions"):
        return None
    rows = spark.read.schema(_VERSIONS).parquet(f"{root}/_versions")
    return rows.orderBy(F.desc("version"), F.desc(F.size("folded"))).first()


def current_version(spark: SparkSession, root: str) -> int | None:
    row = _current(spark, root)
    return None if row is None else row["version"]


def folded(spark: SparkSession, root: str) -> dict[str, int] | None:
    """Last status batch of each stream in the current version; None without
    a version."""
    row = _current(spark, root)
    return None if row is None else dict(row["folded"] or {})


def read_current(spark: SparkSession, root: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    return spark.read.schema(S.SERVERS).parquet(f"{root}/v={v}")
