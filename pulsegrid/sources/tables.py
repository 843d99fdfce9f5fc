"""Base table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid import schemas as S

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; projections and filters applied later reach the scan
    (ReadSchema / PushedFilters)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Server registry stored as Parquet (S3)."""
    return spark.read.schema(S.SERVERS).parquet(path)
