"""Session construction and the shared scratch folder.

Every job in this package assumes:

* all timestamps are UTC (``spark.sql.session.timeZone=UTC``); the batch
  tables hold TIMESTAMP_NTZ wall-clock values in UTC, streams use TIMESTAMP;
* adaptive query execution is on, so shuffle partition counts, join strategy
  and skewed partitions are re-planned from runtime statistics;
* lineage is cut with tables written into the folder the cluster names in
  ``spark.checkpoint.dir`` and read back (never ``localCheckpoint``, never a
  machine-local folder on a cluster; a private temporary folder is created
  only when the setting is absent, i.e. in local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. Partition counts are deliberately not
# fixed here beyond a local default: on a cluster set
# spark.sql.shuffle.partitions high (e.g. 4000 for 100 TB) and let AQE
# coalesce towards the advisory size.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # partial per-partition top-k before the shuffle for rank <= k filters
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state (daily windows: servers x open days) off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # of members of one name in a message the last counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # checkpoint files of rounds no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pulsegrid", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    apply_sql_defaults(spark)
    return spark


# Static settings cannot change on a running session; the rest are runtime
# SQL settings that every registered query re-applies to whatever session
# it is given.
_STATIC = {"spark.ui.enabled", "spark.cleaner.referenceTracking.cleanCheckpoints"}


def apply_sql_defaults(spark: SparkSession) -> None:
    """UTC always; every other setting only where the caller has not set it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    given = spark._jsparkSession.sessionState().conf()
    for k, v in SESSION_DEFAULTS.items():
        if k not in _STATIC and not given.contains(k):
            spark.conf.set(k, v)


_PRIVATE_ROOT: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from the running context first, then from the configuration. Only a
    local master, whose executors are the driver itself, may go without the
    setting: a private folder is then created once. On a cluster a missing
    ``spark.checkpoint.dir`` is an error, since a folder of the driver's own
    machine is no place that executors share. Sessions without a context
    handle (Spark Connect) read the configuration only.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    else:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver "
                               "and all executors share")
        if not _PRIVATE_ROOT:
            _PRIVATE_ROOT.append(tempfile.mkdtemp(prefix="pulsegrid-ckpt-"))
        configured = _PRIVATE_ROOT[0]
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh, uniquely named folder under the shared checkpoint folder,
    for stream sources/sinks/checkpoints and written intermediate tables.
    It is removed when the application ends, or earlier by ``drop_dir``."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    fs, target = _file_system(spark, path)
    if fs is not None:
        fs.deleteOnExit(target)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a ``shared_dir`` folder whose content nothing reads any more."""
    fs, target = _file_system(spark, path)
    if fs is not None:
        fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs is not None and fs.exists(target)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is absent."""
    fs, target = _file_system(spark, path)
    if fs is None or not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path`` (None on Spark Connect)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None, None
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target
