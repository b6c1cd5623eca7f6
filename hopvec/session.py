"""Session helpers: building a session, finding the checkpoint folder, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package is written for. AQE re-plans joins at run time
# (broadcast only when the measured side is small, skew splitting for hub vertices).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Vector sums run in ObjectHashAggregate; keep it hash-based for more keys per task
    # before it falls back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def get_spark(master: str | None = None, app: str = "hopvec", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local master only when asked)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def conf_override(spark: SparkSession, settings: dict):
    """Set session SQL settings for the duration of a block, then restore them."""
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _context(spark: SparkSession):
    """The SparkContext of a classic session, ``None`` for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return int(sc.defaultParallelism)
    return int(spark.conf.get("spark.default.parallelism", None)
               or spark.conf.get("spark.sql.shuffle.partitions", "8"))


def is_local(spark: SparkSession) -> bool:
    sc = _context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    return master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Taken from the session (``spark.checkpoint.dir`` or a folder already set on the
    context). Only a local session without one gets a private folder under the system
    temp dir; a cluster session without one is an error, because a machine-local
    folder does not survive the loss of an executor.
    """
    sc = _context(spark)
    if sc is None:   # Spark Connect: the server's spark.checkpoint.dir is used by checkpoint()
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this job")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this job")
    folder = tempfile.mkdtemp(prefix="hopvec-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist and compute once, so the next step reads the cached blocks."""
    df = df.persist(level)
    df.count()
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, in its partitions. Its plan is a leaf: a loop
    that reads the last iterate several times does not grow, and lost executors recompute nothing before it."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    # the copy is a plain scan; planned without AQE it tells its partitioning, and later joins need no exchange
    with conf_override(df.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        out = cut_lineage(held)
    held.unpersist()
    return out


def table_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, by: tuple[str, ...] = (), options: dict | None = None, mode: str = "errorifexists") -> DataFrame:
    """``df`` written as Parquet into the session's shared folder and read again: cuts the lineage,
    survives the loss of executors and computes ``df`` once (a reliable checkpoint computes its
    last stage twice and is not compressed). Shuffle files of the write are dropped at its end.
    ``path``: a ``table_path`` that the caller discards later. ``by``: columns whose values get folders of their own. ``options``, ``mode``:
    of the writer; "append" adds to the table at ``path``.
    """
    spark = df.sparkSession
    path = path or table_path(spark)
    with conf_override(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.partitionBy(*by).mode(mode).options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more (Spark Connect has no file system to ask: it stays)."""
    sc = _context(spark)
    if sc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


FINE = 32       # shuffle partitions for each core, before adaptive execution merges small ones
ADVISORY = "16m"    # shuffled bytes that it merges into one task: some two million edges


def stored_input(df: DataFrame, path: str | None = None) -> DataFrame:
    """``stored(df)`` for input of any size: planned with adaptive execution over many shuffle partitions, which it
    merges to ``ADVISORY`` bytes, so what a task holds does not grow with the input."""
    spark = df.sparkSession
    parts = max(FINE * default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    with conf_override(spark, {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
                               "spark.sql.adaptive.advisoryPartitionSizeInBytes": ADVISORY, "spark.sql.shuffle.partitions": parts}):
        return stored(df, path)
