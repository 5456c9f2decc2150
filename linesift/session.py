"""Session helpers.

The library does not own the cluster: on a cluster the session comes from the
caller.  Shared folders for checkpoints and streaming state come from
``spark.checkpoint.dir``; a local default is only set where it is unset (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "linesift",
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LINESIFT_DRIVER_MEMORY", "12g"))
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context).

    Raises when neither is set: on a cluster a machine-local temporary folder
    is never a valid place for lineage cuts or streaming state.
    """
    root = None
    try:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - sessions without a local context (Spark Connect)
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """``checkpoint_root``; for a local master that names none, where driver and tasks share one disk, a temporary folder."""
    try:
        return checkpoint_root(spark)
    except RuntimeError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        return f"file:{tempfile.gettempdir()}/linesift-shared"


def written(df, name: str):
    """``df`` computed once: written to the shared folder and read back.  Without one it is persisted instead."""
    spark = df.sparkSession
    try:
        path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    except RuntimeError:
        from pyspark import StorageLevel

        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df):
    """Compute ``df`` once for several consumers, keeping its partitioning.

    Nothing runs before the first action.  ``df`` ends in a shuffle, whose files all
    consumers share.  With a shared checkpoint folder the first action also writes a
    reliable checkpoint (lineage cut, survives executor loss).  Without one:
    ``persist(MEMORY_AND_DISK)``; lost blocks are recomputed from lineage.
    The staged plan is built without AQE, which would otherwise hide its hash
    partitioning from the consumers (they then need no further shuffle).
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    try:
        checkpoint_root(spark)
        has_dir = True
    except RuntimeError:
        has_dir = False
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if not has_dir:
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not spark.sparkContext.getCheckpointDir():
                spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
        except Exception:  # noqa: BLE001 - no local context: the server-side setting applies
            pass
        return df.checkpoint(eager=False)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


SPREAD_MAX_BYTES = 1 << 30  # inputs up to this size may be round-robin spread over the task slots


def balanced(df, factor: int = 2, max_bytes: int = SPREAD_MAX_BYTES):
    """Spread a small scan that has fewer partitions than the cluster has task slots.

    A file with one Parquet row group is read by one task however it is split,
    which would put all regex and Python work of the query into that task.
    When the estimated input is at most ``max_bytes`` (shuffling it is cheap)
    and the scan has fewer partitions than slots, it is round-robin
    repartitioned to ``factor`` x slots; filters and column pruning still reach
    the scan below the repartition.  Larger inputs are never touched: they
    already have many splits, and a full shuffle would cost more than it gives.
    """
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= slots:
            return df
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no plan statistics available (e.g. Spark Connect): leave the scan as it is
        return df
    if size > max_bytes:
        return df
    return df.repartition(slots * factor)
