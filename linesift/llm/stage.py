"""Written intermediate tables and global row order, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Low bits of ``monotonically_increasing_id``: the row's place in its partition (Spark's documented layout).
ROW_BITS = (1 << 33) - 1


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder that all executors share")
        root = f"{tempfile.gettempdir()}/linesift-checkpoints"
    return root.rstrip("/")


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends here.

    The files stay until the folder is cleared: returned frames read them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, keys: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Stage ``df`` sorted over ``keys``, with the columns ``_part`` (range partition) and ``_at`` (place in it).

    One range shuffle.  A hot value of a leading key is split by the later keys, so no task takes a whole group.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return stage(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}), name)


def numbered(staged: DataFrame, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Rows of :func:`ordered` with ``_rank``: the row's number from 0 over the whole table, or in its group.

    ``groups`` must be the leading sort keys.  Only one row per partition (and group) is summed up and joined back.
    """
    from pyspark.sql import Window

    g = groups or []
    heads = staged.groupBy("_part", *g).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One window over the heads: a row per partition (and per group in it), never the rows themselves.
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    heads = heads.withColumn("_before", F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    heads = heads.select("_part", *[F.col(c).alias(f"_g_{c}") for c in g], "_first", F.coalesce("_before", F.lit(0)).alias("_before"))
    on = staged["_part"] == heads["_part"]
    for c in g:
        on = on & staged[c].eqNullSafe(heads[f"_g_{c}"])
    out = staged.join(heads, on, "inner").drop(heads["_part"])
    return out.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_first", "_before", *[f"_g_{c}" for c in g])
