"""Where jobs may put tables that other executors must be able to read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Unset, a local session gets a scratch folder; on a cluster the setting is required, because
    a folder on one machine is invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _SCRATCH:
        _SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="holdfast-")
    return _SCRATCH[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` worked out once: a table below the shared folder, which later steps read however many they are and which outlives
    executors. It goes when the application ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative fits (boosted trees) a place to cut their lineage."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
