"""Where lineage is cut: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder. Without one a local session gets a folder of its own; a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        import tempfile

        made = tempfile.mkdtemp(prefix="tidelog-checkpoints-")
        spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = folder(df.sparkSession)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(at)
    return df.checkpoint()
