"""Tables written to the folder that a cluster shares: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where nothing set it and all runs on one machine (tests) a temporary folder takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that may be gone already."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may have ended; the folder is the cluster's to clean
        return


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/weft-{tag}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads again, and let Spark drop shuffles nobody refers to."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/weft-" in path:
                delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    It also fixes values that a recomputation could change, such as the bounds of a range partitioning.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
