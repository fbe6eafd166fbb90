"""Tables in the folder that the driver and all executors share.

Cutting lineage with a written Parquet table keeps a job restartable: an executor that is lost later costs a re-read,
never a recomputation of everything before it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset a local folder does on one machine alone; on a cluster, whose executors don't see each other's
    disks, it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_relispan_dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-relispan-", dir="/tmp")
        spark._relispan_dir = base
    return f"{base.rstrip('/')}/relispan-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into a shared folder and read it back; the result has no lineage before the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table of ``shared_table`` that nothing will read again, as rounds leave them."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/relispan-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(*frames: DataFrame) -> None:
    """``drop_table`` for several, and let go of the shuffle files of the jobs that wrote them: Spark deletes those once the
    driver's JVM has collected the plans, which it does late where its memory is large."""
    for df in frames:
        drop_table(df)
    frames[0].sparkSession._jvm.System.gc()
