"""Running a stream over what is there now, into tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relispan.plans.shared import shared_dir


def read_files(spark: SparkSession, folder: str, pattern: str, schema, files_at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder whose names fit a pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


def run_now(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all input there is: its rows with ``batch``, the number of the batch that made them.

    Every batch is written under its number, so that one that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = shared_dir(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/n={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{base}/out/*")
