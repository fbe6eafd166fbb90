"""Registered queries that run as streams over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relispan.plans import catalog
from relispan.plans.shared import shared_dir, shared_table
from relispan.streaming import profile, run

PARTS = 4


def stream_counts(spark, sf_dir: str) -> DataFrame:
    """Events by hour and type, counted as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = run.read_files(spark, sf_dir, "events.parquet", schema)
    counts = events.groupBy(F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("series_id")).agg(F.count("*").alias("n"))
    return run.run_now(counts, "complete").drop("batch")


def stream_profile(spark, sf_dir: str) -> DataFrame:
    """The matrix profile of hourly means, fed in parts of equal spans of samples and kept up to date by each."""
    series = catalog.scaled(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")).select("series_id", "i", "v")
    series = shared_table(series, "scaled")
    last = series.agg(F.max("i")).first()[0] or 0
    step = last // PARTS + 1
    folder = f"{shared_dir(spark)}/series"
    for k in range(PARTS):  # a file for each part, written in order
        series.filter((F.col("i") >= k * step) & (F.col("i") < (k + 1) * step)).coalesce(1).write.mode("append").parquet(folder)
    stream = run.read_files(spark, folder, "*.parquet", series.schema, files_at_once=1)
    rows = run.run_now(profile.incremental_profile(stream, catalog.M), "update")
    newest = rows.groupBy("series_id", "i").agg(F.max(F.struct("batch", "p")).alias("r"))
    return newest.select("series_id", "i", catalog.r6("r.p", "p"))


catalog.QUERIES |= {"stream_counts": stream_counts, "stream_profile": stream_profile}
catalog.SQL["stream_counts"] = "SELECT date_trunc('hour', ts) AS t, event_type AS series_id, count(*) AS n FROM events GROUP BY 1, 2"
catalog.SQL["stream_profile"] = f"{catalog.P} SELECT series_id, i, round(p, 6) AS p FROM p"
