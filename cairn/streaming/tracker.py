"""Structured Streaming over arrivals: completeness, stages, telemetry windows, files once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.graph import complete


def track(arrivals: DataFrame, edges: DataFrame, state_dir: str, out_dir: str, checkpoint: str):
    """Stream of arrived nodes; each batch appends the manifests that became complete to out_dir.

    Arrivals are kept as a table below state_dir, one folder for each batch, overwritten if the batch is run again, so
    a restart neither loses nor repeats one. Returns the writer; the caller starts it.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.select("node").distinct().write.mode("overwrite").parquet(f"{state_dir}/batch={epoch}")
        arrived = spark.read.parquet(state_dir).where(F.col("batch") <= epoch).select("node").distinct()
        done = complete(edges, arrived)
        if epoch:
            done = done.join(complete(edges, spark.read.parquet(state_dir).where(F.col("batch") < epoch).select("node").distinct()), "node", "left_anti")
        done.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def new_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = 100) -> DataFrame:
    """Every file of a folder once: the file source and the query's checkpoint remember those done."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(path)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of event types by tumbling window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))


def stage_errors(records: DataFrame, strict: bool = False) -> DataFrame:
    """(archive, seq, error) of records(archive, seq, kind) that break the order layout, index, blobs[, index].

    An archive starts with its layout; an index follows it; in strict mode there are at most two.
    """
    w = Window.partitionBy("archive").orderBy("seq")
    r = records.withColumn("before", F.lag("kind").over(w)).withColumn("indexes", F.sum((F.col("kind") == "index").cast("int")).over(w))
    error = (
        F.when(F.col("before").isNull() & (F.col("kind") != "layout"), "no layout")
        .when(F.col("before").isNotNull() & (F.col("kind") == "layout"), "second layout")
        .when((F.col("before") == "layout") & (F.col("kind") != "index"), "no index")
        .when(F.lit(strict) & (F.col("kind") == "index") & (F.col("indexes") > 2), "too many indexes")
    )
    return r.withColumn("error", error).where("error is not null").select("archive", "seq", "error")
