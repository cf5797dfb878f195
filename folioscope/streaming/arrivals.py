"""Versions as they arrive (an extension): each new version of a bill is compared with the one before it.

The state of a bill is the nodes of its last version.  Within a micro-batch the versions that arrived are matched by one
batch job, so a burst of versions costs one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.classify import diff_versions


def compare_arrivals(nodes: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(changes, nodes of each bill's latest version) of a batch of nodes with bill and version_no."""
    every = nodes if last is None else last.unionByName(nodes)
    versions = every.select("bill", "version_no").distinct()
    versions = versions.withColumn("before", F.lag("version_no").over(Window.partitionBy("bill").orderBy("version_no")))
    fresh = versions.join(nodes.select("bill", "version_no").distinct(), ["bill", "version_no"], "left_semi").where("before IS NOT NULL")
    pair = fresh.withColumn("pair_id", F.concat_ws(":", "bill", "before", "version_no"))
    new = every.join(pair, ["bill", "version_no"]).drop("before")
    old = every.join(pair.select("bill", F.col("before").alias("version_no"), "pair_id"), ["bill", "version_no"])
    latest = versions.groupBy("bill").agg(F.max("version_no").alias("version_no"))
    return diff_versions(old, new), every.join(latest, ["bill", "version_no"], "left_semi").select(*nodes.columns)


def watch(stream: DataFrame, state: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that compares what arrives; the state is one Parquet folder for each batch, so a batch can run again."""

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        last = spark.read.schema(batch.schema).parquet(f"{state}/{number - 1}") if number else None
        changes, latest = compare_arrivals(batch, last)
        sink(changes, number)
        latest.write.mode("overwrite").parquet(f"{state}/{number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
