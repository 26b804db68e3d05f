"""Generations as micro-batches: first occurrences against a growing index, state in Parquet versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklens.functions.fingerprint import ratio


def first_seen(stream: DataFrame) -> DataFrame:
    """The first row of each fp of a stream of chunks. Exact, with state that grows with the distinct fps: a stream of
    generations has no event time that a watermark could use."""
    return stream.dropDuplicates(["fp"])


class GenerationSink:
    """foreachBatch: adds each batch's new fingerprints to the index (one version for each batch, which a repeated batch
    writes again) and its statistics to a table."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("fp").agg(F.min(F.struct("generation", "stream", "file_seq", "chunk_seq")).alias("at"))
        known = [f"{self.path}/index/batch={i}" for i in range(batch_id)]
        if known:
            new = new.join(spark.read.schema("fp string").parquet(*known), "fp", "left_anti")
        new.select("fp", "at.*").write.mode("overwrite").parquet(f"{self.path}/index/batch={batch_id}")
        new = spark.read.parquet(f"{self.path}/index/batch={batch_id}")
        own = batch.groupBy("generation", "stream").agg(F.count("*").alias("chunks"))
        firsts = new.groupBy("generation", "stream").agg(F.count("*").alias("unique_chunks"))
        stats = own.join(firsts, ["generation", "stream"], "left").fillna(0)
        stats.withColumn("unique_ratio", ratio(F.col("unique_chunks"), F.col("chunks"))).write.mode("overwrite").parquet(f"{self.path}/stats/batch={batch_id}")

    def stats(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/stats")
