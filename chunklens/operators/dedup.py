"""First occurrences, roll-ups, file deduplication, set algebra between streams.

First occurrences are aggregates (the least order of each fingerprint), combined before the shuffle, so that a
fingerprint in a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklens.functions.fingerprint import ratio
from chunklens.sources.trace import ORDER


def first_occurrences(trace: DataFrame) -> DataFrame:
    """One row for each fp, where it was first seen."""
    return trace.groupBy("fp").agg(F.min(F.struct(*ORDER)).alias("at")).select("fp", "at.*")


def dedup_stats(trace: DataFrame) -> DataFrame:
    """Chunks, first occurrences and repeats of each (generation, stream)."""
    own = trace.groupBy("generation", "stream").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))
    new = first_occurrences(trace).groupBy("generation", "stream").agg(F.count("*").alias("new"))
    both = own.join(new, ["generation", "stream"], "left").withColumn("unique_chunks", F.coalesce("new", F.lit(0)).cast("bigint")).drop("new")
    return both.withColumn("redundant_chunks", F.col("chunks") - F.col("unique_chunks")).withColumn("redundant_ratio", ratio(F.col("redundant_chunks"), F.col("chunks")))


def with_total(stats: DataFrame) -> DataFrame:
    """Roll-up to (generation, 'total') and ('all', 'total')."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("chunks", "bytes", "unique_chunks", "redundant_chunks")]
    up = stats.select(F.col("generation").cast("string").alias("generation"), "stream", "chunks", "bytes", "unique_chunks", "redundant_chunks").rollup("generation", "stream").agg(*sums)
    return up.withColumns({"generation": F.coalesce("generation", F.lit("all")), "stream": F.coalesce("stream", F.lit("total"))}).withColumn("redundant_ratio", ratio(F.col("redundant_chunks"), F.col("chunks")))


def consecutive_duplicates(ordered: DataFrame) -> DataFrame:
    """Rows whose fp is that of the row before in their stream, over all generations; a leading all-zero fp counts too."""
    w = Window.partitionBy("stream").orderBy("generation", "pos")
    return ordered.withColumn("consec", F.col("fp") == F.lag("fp", 1, "0" * 24).over(w))


def full_files(trace: DataFrame) -> DataFrame:
    """Files against the last stored version of the same name."""
    files = trace.groupBy("generation", "stream", "file_seq", "filename").agg(
        F.md5(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "fp"))), lambda x: x["fp"]))).alias("hash"), F.sum("size").alias("bytes"), F.count("*").alias("n")
    )
    last = F.lag("hash").over(Window.partitionBy("filename").orderBy("generation", "file_seq"))
    known = files.withColumn("redundant", F.coalesce(last == F.col("hash"), F.lit(False)))
    count = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("bigint")
    return known.groupBy("generation").agg(
        F.sum("n").cast("bigint").alias("chunk_count"),
        F.count("*").alias("file_count"),
        count(F.col("redundant"), 1).alias("redundant_files"),
        count(~F.col("redundant"), 1).alias("unique_files"),
        F.sum("bytes").cast("bigint").alias("total_volume"),
        count(F.col("redundant"), F.col("bytes")).alias("redundant_volume"),
    )


def per_stream(trace: DataFrame) -> DataFrame:
    """Occurrences of each fp in each (generation, stream): pre-aggregation for all set operators."""
    return trace.groupBy("generation", "stream", "fp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def fp_usage(trace: DataFrame) -> DataFrame:
    """Per generation and fp: streams that have it, occurrences and bytes."""
    return per_stream(trace).groupBy("generation", "fp").agg(F.count("*").alias("streams"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def stream_similarity(trace: DataFrame) -> DataFrame:
    """Intersection (in all streams), union and share of each generation's fingerprints."""
    streams = trace.groupBy("generation").agg(F.count_distinct("stream").alias("all_streams"))
    usage = fp_usage(trace).join(F.broadcast(streams), "generation")  # one row a generation
    full = F.col("streams") == F.col("all_streams")
    return usage.groupBy("generation").agg(
        F.count("*").alias("all_uniques"),
        F.sum("n").cast("bigint").alias("all_occurrences"),
        F.sum(full.cast("int")).cast("bigint").alias("full_shared"),
        F.sum(F.when(full, F.col("n")).otherwise(0)).cast("bigint").alias("full_shared_occurrences"),
        F.sum((F.col("streams") > 1).cast("int")).cast("bigint").alias("any_shared"),
        F.sum(F.when(F.col("streams") > 1, F.col("bytes")).otherwise(0)).cast("bigint").alias("any_shared_volume"),
    )


def real_uniques(trace: DataFrame) -> DataFrame:
    """Per stream: fingerprints of no other stream of the generation, and those that others have."""
    own = per_stream(trace)
    usage = own.groupBy("generation", "fp").agg(F.count("*").alias("streams"))
    both = own.join(usage, ["generation", "fp"])
    alone = F.col("streams") == 1
    return both.groupBy("generation", "stream").agg(
        F.sum(alone.cast("int")).cast("bigint").alias("real_uniques"),
        F.sum((~alone).cast("int")).cast("bigint").alias("shared_uniques"),
        F.sum(F.when(~alone, F.col("n")).otherwise(0)).cast("bigint").alias("shared_occurrences"),
    )


def usage_histogram(trace: DataFrame) -> DataFrame:
    """Fingerprints in exactly k streams, and their share."""
    counts = fp_usage(trace).groupBy("generation", F.col("streams").alias("k")).agg(F.count("*").alias("fps"))
    whole = counts.groupBy("generation").agg(F.sum("fps").alias("whole"))
    return counts.join(F.broadcast(whole), "generation").select("generation", "k", "fps", (F.col("fps") / F.col("whole")).alias("share"))


def stream_share(trace: DataFrame) -> DataFrame:
    """Cumulative over generations: fingerprints (all-zero ones left out) by the number of streams that had them by then."""
    first = trace.where(F.col("fp") != "0" * 24).groupBy("fp", "stream").agg(F.min("generation").alias("since"))
    ends = trace.select("generation").distinct()
    seen = first.join(F.broadcast(ends), F.col("since") <= F.col("generation")).groupBy("generation", "fp").agg(F.count("*").alias("k"))
    counts = seen.groupBy("generation", "k").agg(F.count("*").alias("fps"))
    streams = trace.groupBy("stream").agg(F.min("generation").alias("since")).join(F.broadcast(ends), F.col("since") <= F.col("generation")).groupBy("generation").agg(F.count("*").alias("num_streams_total"))
    now = trace.groupBy("generation").agg(F.count_distinct("stream").alias("num_streams_gen"))
    whole = counts.groupBy("generation").agg(F.sum("fps").alias("whole"))
    return counts.join(whole, "generation").join(streams, "generation").join(now, "generation").select("generation", "k", "fps", (F.col("fps") / F.col("whole")).alias("share"), "num_streams_gen", "num_streams_total")
