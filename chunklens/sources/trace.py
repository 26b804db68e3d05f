"""Chunk traces: rows (generation, stream, file_seq, filename, chunk_seq, fp, size), in the order of ORDER."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Total order of a run, streams one after the other.
ORDER = ["generation", "stream", "file_seq", "chunk_seq"]


def backup_trace(spark: SparkSession, sf_dir: str, generations: int = 4) -> DataFrame:
    """Lines of documents as chunks, in generations; about a quarter of the distinct lines change each time."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_seq", "line"))
    size = F.octet_length("line")
    return lines.withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(generations - 1)))).select(
        "generation",
        F.col("source").alias("stream"),
        F.col("doc_id").alias("file_seq"),
        F.concat(F.lit("doc"), F.col("doc_id")).alias("filename"),
        "chunk_seq",
        F.substring(F.md5(F.concat("line", F.lit("|v"), F.floor((F.col("generation") + size) / 4).cast("string"))), 1, 24).alias("fp"),
        size.cast("bigint").alias("size"),
    )


def late_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backup_trace with streams that begin up to two generations later, by a hash of their names."""
    return backup_trace(spark, sf_dir).withColumn("generation", F.col("generation") + (F.conv(F.substring(F.md5("stream"), 1, 2), 16, 10).cast("int") % 3))


def sorted_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backup_trace with each stream in order of fingerprints: pos is the position in the stream of a generation."""
    from pyspark.sql import Window

    w = Window.partitionBy("generation", "stream").orderBy("fp", "file_seq", "chunk_seq")
    return backup_trace(spark, sf_dir).withColumn("pos", F.row_number().over(w))


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int").alias("generation"),
        F.col("event_type").alias("stream"),
        F.col("user_id").alias("file_seq"),
        F.col("event_id").alias("chunk_seq"),
        F.substring(F.md5(F.concat(F.col("user_id").cast("string"), F.lit("|"), F.coalesce("props", F.lit("")))), 1, 24).alias("fp"),
    )


def lineitem_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an order: for operators that need none."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.concat("l_returnflag", "l_linestatus").alias("stream"),
        F.substring(F.md5(F.concat(F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_quantity").cast("int").cast("string"))), 1, 24).alias("fp"),
    )


#: Data sets, whether their generations run backwards, and mean chunk sizes in KB.
DATA_SETS = {
    "jgu4": (True, 8), "jgu4r": (True, 8), "jgu20_cdc8r": (True, 8), "jgu20_cdc2r": (True, 2), "jgu20_cdc4r": (True, 4), "jgu20_cdc16r": (True, 16),
    "ms_cdc8r": (False, 8), "ms_cdc16r": (False, 16), "multi": (False, 8), "imt": (False, 8),
}
#: Names of trace files; group 2 is the generation.
PATTERNS = {"jgu": r"(ma.+)_w([0-9]+)_r[0-9]+-cdc([0-9]+)", "ms": r"(ms)_w([0-9]+)-cdc([0-9]+)", "multi": r"(gen)_([0-9]+)_(.+)", "imt": r"(chunks-upb)-([0-9]+)-rabin8"}


def data_set(name: str) -> tuple[str, bool, int]:
    """(pattern of file names, reverse, mean chunk size in bytes) of a data set; multi matches as a prefix."""
    key = "multi" if name.startswith("multi") else name
    if key not in DATA_SETS:
        raise ValueError(f"unknown data set {name}")
    reverse, kb = DATA_SETS[key]
    return PATTERNS[next(p for p in PATTERNS if key.startswith(p))], reverse, kb * 1024


def host(name: str, dataset: str) -> str:
    """The stream of a trace file."""
    return name.split("_")[-1].split("-")[0] if "multi" in dataset else "host0"


def trace_files(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """(path, name, id, generation, stream) of a data set's trace files in a folder; files without bytes are left out."""
    return listed(spark.read.format("binaryFile").load(folder).where("length > 0").select("path"), dataset)


def listed(files: DataFrame, dataset: str) -> DataFrame:
    """trace_files of files(path): those with the data set's pattern; equal ids, decimal, are one generation, from 0."""
    from pyspark.sql import Window

    pattern, reverse, _ = data_set(dataset)
    found = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").rlike(pattern)).withColumn("id", F.regexp_extract("name", pattern, 2).cast("int"))
    order = F.col("id").desc() if reverse else F.col("id")
    stream = F.split(F.element_at(F.split("name", "_"), -1), "-")[0] if "multi" in dataset else F.lit("host0")
    # One row a file: the list of files, not the trace, is what this window numbers.
    return found.withColumn("generation", F.dense_rank().over(Window.orderBy(order)) - 1).withColumn("stream", stream)
