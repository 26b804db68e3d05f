"""Segments, containers and blocks: cutting ordered streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklens.functions.fingerprint import is_hook, is_landmark
from chunklens.sources.trace import ORDER

_WITHIN = ["file_seq", "chunk_seq"]


def landmark_segments(trace: DataFrame, divisor: int) -> DataFrame:
    """trace with seg, the number of the segment in its stream of the generation; a landmark ends its segment."""
    before = Window.partitionBy("generation", "stream").orderBy(*_WITHIN).rowsBetween(Window.unboundedPreceding, -1)
    return trace.withColumn("seg", F.coalesce(F.sum(is_landmark(F.col("fp"), divisor).cast("int")).over(before), F.lit(0)).cast("bigint"))


def segment_stats(segments: DataFrame, factor: int) -> DataFrame:
    """Per generation and stream: segments, mean chunks and hooks a segment."""
    each = segments.groupBy("generation", "stream", "seg").agg(F.count("*").alias("chunks"), F.count_distinct(F.when(is_hook(F.col("fp"), factor), F.col("fp"))).alias("hooks"), F.sum("size").alias("bytes"))
    return each.groupBy("generation", "stream").agg(
        F.count("*").alias("segments"),
        F.sum("chunks").cast("bigint").alias("chunks"),
        F.sum("hooks").cast("bigint").alias("hooks"),
        F.sum((F.col("hooks") == 0).cast("int")).cast("bigint").alias("zero_hook_segments"),
        (F.sum("chunks") / F.count("*")).alias("mean_chunks"),
        (F.sum("hooks") / F.count("*")).alias("mean_hooks"),
    )


def fixed_segments(trace: DataFrame, segment_bytes: int) -> DataFrame:
    """trace with seg: a segment closes before the chunk that would bring it to segment_bytes."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, seg, held, n = rows.sort_values(_WITHIN), [], 0, 0, 0
        for size in rows["size"]:
            if held + size >= segment_bytes and n:
                seg, held, n = seg + 1, 0, 0
            held, n = held + size, n + 1
            out.append(seg)
        return rows.assign(seg=out)[["generation", "stream", "file_seq", "chunk_seq", "fp", "size", "seg"]]

    return trace.groupBy("generation", "stream").applyInPandas(cut, "generation int, stream string, file_seq bigint, chunk_seq int, fp string, size bigint, seg bigint")


def containers(unique: DataFrame, container_bytes: int) -> DataFrame:
    """unique (first occurrences with size) with container: next fit by bytes along each stream over all generations.

    Container 0 is the empty one that the first chunk commits; a chunk larger than a container has one of its own.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, number, free = rows.sort_values(["generation", *_WITHIN]), [], 0, 0
        for size in rows["size"]:
            if free < size:
                number, free = number + 1, container_bytes
            free = max(0, free - size)
            out.append(number)
        return rows.assign(container=out)[["stream", "generation", "file_seq", "chunk_seq", "fp", "size", "container"]]

    return unique.groupBy("stream").applyInPandas(pack, "stream string, generation int, file_seq bigint, chunk_seq int, fp string, size bigint, container bigint")


def blocks(trace: DataFrame, block_bytes: int) -> DataFrame:
    """(stream, generation, block, fp): the distinct mapping of blocks along each stream of a generation; the chunk that
    fills a block is in it and in the next."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, number, offset = rows.sort_values(_WITHIN), set(), 0, 0
        for fp, size in zip(rows["fp"], rows["size"], strict=True):
            if offset + size >= block_bytes:
                out.add((number, fp))
                number, offset = number + 1, size
            else:
                offset += size
            out.add((number, fp))
        head = rows.iloc[0]
        return pd.DataFrame([(head["stream"], head["generation"], n, fp) for n, fp in sorted(out)], columns=["stream", "generation", "block", "fp"])

    return trace.groupBy("generation", "stream").applyInPandas(pack, "stream string, generation int, block bigint, fp string")


def numbered(segments: DataFrame, factor: int) -> DataFrame:
    """(sid, generation, stream, seg, fp): distinct hooks of each segment that has any, sid in order of the run from 1."""
    hooks = segments.where(is_hook(F.col("fp"), factor)).select("generation", "stream", "seg", "fp").distinct()
    # The numbering takes one row a segment with hooks: 1 / 2 ** factor of the chunks at most.
    ids = hooks.select("generation", "stream", "seg").distinct().withColumn("sid", F.row_number().over(Window.orderBy("generation", "stream", "seg")).cast("bigint"))
    return hooks.join(ids, ["generation", "stream", "seg"])


def recent_segments(hooks: DataFrame, most: int) -> DataFrame:
    """(sid, fp, candidate): for each hook of a segment, the `most` newest earlier segments that have it.

    The newest earlier occurrences are the rows just before in the hook's own order, so that lags find them: no join,
    and no pairs but those returned.
    """
    w = Window.partitionBy("fp").orderBy("sid")
    found = F.filter(F.array(*(F.lag("sid", i).over(w) for i in range(1, most + 1))), lambda x: x.isNotNull())
    return hooks.select("sid", "fp", found.alias("found")).select("sid", "fp", F.explode("found").alias("candidate"))


def champions(candidates: DataFrame, most: int) -> DataFrame:
    """(sid, rank, champion, hooks): greedy cover of each segment's hooks, the larger id on ties, `most` at most.

    Segments go to the function a thousand ids at a time, as a call for each would cost more than its work.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        each: dict[int, dict[int, set]] = {}
        for sid, fp, candidate in zip(rows["sid"], rows["fp"], rows["candidate"], strict=True):
            each.setdefault(int(sid), {}).setdefault(int(candidate), set()).add(fp)
        out = []
        for sid, left in each.items():
            rank = 0
            while left and rank < most:
                best, rank = max(left, key=lambda c: (len(left[c]), c)), rank + 1
                own = left.pop(best)
                out.append((sid, rank, best, len(own)))
                left = {c: rest for c, s in left.items() if (rest := s - own)}
        return pd.DataFrame(out, columns=["sid", "rank", "champion", "hooks"])

    some = candidates.withColumn("some", F.floor(F.col("sid") / 1000))
    return some.groupBy("some").applyInPandas(choose, "sid bigint, rank int, champion bigint, hooks bigint")


def sparse_dedup(segments: DataFrame, hooks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per generation and stream: unique chunks, repeats found in a champion and repeats that were not."""
    ids = hooks.select("generation", "stream", "seg", "sid").distinct()
    rows = segments.join(ids, ["generation", "stream", "seg"], "left")
    content = segments.join(ids, ["generation", "stream", "seg"]).select(F.col("sid").alias("champion"), "fp").distinct()
    found = chosen.select("sid", "champion").join(content, "champion").select("sid", "fp").distinct().withColumn("hit", F.lit(True))
    first = segments.groupBy("fp").agg(F.min(F.struct(*ORDER)).alias("first"))
    both = rows.join(found, ["sid", "fp"], "left").join(first, "fp").withColumn("is_new", F.col("first") == F.struct(*ORDER))
    hit = F.coalesce("hit", F.lit(False))
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    return both.groupBy("generation", "stream").agg(
        F.count("*").alias("chunks"), count(hit).alias("detected"), count(~hit & F.col("is_new")).alias("unique_chunks"), count(~hit & ~F.col("is_new")).alias("undetected")
    )
