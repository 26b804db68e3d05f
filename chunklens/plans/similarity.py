"""Sorted indexes that similar streams share: which index each stream of a generation runs on, and its statistics there."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklens.operators.sortedindex import group_index_stats
from chunklens.plans.simulate import trace_groups


def _share(own: list[str], other: list[str], entries: int) -> float:
    """The share of own among the first entries of the union."""
    page = sorted({*own, *other})[:entries]
    return len({*page} & {*own}) / len(page) if page else 0.0


def assign(files: Iterable[tuple[int, str, list[str]]], entries: int, threshold: float) -> Iterator[tuple[int, str, int]]:
    """(generation, stream, index) of files(generation, stream, least fingerprints) in order of generations.

    A stream stays with the index that was made for it. Another takes the existing index of the greatest utility, the
    later on ties, if that reaches the threshold; it is not bound by that and chooses anew in the next generation. The
    rest is grouped, and each group has a new index. The utility is the index's share of the merged first page, times
    n / (n + 1) for the n streams that it was made for, halved: the stream's own share has a weight of 0, as in the
    original, where that weight is a quotient of integers.
    """
    pages: list[list[str]] = []
    made_for: list[int] = []
    bound: dict[str, int] = {}
    for generation, group in groupby(files, key=lambda f: f[0]):
        heads = {stream: head for _, stream, head in group}
        chosen = {s: bound[s] for s in heads if s in bound}
        fresh = []
        for s in sorted(heads.keys() - chosen.keys()):
            worth = [(_share(page, heads[s], entries) * n / (n + 1) / 2, i) for i, (page, n) in enumerate(zip(pages, made_for, strict=True))]
            best, i = max(worth, default=(-1.0, 0))
            if best >= threshold:
                chosen[s] = i
            else:
                fresh.append(s)
        utility = {(a, b): _share(heads[a], heads[b], entries) for a in fresh for b in fresh if a != b}
        for members in trace_groups(utility, fresh, threshold) if fresh else []:
            bound |= dict.fromkeys(members, len(pages))
            chosen |= {s: bound[s] for s in members}
            pages.append([])
            made_for.append(len(members))
        for s, i in chosen.items():
            pages[i] = sorted({*pages[i], *heads[s]})[:entries]
        yield from ((generation, s, i) for s, i in sorted(chosen.items()))


def first_entries(trace: DataFrame, entries: int) -> DataFrame:
    """(generation, stream, head): the least distinct fingerprints of each stream of a generation, ascending.

    No merged first page of two streams or of a stream and an index goes beyond them.
    """
    least = Window.partitionBy("generation", "stream").orderBy("fp")
    own = trace.select("generation", "stream", "fp").distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= entries)
    return own.groupBy("generation", "stream").agg(F.array_sort(F.collect_list("fp")).alias("head"))


def assignment(trace: DataFrame, entries: int, threshold: float) -> DataFrame:
    """(generation, stream, index): the driver walks over one page of fingerprints for each trace file, a file at a time."""
    files = ((r["generation"], r["stream"], r["head"]) for r in first_entries(trace, entries).orderBy("generation", "stream").toLocalIterator())
    return trace.sparkSession.createDataFrame(list(assign(files, entries, threshold)), "generation int, stream string, index bigint")


def similarity_index_stats(trace: DataFrame, entries: int, threshold: float) -> DataFrame:
    """group_index_stats of every stream on the index that it is assigned to. Streams are not null: they name hosts."""
    return group_index_stats(trace.join(assignment(trace, entries, threshold), ["generation", "stream"]), entries)
