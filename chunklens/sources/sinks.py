"""Results: JSON documents of statistics, I/O traces, lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(own: dict) -> dict:
    """Statistics with ratios as 32-bit floats print."""
    return {k: float(f"{v:.8g}") if isinstance(v, float) else v for k, v in own.items()}


def _by_stream(stats: DataFrame, by: str, label: str) -> dict:
    """{label of by: {stream: statistics}}; rows without a column stream are of the total."""
    out: dict = {}
    for row in stats.collect():
        own = row.asDict(recursive=True)
        key = label.format(own.pop(by))
        stream = own.pop("stream", "total")
        out.setdefault(key, {})[stream] = _plain(own)
    return out


def _write(out: dict, path: str) -> None:
    with open(path, "w") as f:  # truncates an older, longer result
        json.dump(out, f, indent=4, sort_keys=True)


def results_json(stats: DataFrame, path: str, by: str = "generation", label: str = "generation {}") -> None:
    """{"generation i": {stream: statistics, ...}}, four spaces deep; ratios as 32-bit floats.

    stats is a table of statistics: a row for each generation and stream, which the driver holds whole.
    """
    _write(_by_stream(stats, by, label), path)


def analysis_json(similarity: DataFrame, streams: DataFrame, total: DataFrame, path: str) -> None:
    """{"generation i": {"similarity": ..., "streams": {stream: statistics}, "total": ...}} of three tables of statistics:
    a row for each generation, but for streams one for each generation and stream. A generation that a table lacks has
    an empty object there."""
    label = "generation {}"
    alone = {k: {g: x["total"] for g, x in _by_stream(df.drop("stream"), "generation", label).items()} for k, df in (("similarity", similarity), ("total", total))}
    parts = alone | {"streams": _by_stream(streams, "generation", label)}
    _write({g: {k: x.get(g, {}) for k, x in parts.items()} for g in set().union(*parts.values())}, path)


def page_usage_json(stats: DataFrame, path: str, start: DataFrame | None = None) -> None:
    """{number of clients: {stream or "total": statistics}}; start: the rows of the state before any client, as "0"."""
    out = _by_stream(stats, "clients", "{}")
    if start is not None:
        out |= _by_stream(start.withColumn("clients", F.lit(0)), "clients", "{}")
    _write(out, path)


def list_json(stats: DataFrame, path: str) -> None:
    with open(path, "w") as f:
        json.dump([r.asDict(recursive=True) for r in stats.collect()], f, indent=4)


def statistics(stats: DataFrame, path: str) -> None:
    """One JSON line for each row, written by the executors."""
    stats.write.mode("overwrite").json(path)


def io_trace(ios: DataFrame, path: str) -> None:
    """(stream, id) as gzip-compressed tab-separated lines."""
    ios.select("stream", "id").write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def lines(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """Text or numbers, one a line; by: a folder for each value (the rounds of a generation)."""
    writer = df.select(F.col(column).cast("string").alias("value"), *([by] if by else [])).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)
