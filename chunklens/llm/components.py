"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklens.llm.shared import Scratch

#: Links that a task holds at once.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of 0 to n - 1 reaches over the links (a, b)."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := parent[parent], parent):
            parent = above


def _forest(u: pa.Array, v: pa.Array, moved: bool) -> pa.RecordBatch:
    """One link from each node of the links (u, v) to the least node that it reaches over them."""
    codes = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[codes.indices.to_numpy()]
    parent = forest(at[: len(u)], at[len(u) :], len(order))
    own = np.flatnonzero(parent != np.arange(len(parent)))
    nodes = codes.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array(parent[own])), pa.array(np.full(len(own), moved))], ["u", "v", "moved"])


def contracted(links: DataFrame) -> DataFrame:
    """links(u, v, moved) in fewer rows that join the same nodes, u > v: a forest of each HELD rows of a partition.
    moved is whether a row of those has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > HELD:
                yield of(held)
                held = []
        if held:
            yield of(held)

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v, moved = (pa.concat_arrays([x.column(i) for x in held]) for i in range(3))
        return _forest(u, v, bool(pc.any(moved).as_py()))

    return links.select("u", "v", "moved").mapInArrow(run, links.select("u", "v", "moved").schema)


def components(edges: DataFrame, scratch: Scratch, name: str = "links", rounds: int = 60, held: int = HELD) -> DataFrame:
    """(node, root) of each node of the undirected links (u, v): root is the least node that can be reached.

    Each task first replaces its links by a forest. When at most `held` links are left, one task finishes them, as it
    would hold so many of any table. Else, in rounds, the least neighbour of a node is linked with its
    others, and every link moves up to the least neighbour of its lower end, until none moves or few are left; the result
    of a round is written to the shared folder. Minima are combined before the exchange, and a node with very many links is the key
    of plain joins, which adaptive execution can split. Null ends and loops are left out, repeated links count once; an
    empty table gives an empty result.
    """
    ends = edges.where("u is not null and v is not null and u <> v")
    now = scratch.keep(contracted(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(False).alias("moved"))), f"{name}0")
    for i in range(1, rounds + 1):
        if now.count() <= held:
            now = scratch.keep(contracted(now.coalesce(1)), f"{name}{i}")
            scratch.drop(f"{name}{i - 1}")
            break
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        hooks = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = least.select("u", F.col("m").alias("v"), F.lit(False).alias("hook")).union(hooks.withColumn("hook", F.lit(True)))
        above = least.select(F.col("u").alias("v"), F.col("m").alias("w"))
        jumped = up.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"), (F.col("hook") | F.col("w").isNotNull()).alias("moved"))
        now = scratch.keep(contracted(jumped.where("u <> v")), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
