"""Repeated paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line of at least `min_words` words (letters, digits and all characters beyond ASCII; A-Z lower-cased),
or a run of shorter lines next to each other with so many in all; its set is that of the distinct 5-word shingles.
Equal sets are one node. Nodes that share a band of minima are candidates; links are confirmed on the full sets, which
a second reading of the texts gives for the candidates alone: it is narrowed by a bit set that is built from the
candidates and broadcast.

A passage that lies within different lines is found over sliding paragraphs: each run of `span` words of a text is one,
and of each `window` runs in a row the one with the least hash of its first shingle, a MinHash register of what the runs
cover, stands for all (winnowing). So two texts that share `span + window - 1` words, 50, choose a run in common, and
from there the words before and after are compared, so that shared passages are reported whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklens.llm.near_dedup import bit_set, filter_bits, is_in, linked
from chunklens.llm.shared import Scratch
from chunklens.llm.textbytes import ALNUM_WORDS, blocks, buffers, mix, sequence_hashes, spans, word_hashes

_U = np.uint64
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _paragraphs(column, k: int, min_words: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, number of its first line in the text, words, sorted distinct shingle hashes) of each paragraph."""
    for lo, _, data, offsets in blocks(column):
        starts, ends, _ = spans(data, offsets, ALNUM_WORDS)
        words = word_hashes(data, starts, ends)
        line_s, _, line_at = spans(data, offsets, _LINE)
        if not len(line_s):
            continue
        breaks = np.cumsum(data == 0x0A)
        number, row = breaks[line_s], np.repeat(np.arange(len(line_at) - 1), np.diff(line_at))
        limits = np.append(np.searchsorted(starts, line_s), len(starts))
        count = np.diff(limits)
        alone = (count >= min_words) | (count == 0)  # else a line goes on with the line before, if that is short too and next to it
        first = np.ones(len(count), bool)
        first[1:] = alone[1:] | alone[:-1] | (row[1:] != row[:-1]) | (number[1:] > number[:-1] + 1)
        first = np.flatnonzero(first)
        limits, row, number = limits[np.append(first, len(count))], row[first], number[first]
        hashes, at = sequence_hashes(words, limits, k)
        count = np.diff(limits)
        cut = np.searchsorted(at, np.arange(len(count) + 1))
        before = np.concatenate([[0], breaks])[offsets[:-1]]
        for i in np.flatnonzero(count >= min_words):
            yield lo + int(row[i]), int(number[i] - before[row[i]]), int(count[i]), np.unique(hashes[cut[i] : cut[i + 1]])


def _key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _minima(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The low bits of the least of m hash functions over each set."""
    random = np.random.default_rng(19970611)
    times, plus = random.integers(1, 1 << 32, m, dtype=np.uint32) | np.uint32(1), random.integers(0, 1 << 32, m, dtype=np.uint32)
    low = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), m), np.uint16)
    for i in range(m):
        y = low * times[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = (np.minimum.reduceat(y + plus[i], first) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sketched(docs: DataFrame, k: int, min_words: int, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, some: list) -> pa.RecordBatch:
            regs = _minima([x[3] for x in some], m)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[x[0]] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int32()), pa.array([x[2] for x in some], pa.int32()),
                    pa.array([_key(x[3]) for x in some], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([len(x[3]) for x in some], pa.int64()),
                ],
                ["doc_id", "line", "words", "node", "regs", "n"],
            )

        for batch in batches:
            ids, some = batch.column(0).cast(pa.int64()).to_pylist(), []
            for x in _paragraphs(batch.column(1), k, min_words):
                some.append(x)
                if len(some) >= 5000:
                    yield made(ids, some)
                    some = []
            if some:
                yield made(ids, some)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, line int, words int, node binary, regs binary, n bigint")


def _sets_of(docs: DataFrame, some: DataFrame, k: int, min_words: int) -> DataFrame:
    """(node, hashes) of the nodes of `some`, each once: a second reading of the texts, of which a bit set says what is
    wanted."""
    bits = filter_bits(some)
    sent = docs.sparkSession.sparkContext.broadcast(bit_set(some.select(F.expr(f"cast(conv(hex(substring(node, 1, 4)), 16, 10) as bigint) % {bits}L").alias("bit")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out, held = [], 0
            for _, _, _, hashes in _paragraphs(batch.column(0), k, min_words):
                key = _key(hashes)
                bit = int.from_bytes(key[:4], "big") & (bits - 1)
                if int(own[bit >> 6]) >> (bit & 63) & 1:
                    out.append((key, hashes.tobytes()))
                    held += len(out[-1][1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["node", "hashes"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["node", "hashes"])

    # Aggregated before the join: a paragraph that very many texts share comes from each task once.
    return docs.select("text").mapInArrow(run, "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")).join(some.select("node"), "node", "left_semi")


def repeated_paragraphs(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 20, bands: int = 10, rows: int = 3) -> DataFrame:
    """(doc_id, line, words, cluster_doc, cluster_line, n_docs, n_paragraphs, kept) of each paragraph that repeats in
    another document, docs(doc_id, text, ...).

    A cluster is a component of links of 100 * intersection >= percent * union; cluster_doc and cluster_line are its
    least paragraph, the one that is kept. Clusters within one document are left out. With the default bands, a pair
    just at 80 % shares none with probability 0.0008; a pair of 90 % with 0.000002.

    Null and empty texts, and runs of lines with fewer words, have no paragraphs. Rows with a null doc_id are left out. Rows with
    the same doc_id are one document. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    docs = docs.where("doc_id is not null")
    all_of = scratch.keep(_sketched(docs, k, min_words, bands * rows), "all")
    nodes = scratch.keep(
        all_of.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("least"), F.max("doc_id").alias("last_doc"), F.count("*").alias("copies"), F.first("regs").alias("regs"), F.first("n").alias("n")), "nodes"
    )
    found = scratch.keep(linked(nodes.select("node", "regs", "n"), lambda some: _sets_of(docs, some, k, min_words), percent, rows, bands * rows, scratch, likelihood=False), "found")
    of = scratch.keep(nodes.select("node", "least", "last_doc", "copies").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "of")
    # Of one document are the clusters whose least and last document are the same.
    clusters = scratch.keep(
        of.groupBy("root").agg(F.min("least").alias("least"), F.max("last_doc").alias("last_doc"), F.sum("copies").alias("n_paragraphs")).where("least.doc_id <> last_doc"), "clusters"
    )
    named = scratch.keep(of.select("node", "root").join(clusters.select("root", "least", "n_paragraphs"), "root").select("node", "root", "least", "n_paragraphs"), "named")
    members = scratch.keep(all_of.select("doc_id", "line", "words", "node").join(named, "node"), "members")
    in_docs = scratch.keep(members.select("root", "doc_id").distinct().groupBy("root").agg(F.count("*").alias("n_docs")), "in_docs")
    scratch.drop("all", "nodes", "found", "links", "of", "clusters", "named")
    return members.join(in_docs, "root").select(
        "doc_id", "line", "words", F.col("least.doc_id").alias("cluster_doc"), F.col("least.line").alias("cluster_line"), "n_docs", "n_paragraphs",
        ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("line") == F.col("least.line"))).alias("kept"),
    )


def _sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over each n values in a row, by doubling."""
    own, width = values, 1
    while 2 * width <= n:
        own, width = pick(own[:-width], own[width:]), 2 * width
    return own if width == n else pick(own[: len(values) - n + 1], own[n - width :])


def _chosen(words: np.ndarray, row: np.ndarray, k: int, span: int, window: int) -> np.ndarray:
    """The first words of the chosen runs."""
    m = len(words) - span + 1
    if m < window:
        return np.zeros(0, np.int64)
    first = np.full(m, _U(k), _U)
    for j in range(k):
        first = first * _U(0xD6E8FEB86659FD93) + words[j : m + j]
    first = mix(first)
    least = _sliding(first, window, np.minimum)
    least[row[: len(least)] != row[span + window - 2 :]] = 0
    edge = np.zeros(window - 1, _U)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == first)


def _run_hashes(words: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    out = np.full(len(at), _U(span), _U)
    for j in range(span):
        out = out * _U(0xD6E8FEB86659FD93) + words[at + j]
    return mix(out)


def _seeds(column, k: int, span: int, window: int, sent: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, seed) of the chosen runs of the texts, equal ones of a text once. With a bit set, of those in it, at every
    place: (row, seed, place: line and word, and 32-bit hashes of the window - 1 words before, nearest first, and after;
    0 beyond the text)."""
    for lo, _, data, offsets in blocks(column):
        starts, ends, limits = spans(data, offsets, ALNUM_WORDS)
        words, row = word_hashes(data, starts, ends), np.repeat(np.arange(len(limits) - 1), np.diff(limits))
        at = _chosen(words, row, k, span, window)
        seed = _run_hashes(words, at, span)
        if sent is None:
            once = np.unique(np.stack([row[at].astype(_U), seed]), axis=1) if len(at) else np.zeros((2, 0), _U)
            yield lo + once[0].astype(np.int64), once[1].view(np.int64)
            continue
        hit = is_in(sent, seed)
        at, seed = at[hit], seed[hit]
        if not len(at):
            continue
        short = (words >> _U(32)).astype(np.uint32) | np.uint32(1)
        step, own = np.arange(1, window), row[at]

        def beside(where: np.ndarray, own: np.ndarray = own, short: np.ndarray = short, limits: np.ndarray = limits) -> np.ndarray:
            inside = (where >= limits[own][:, None]) & (where < limits[own + 1][:, None])
            return np.where(inside, short[np.clip(where, 0, len(short) - 1)], np.uint32(0))

        yield lo + own, seed.view(np.int64), at - limits[own], beside(at[:, None] - step), beside(at[:, None] + span - 1 + step)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix))])


def _extents(pairs: DataFrame, window: int) -> DataFrame:
    """pairs(..., before, after, hub_before, hub_after) with fore and aft, the numbers of equal words, in their place."""
    names = [c for c in pairs.columns if c not in ("before", "after", "hub_before", "hub_after")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def equal(x, y) -> pa.Array:
            x, y = (buffers(c)[0].view(np.uint32).reshape(-1, window - 1) for c in (x, y))
            same = (x == y) & (x != 0)
            return pa.array(np.where(same.all(1), window - 1, same.argmin(1)).astype(np.int32))

        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            yield pa.RecordBatch.from_arrays([*(column[c] for c in names), equal(column["before"], column["hub_before"]), equal(column["after"], column["hub_after"])], [*names, "fore", "aft"])

    return pairs.mapInArrow(run, pairs.select(*names).schema.add("fore", "integer").add("aft", "integer"))


def shared_passages(docs: DataFrame, k: int = 5, span: int = 25, window: int = 26) -> DataFrame:
    """(doc_id, word, words, cluster_doc, n_docs, kept) of the passages that documents share word for word, whole, at
    every place, docs(doc_id, text, ...); word is the number of the word in the text at which a passage begins, words
    is its length.

    A passage is found from its seeds, the chosen runs that another document has chosen too. Each place of a seed is
    held against the seed's first place in the least document, cluster_doc: the words before and after, up to window - 1
    on either side, that are equal to those there belong to the passage, and what overlaps by span - 1 words, at the
    same distance from the least document's, is one passage; one within another of the document is left out. Of the least document itself (kept) it is the most that
    another one shares. n_docs counts the rows that have the passage's most common seed.

    Any stretch of span + window - 1 words or more that a document shares with the least one that has its seeds is
    reported from its first word to its last; of what it shares with others besides, and of shorter stretches, all or a
    part or nothing. Words of one that is kept are to stay.

    Null and empty texts, and those of fewer words, have no passages. Rows with a null doc_id are left out. Rows with
    the same doc_id are one document, but count each in n_docs; those with equal texts too give one row. Other columns
    are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "whole_passages")
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, seed in _seeds(batch.column(1), k, span, window):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(seed)], ["doc_id", "seed"])

    seeds = texts.mapInArrow(chosen, "doc_id bigint, seed bigint").groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    seeds = scratch.keep(seeds.select("seed"), "seeds")
    bits = filter_bits(seeds)
    sent = docs.sparkSession.sparkContext.broadcast(bit_set(seeds.select(F.expr(f"seed & {bits - 1}L").alias("bit")), bits))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, seed, word, before, after in _seeds(batch.column(1), k, span, window, sent.value):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(at), batch.column(2).take(at), pa.array(seed), pa.array(word), _binary(before), _binary(after)], ["doc_id", "text_key", "seed", "word", "before", "after"])

    # The filter lets some seeds of one document through; they have no other document to be held against.
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    found = scratch.keep(keyed.mapInArrow(places, "doc_id bigint, text_key bigint, seed bigint, word bigint, before binary, after binary").join(seeds, "seed", "left_semi"), "places")
    hubs = found.groupBy("seed").agg(F.min(F.struct("doc_id", "text_key", "word")).alias("hub"), F.count("*").alias("n"))
    hubs = found.join(hubs, "seed").where("doc_id = hub.doc_id and text_key = hub.text_key and word = hub.word").dropDuplicates(["seed"])
    hubs = scratch.keep(hubs.select("seed", "n", F.col("hub.doc_id").alias("cluster_doc"), F.col("hub.text_key").alias("hub_key"), F.col("word").alias("hub_word"), F.col("before").alias("hub_before"), F.col("after").alias("hub_after")), "hubs")
    extents = _extents(found.join(hubs, "seed"), window)
    extents = scratch.keep(extents.select("seed", "doc_id", "text_key", "cluster_doc", "hub_key", "n", "word", (F.col("word") - F.col("hub_word")).alias("ahead"), "fore", "aft"), "extents")
    scratch.drop("seeds", "places", "hubs")
    others = extents.where("doc_id <> cluster_doc")
    most = others.groupBy("seed").agg(F.max("fore").alias("most_fore"), F.max("aft").alias("most_aft"))
    own = extents.where("doc_id = cluster_doc").join(most, "seed").withColumns({"fore": F.least("fore", "most_fore"), "aft": F.least("aft", "most_aft")}).drop("most_fore", "most_aft")
    every = others.unionByName(own).withColumns({"begin": F.col("word") - F.col("fore"), "end": F.col("word") + span + F.col("aft")}).drop("seed").dropDuplicates(["doc_id", "text_key", "cluster_doc", "hub_key", "ahead", "begin", "end"])
    keys = ["doc_id", "text_key", "cluster_doc", "hub_key", "ahead"]
    w = Window.partitionBy(*keys).orderBy("begin", "end")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("new", F.when(F.col("begin") <= so_far - (span - 1), 0).otherwise(1)).withColumn("passage", F.sum("new").over(w))
    merged = every.groupBy(*keys, "passage").agg(F.min("begin").alias("word"), F.max("end").alias("end"), F.max("n").alias("n_docs"))
    merged = merged.withColumn("kept", F.col("doc_id") == F.col("cluster_doc"))
    around = Window.partitionBy("doc_id", "text_key", "kept").orderBy("word", F.desc("end"), "cluster_doc", "hub_key", "ahead").rowsBetween(Window.unboundedPreceding, -1)
    outer = merged.withColumn("within", F.max("end").over(around) >= F.col("end")).where("within is null or not within")
    return outer.select("doc_id", F.col("word").cast("int").alias("word"), (F.col("end") - F.col("word")).cast("int").alias("words"), "cluster_doc", "n_docs", "kept")
