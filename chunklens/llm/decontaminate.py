"""Benchmark decontamination on a positional inverted index of the training texts.

The index is split by document: each segment (about 2 MB of texts) is one row with its sorted term hashes, the limits
of their posting lists, and the word positions as differences, written as Parquet to the shared folder. Test phrases
are answered on every segment alone, without a shuffle: a phrase with a term that the segment lacks ends there, and
else the position lists, each moved by its term's offset in the phrase, are intersected from the rarest term on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklens.llm.shared import Scratch
from chunklens.llm.textbytes import ALNUM_WORDS, blocks, spans, word_hashes

_U = np.uint64
#: Bytes of test texts in one broadcast; more are taken in blocks, of which so many are held at once.
BLOCK_BYTES, HELD_BLOCKS = 4 << 20, 8

_INDEX = "doc_ids binary, null_ids binary, limits binary, terms binary, lists binary, postings binary"
_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>"


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the positional index of docs(doc_id, text, ...), one row each. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, hi, data, offsets in blocks(batch.column(1)):
                starts, ends, limits = spans(data, offsets, ALNUM_WORDS)
                words = word_hashes(data, starts, ends)
                order = np.argsort(words, kind="stable")
                terms, first = np.unique(words[order], return_index=True)
                lists = np.append(first, len(words)).astype(np.int32)
                gaps = np.diff(order, prepend=0)
                gaps[first] = order[first]
                own = ids.slice(lo, hi - lo)
                row = [own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), limits.astype(np.int32), terms, lists, gaps.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], [x.split()[0] for x in _INDEX.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _INDEX)


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.null_ids = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["null_ids"], bool)
        self.limits, self.terms = np.frombuffer(row["limits"], np.int32), np.frombuffer(row["terms"], _U)
        self.lists, gaps = np.frombuffer(row["lists"], np.int32), np.frombuffer(row["postings"], np.int32)
        total = np.cumsum(gaps, dtype=np.int64)
        first = self.lists[:-1]
        self.postings = total - np.repeat(total[first] - gaps[first], np.diff(self.lists)) if len(first) else total

    def ordinals(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in the dictionary, -1 if it isn't there."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def positions(self, ordinal: int) -> np.ndarray:
        return self.postings[self.lists[ordinal] : self.lists[ordinal + 1]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, positions, side="right") - 1

    def phrase(self, ordinals: np.ndarray) -> np.ndarray:
        """Word positions at which the phrase begins, within one document."""
        rarest = np.argsort(self.lists[ordinals + 1] - self.lists[ordinals], kind="stable")
        at = self.positions(ordinals[rarest[0]]) - rarest[0]
        for i in rarest[1:]:
            if not len(at):
                break
            there = self.positions(ordinals[i])
            found = np.minimum(np.searchsorted(there, at + i), len(there) - 1)
            at = at[there[found] == at + i]
        return at[self.doc_of(at) == self.doc_of(at + len(ordinals) - 1)]

    def proximity(self, ordinals: np.ndarray, width: int) -> np.ndarray:
        """Documents (by place) with all terms within `width` consecutive words, sought around the rarest term."""
        lists = sorted((self.positions(i) for i in set(ordinals.tolist())), key=len)
        out = set()
        for p in lists[0]:
            doc = int(self.doc_of(p))
            if doc in out:
                continue
            lo, hi = max(p - width + 1, self.limits[doc]), min(p + width, self.limits[doc + 1])
            near = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists]
            for start in sorted({int(q) for x in near for q in x if q <= p}):
                if start + width > p and all(np.searchsorted(x, start) < np.searchsorted(x, start + width) for x in near):
                    out.add(doc)
                    break
        return np.array(sorted(out), np.int64)


def _windows(texts: list[str], ids: list[int], size: int) -> dict[int, tuple[np.ndarray, list[list[int]]]]:
    """By length: the distinct windows (rows of term hashes) and the items of each."""
    found: dict[int, dict[bytes, list[int]]] = {}
    for lo, hi, data, offsets in blocks(pa.array(texts, pa.string())):
        starts, ends, limits = spans(data, offsets, ALNUM_WORDS)
        words = word_hashes(data, starts, ends)
        for r in range(hi - lo):
            own = words[limits[r] : limits[r + 1]]
            n = min(size, len(own))
            for i in range(len(own) - n + 1) if n else ():
                found.setdefault(n, {}).setdefault(own[i : i + n].tobytes(), []).append(ids[lo + r])
    return {n: (np.frombuffer(b"".join(x), _U).reshape(-1, n), [sorted(set(v)) for v in x.values()]) for n, x in found.items()}


def _test_blocks(items: DataFrame) -> Iterable[tuple[list[str], list[int]]]:
    texts, ids, held = [], [], 0
    for row in items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        texts.append(row[1])
        ids.append(row[0])
        held += len(row[1])
        if held >= BLOCK_BYTES:
            yield texts, ids
            texts, ids, held = [], [], 0
    yield texts, ids


def _match(windows, last: bool):
    """Add what the windows of one block of items hit to each segment; the last block gives the documents' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                segment = Segment(row)
                n = int(segment.limits[-1])
                edge = np.zeros(n + 1, np.int64)
                pairs = [np.frombuffer(row["pairs"], np.int64).reshape(-1, 2)] if row.get("pairs") else []
                if row.get("hit"):
                    hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=n).astype(np.int64)
                    edge = np.diff(hit, prepend=0, append=0)
                for size, (terms, items) in windows.value.items():
                    at = segment.ordinals(terms)
                    for w in np.flatnonzero((at >= 0).all(1)):
                        starts = segment.phrase(at[w])
                        if len(starts):
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + size, -1)
                            docs = np.unique(segment.doc_of(starts))
                            pairs += [np.column_stack([docs, np.full(len(docs), item)]) for item in items[w]]
                hit = np.cumsum(edge)[:n] > 0
                both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
                if not last:
                    row |= {"hit": np.packbits(hit).tobytes(), "pairs": both.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([(x, pa.binary()) for x in row]))
                    continue
                total = np.concatenate([[0], np.cumsum(hit)])
                cuts = np.searchsorted(both[:, 0], np.arange(len(segment.doc_ids) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.doc_ids, pa.int64(), mask=segment.null_ids),
                        pa.array(np.diff(segment.limits).astype(np.int64)),
                        pa.array(total[segment.limits[1:]] - total[segment.limits[:-1]]),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(both[:, 1])),
                    ],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return run


def find_phrases(index: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of each indexed document, for items(item_id, text, ...).

    A window is `size` consecutive words of an item, or the whole item if it has fewer; n_hit counts the words inside
    any occurrence of a window, items are the ids (ascending) of the items with occurring windows. Items with a null
    id, a null text or no words have no windows; items with the same id count as one. Documents are rows: a repeated
    doc_id stays repeated, a null one null. The items are read in blocks of BLOCK_BYTES, each sent as one broadcast.
    """
    scratch = Scratch(index.sparkSession, "phrases")
    now, ahead = index.withColumns({"hit": F.lit(None).cast("binary"), "pairs": F.lit(None).cast("binary")}), None
    for i, (texts, ids) in enumerate(_test_blocks(items)):
        if ahead is not None:
            now = now.mapInArrow(_match(ahead, False), now.schema)
            if i % HELD_BLOCKS == 0:
                now = scratch.keep(now, f"pass{i}")
        ahead = index.sparkSession.sparkContext.broadcast(_windows(texts, ids, size))
    return now.mapInArrow(_match(ahead, True), _RESULT)


def find_near(index: DataFrame, terms: list[str], width: int) -> DataFrame:
    """(doc_id) of the documents that have all terms within `width` consecutive words of their text. A term of several
    words counts as each of them; one without a word is left out, and if none is left there are no rows. Rows of a
    repeated doc_id are documents of their own, a null one stays null; null and empty texts have no words."""
    found = _windows(terms, list(range(len(terms))), 1)
    hashes = found[1][0][:, 0] if found else np.zeros(0, _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0])
                at = segment.ordinals(hashes)
                docs = segment.proximity(at, width) if len(at) and (at >= 0).all() else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids[docs], pa.int64(), mask=segment.null_ids[docs])], ["doc_id"])

    return index.mapInArrow(run, "doc_id bigint")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: float = 0.05) -> DataFrame:
    """find_phrases() over an index of docs that is written to the shared folder, with contaminated: some words are
    hit, and at least `share` (a whole number of thousandths) of them. Empty tables give an empty result or no hits."""
    index = build_index(docs)
    path = f"{Scratch(docs.sparkSession, 'index').path}/segments"
    index.write.option("compression", "zstd").parquet(path)
    index = docs.sparkSession.read.schema(index.schema).parquet(path)
    hit, words = F.col("n_hit"), F.col("n_words")
    return find_phrases(index, items, size).withColumn("contaminated", (hit > 0) & (1000 * hit >= round(1000 * share) * words))
