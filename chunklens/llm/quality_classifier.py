"""Quality classifier: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Every text is voted on by overlapping heuristics. The counts of all vote patterns give, by expectation-maximisation,
the labellers' accuracies and a posterior for each pattern; a linear scorer over hashed byte trigrams is trained on
the posteriors of a bounded sample and then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklens.llm.textbytes import SPACE_WORDS, blocks, spans, word_hashes
from chunklens.llm.weak_labels import ABSTAIN, NO, YES, logistic, reliabilities

#: Hashed features.
WIDTH = 1 << 13
#: A feature is the share of its trigrams in the text, times this.
SCALE = 64.0
LABELLERS = 9


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS, _UPPER, _BAR, _SHOUT = _flags("#*$%&<>"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("|"), _flags("!")
_PLAIN = _flags("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz \n") | (np.arange(256) >= 0x80)
_MARK = _flags("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LINE = ~_flags("\n")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x LABELLERS of ABSTAIN, NO (low) and YES (good), in order: symbols, words that end in two marks, capitals,
    exclamation, table bars, words that are one mark, distinct words, repeated lines, share of letters, digits and space."""
    starts, ends, limits = spans(data, offsets, SPACE_WORDS)
    count, length = np.diff(limits), ends - starts
    words, chars = np.maximum(count, 1), np.maximum(_per_row(length, limits), 1)
    out = np.full((len(count), LABELLERS), ABSTAIN)
    symbols, capitals, shouts, bars = (_per_row(f[data], offsets) / chars for f in (_SYMBOLS, _UPPER, _SHOUT, _BAR))
    if len(starts):
        tail = _MARK[data[ends - 1]]
        double, single = tail & (length > 1) & _MARK[data[np.maximum(ends - 2, 0)]], tail & (length == 1)
    else:
        double = single = np.zeros(0, bool)
    hashes = word_hashes(data, starts, ends, lower=False)
    s, e, at = spans(data, offsets, _LINE)
    line = word_hashes(data, s, e, lower=False)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(limits[:-1], limits[1:], strict=True)]) / words
    unlike = np.array([len(np.unique(line[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])
    lines, plain = np.diff(at), _per_row(_PLAIN[data], offsets) / np.maximum(np.diff(offsets), 1)
    long = count >= 20
    faults = (symbols > 0.02, _per_row(double, limits) > 0.2 * words, capitals > 0.25, shouts > 0.03, bars > 0.01, _per_row(single, limits) > 0.1 * words)
    for i, fault in enumerate(faults):
        out[fault, i] = NO
    # Fewer of the words are distinct in a longer text anyway: the share is held against its usual fall.
    usual = np.minimum(1.0, (30 / words) ** 0.25)
    out[:, 6] = np.where(long & (distinct < 0.62 * usual), NO, np.where(long & (distinct > 0.8 * usual) & (plain > 0.95), YES, ABSTAIN))
    out[long & (lines - unlike > 0.3 * np.maximum(lines, 1)) & (distinct < 0.62 * usual), 7] = NO
    out[:, 8] = np.where(long & (plain < 0.91), NO, np.where((plain > 0.95) & (distinct > 0.62 * usual), YES, ABSTAIN))
    return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigram at each byte but the last two, and the limits of each row's own."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - 13), offsets


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1])


def _voted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, hi, data, offsets in blocks(batch.column(1)):
                code = votes(data, offsets) @ 3 ** np.arange(LABELLERS)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(code.astype(np.int32))], ["doc_id", "code"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, code int")


def _features(docs: DataFrame) -> DataFrame:
    """(code, counts of hashed trigrams as floats in bytes): for the bounded sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                code = votes(data, offsets) @ 3 ** np.arange(LABELLERS)
                grams, _ = _trigrams(data, offsets)
                a, b = _windows(offsets)
                rows = [np.unique(grams[x:y], return_counts=True) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.astype(np.int32)), pa.array([r[0].astype(np.uint16).tobytes() for r in rows], pa.binary()), pa.array([(r[1] / max(r[1].sum(), 1)).astype(np.float32).tobytes() for r in rows], pa.binary())],
                    ["code", "at", "share"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "code int, at binary, share binary")


def train(docs: DataFrame, sample: int = 4000) -> tuple[np.ndarray, float]:
    """Weights of the scorer. The labellers' accuracies come from the votes of all rows; the scorer is fitted to the
    `sample` ids of the least hash (a null id is not chosen; rows of a repeated id all are, up to the sample)."""
    voted = _voted(docs)
    rows = voted.groupBy("code").count().collect()
    codes, counts = np.array([r["code"] for r in rows], np.int64), np.array([r["count"] for r in rows], float)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    if not len(codes):
        return np.zeros(WIDTH), 0.0
    posterior, _ = reliabilities(codes[:, None] // 3 ** np.arange(LABELLERS) % 3, counts, prior=0.8)
    good = dict(zip(codes.tolist(), posterior, strict=True))
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    found = _features(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).limit(sample).collect()
    x, y = np.zeros((len(found), WIDTH), np.float32), np.zeros(len(found))
    for i, (code, at, share) in enumerate(found):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
        y[i] = good.get(code, 0.5)
    if not len(found):
        return np.zeros(WIDTH), 0.0
    balance = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-9), 0.5 / max((y <= 0.5).mean(), 1e-9))
    return logistic(x * np.float32(SCALE), y, np.minimum(balance, 10.0), l2=1e-5, rounds=200, rate=0.3)


def classify(docs: DataFrame, model: tuple[np.ndarray, float] | None = None, cut: float = 0.5) -> DataFrame:
    """docs with quality_score (0 to 1, higher: better) and keep (score >= cut); the model is trained on docs if none
    is given. A null or empty text has the score of the bias alone. All columns and rows stay, in place."""
    w, b = model or train(docs)
    weights = docs.sparkSession.sparkContext.broadcast((w.astype(np.float64), b))
    names = [c for c in docs.columns if c not in ("quality_score", "keep")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi, data, offsets in blocks(batch.column(at)):
                grams, _ = _trigrams(data, offsets)
                first, last = _windows(offsets)
                total = np.concatenate([[0.0], np.cumsum(w[grams])])
                score = SCALE * (total[np.minimum(last, len(grams))] - total[np.minimum(first, len(grams))]) / np.maximum(last - first, 1)
                p = 1 / (1 + np.exp(-np.clip(score + b, -30, 30)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, "quality_score"])

    out = docs.select(*names).mapInArrow(run, docs.select(*names).schema.add("quality_score", "double"))
    return out.withColumn("keep", F.col("quality_score") >= cut)
