"""Secrets: base patterns, and random-looking tokens by a battery of tests under false-discovery control.

Tokens of 16 or more characters get an encoding (the smallest alphabet that has all their characters), a chi-squared
test of uniformity over it, a runs test and a serial-correlation test, combined by Fisher's method to the probability
u of a token so uneven if it were random. Ordinary text gives the null distribution of encodings and u for each class of
lengths: the letters of every whole text outside of such tokens, cut into runs. For a class and an encoding, the tokens
with u of at least t are reported for the least t at which the expected share of ordinary ones among them is q at most.
So a short token of small letters, which words make up too, is seldom reported, and one with digits and both cases is
when it is even. Tokens that people make of words, digits and marks are in no null distribution; u alone tells them.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklens.llm.shared import Scratch
from chunklens.llm.textbytes import blocks, spans

KINDS = ("assign", "access", "hex", "random")
#: Least lengths of the classes, and the number of bins of u.
LENGTHS, BINS = (16, 20, 24, 32, 40, 64, 96), 50

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from small to large.
ALPHABETS = (_DIGIT, _DIGIT + "abcdef", _DIGIT + "ABCDEF", _LOWER, _UPPER, "234567" + _UPPER, _DIGIT + _LOWER, _DIGIT + _UPPER, _UPPER + _LOWER, _DIGIT + _UPPER + _LOWER, _DIGIT + _UPPER + _LOWER + "+/=_-")
CODES = len(LENGTHS) * len(ALPHABETS) * BINS
_TOKEN = np.zeros(256, bool)
_TOKEN[list(ALPHABETS[-1].encode())] = True
_LETTER = np.zeros(256, bool)
_LETTER[list((_UPPER + _LOWER).encode())] = True
_PLACE, _FITS = np.zeros((len(ALPHABETS), 256), np.float32), np.zeros(256, np.uint16)
for _i, _a in enumerate(ALPHABETS):
    _PLACE[_i, list(_a.encode())] = range(len(_a))
    _FITS[list(_a.encode())] |= 1 << _i
_SIZES = np.array([len(a) for a in ALPHABETS])
_ERFC = np.vectorize(math.erfc, otypes=[float])
#: erfc at steps of 1 / 64 up to 8, beyond which it counts as that.
_TAIL = _ERFC(np.arange(513) / 64)


def base_spans(text: str, tokens: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end), ascending, in code points. tokens=False: no token of 16 characters is in the text."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if tokens:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def battery(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(encoding, u) of each token; tokens is a matrix of bytes, one token of equal length a row."""
    n, length = tokens.shape
    flat = np.ascontiguousarray(tokens.T)
    fits = np.bitwise_and.reduce(_FITS[flat], axis=0)
    which = np.log2(fits & -fits.astype(np.int32)).astype(int)
    size = _SIZES[which].astype(float)
    if length <= 128:  # pairs of equal characters, at each distance
        squares = np.full(n, float(length))
        for step in range(1, length):
            squares += 2.0 * np.add.reduce((flat[step:] == flat[:-step]).view(np.uint8), axis=0, dtype=np.uint8)
    else:
        squares = (np.bincount((np.arange(n)[:, None] * 256 + tokens).ravel(), minlength=n * 256).reshape(n, 256).astype(float) ** 2).sum(1)
    chi, free = squares * size / length - length, size - 1
    z1 = (np.cbrt(np.maximum(chi, 0) / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))
    place = _PLACE[which[None, :], flat]
    high = place >= (size / 2).astype(np.float32)
    runs = (high[1:] != high[:-1]).sum(0)
    z2 = (runs - (length - 1) / 2) / np.sqrt((length - 1) / 4)
    x = place - place.mean(0, dtype=np.float32)
    z3 = ((x[1:] * x[:-1]).sum(0) / np.maximum((x * x).sum(0), 1e-9) + 1 / length) * np.sqrt(length)
    at = np.minimum(np.abs(np.stack([z1, z2, z3])) / math.sqrt(2) * 64, 512).astype(int)
    half = -np.log(_TAIL[at] + 1e-300).sum(0)
    return which, np.exp(-half) * (1 + half + half * half / 2)


def _codes(tokens: np.ndarray) -> np.ndarray:
    """One number for class of length, encoding and bin of u of each token."""
    kind = int(np.searchsorted(LENGTHS, tokens.shape[1], side="right")) - 1
    step = max(1, 4_000_000 // tokens.shape[1])
    parts = [battery(tokens[lo : lo + step]) for lo in range(0, len(tokens), step)]
    which, u = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (kind * len(ALPHABETS) + which) * BINS + np.minimum((u * BINS).astype(int), BINS - 1)


def _graded(tokens: list[bytes]) -> list[int]:
    out, by = [0] * len(tokens), {}
    for i, t in enumerate(tokens):
        by.setdefault(len(t), []).append(i)
    for length, own in by.items():
        for i, code in zip(own, _codes(np.frombuffer(b"".join(tokens[i] for i in own), np.uint8).reshape(len(own), length)).tolist(), strict=True):
            out[i] = code
    return out


def _ordinary(letters: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, how many) of the runs of letters that the texts are cut into, for each class of lengths in turn."""
    total = np.zeros(CODES, np.int64)
    for length in LENGTHS:
        count = np.diff(limits) // length
        if count.sum():
            first = np.repeat(limits[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]) * length, count) + np.arange(count.sum()) * length
            total += np.bincount(_codes(letters[first[:, None] + np.arange(length)]), minlength=CODES)
    some = np.flatnonzero(total)
    return some, total[some]


_FOUND = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<start:int,kind:int,end:int,code:int>>, ordinary array<struct<code:int,n:bigint>>"
_COUNT = pa.struct([("code", pa.int32()), ("n", pa.int64())])
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans and graded tokens outside of them, of each row of docs(doc_id, text, ...); ordinary: the counts of
    grades of ordinary letters of some rows' texts, at the first of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).cast(pa.int64()), batch.column(1)
            for lo, hi, data, offsets in blocks(column):
                texts = column.slice(lo, hi - lo).to_pylist()
                starts, ends, limits = spans(data, offsets, _TOKEN)
                long = np.flatnonzero(ends - starts >= LENGTHS[0])
                row = np.searchsorted(limits, long, side="right") - 1
                point = np.cumsum((data & 0xC0) != 0x80)
                has = set(row.tolist())
                base = [base_spans(t, i in has) if t else [] for i, t in enumerate(texts)]
                found = [[(s, k, e, -1) for s, k, e in x] for x in base]
                free = []
                for w, r in zip(long, row, strict=True):
                    first = point[offsets[r]]
                    s, e = int(point[starts[w]] - first), int(point[ends[w] - 1] - first) + 1
                    if not any(a < e and s < b for a, _, b in base[r]):
                        free.append((int(r), s, e, data[starts[w] : ends[w]].tobytes()))
                for (r, s, e, _), code in zip(free, _graded([x[3] for x in free]), strict=True):
                    found[r].append((s, 3, e, code))
                plain = _LETTER[data]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, starts[long], 1)
                np.add.at(edge, ends[long], -1)
                plain &= np.cumsum(edge[:-1]) == 0
                letters = np.flatnonzero(plain)
                grades, many = _ordinary(data[letters], np.searchsorted(letters, offsets))
                ordinary = [[{"code": c, "n": n} for c, n in zip(grades.tolist(), many.tolist(), strict=True)], *([None] * (hi - lo - 1))]
                digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x).encode()).hexdigest() for x in base]
                counts = [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(3)]
                names = ["start", "kind", "end", "code"]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *counts, pa.array(digests, pa.string()), pa.array([[dict(zip(names, s, strict=True)) for s in sorted(x)] for x in found], pa.list_(_SPAN)), pa.array(ordinary, pa.list_(_COUNT))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found", "ordinary"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def thresholds(tokens: np.ndarray, ordinary: np.ndarray, q: float) -> list[int]:
    """For each class of lengths and encoding, the least bin of u that is reported (BINS: none), from counts of classes x
    encodings x bins. The lowest bin never is: its tokens are not random."""
    out = []
    for own, null in zip(tokens, ordinary, strict=True):
        for mine, theirs in zip(own, null, strict=True):
            above, chance = mine[::-1].cumsum()[::-1], (theirs[::-1].cumsum()[::-1] + 1) / (null.sum() + 1)
            good = np.flatnonzero((above > 0) & (own.sum() * chance <= q * above) & (np.arange(BINS) > 0))
            out.append(int(good[0]) if len(good) else BINS)
    return out


def secrets(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs(doc_id, text, ...).

    spans: kind:start:end of all spans, by start and then kind, comma-joined; offsets are code points, ends exclusive.
    A null or empty text has none; a null doc_id stays null, repeated rows stay repeated; other columns are not read.
    """
    found = Scratch(docs.sparkSession, "secrets").keep(candidates(docs), "candidates")
    tokens, ordinary = np.zeros(CODES), np.zeros(CODES)
    codes = found.select(F.explode("found.code").alias("code")).where("code >= 0").groupBy("code").agg(F.count("*").alias("n"))
    nulls = found.select(F.explode("ordinary").alias("x")).groupBy("x.code").agg(F.sum("x.n").alias("n"))
    for into, rows in ((tokens, codes), (ordinary, nulls)):  # CODES rows at most
        for code, n in rows.collect():
            into[code] = n
    shape = (len(LENGTHS), len(ALPHABETS), BINS)
    tokens, ordinary = tokens.reshape(shape), ordinary.reshape(shape)
    least = F.array(*map(F.lit, thresholds(tokens, ordinary, q)))
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter("found", lambda x: (x["code"] < 0) | (x["code"] % BINS >= F.get(least, F.floor(x["code"] / BINS).cast("int"))))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(kept, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",").alias("spans"),
    )
