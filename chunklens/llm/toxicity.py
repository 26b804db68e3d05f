"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step's input is a word: its hashed vector, the mean vector of its character trigrams, and the log-odds of its longer
character strings. Two gated recurrent
passes over a window of words are pooled by attention to one probability. All overlapping windows of the whole text are
scored; a document's score is the greatest. Training knows labels of documents only, so each round learns from each
document's window of the greatest score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklens.llm.textbytes import ALNUM_WORDS, LOWER, blocks, spans, word_hashes

_U = np.uint64
#: Words in a window and between the starts of two; hidden units of a direction; units of attention.
SIZE, STRIDE, HIDDEN, ATTEND = 24, 16, 8, 8
#: Hashed word and trigram vectors, and their width.
WORDS, GRAMS, WIDE = 1 << 14, 1 << 12, 8
#: Lengths of character strings, and the bits of their buckets: 3 has vectors, the others have log-odds.
SIZES = {3: 12, 5: 16, 7: 16}
#: Numbers of a step's input.
INPUT = 2 * WIDE + len(SIZES) - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lexicon(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict]:
    """Place of each word among the distinct ones, and of these: word, the bucket, and for each length n of SIZES gram
    and count, the buckets of the n-byte strings of all words (with a mark at either end) and how many each has."""
    hashes = word_hashes(data, starts, ends)
    distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends[first] - starts[first] + 2
    limits = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(limits[-1]) - np.repeat(limits[:-1], length)
    source = np.repeat(starts[first], length) + at - 1
    marked = np.where(at == 0, 1, np.where(at == np.repeat(length, length) - 1, 2, LOWER[data[np.clip(source, 0, max(len(data) - 1, 0))]])).astype(np.uint8)
    out = {"word": (distinct >> _U(50)).astype(np.int64)}
    for n, bits in SIZES.items():
        count = np.maximum(length - n + 1, 1)
        begin = np.repeat(limits[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        end = np.minimum(begin + n, np.repeat(limits[1:], count))
        out[n] = (word_hashes(marked, begin, end, lower=False) >> _U(64 - bits)).astype(np.int64), count
    return place, out


def windows(limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, row) of all windows: one each STRIDE words and one at the end; short rows are one window."""
    count = np.diff(limits)
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - SIZE) // STRIDE)), 0)
    row = np.repeat(np.arange(len(count)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(count[row], SIZE)
    return limits[row] + np.minimum(step * STRIDE, count[row] - length), length, row


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    make = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    p = {"word": make(WORDS, WIDE, scale=0.05), "gram": make(GRAMS, WIDE, scale=0.05), "att": make(2 * HIDDEN, ATTEND, scale=0.3), "focus": make(ATTEND, scale=0.3), "out": make(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1, np.float32)}
    p |= {f"odds{n}": np.zeros(1 << bits, np.float32) for n, bits in SIZES.items() if n > 3}
    for d in "fb":
        p |= {f"in_{d}": make(INPUT, 3 * HIDDEN, scale=0.35), f"add_{d}": np.zeros(3 * HIDDEN, np.float32), f"rec_{d}": make(HIDDEN, 3 * HIDDEN, scale=0.3)}
    return p


def inputs(p: dict, words: dict) -> np.ndarray:
    """The input of each distinct word: its vector, the mean vector of its trigrams, the greatest log-odds of its
    longer character strings."""
    if not len(words["word"]):
        return np.zeros((0, INPUT), np.float32)
    parts = [p["word"][words["word"]]]
    for n, (gram, count) in ((n, words[n]) for n in SIZES):
        lead = np.cumsum(count) - count
        parts.append(np.add.reduceat(p["gram"][gram], lead, axis=0) / count[:, None] if n == 3 else np.maximum.reduceat(p[f"odds{n}"][gram], lead)[:, None])
    return np.concatenate(parts, 1).astype(np.float32)


def _pass(p: dict, d: str, gates: np.ndarray, ids: np.ndarray, keep: bool):
    """States (steps x windows x HIDDEN) of one direction in order of its steps, and what its gradient needs."""
    n, steps = ids.shape
    h, states, held, rec = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), [], p[f"rec_{d}"]
    for t in range(steps):
        x = gates[ids[:, t]]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ rec[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ rec[:, 2 * HIDDEN :])
        if keep:
            held.append((h, z, r, c))
        h = h + z * (c - h)
        states[t] = h
    return states, held


def forward(p: dict, gates: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
    """Probability of each window (rows of ids: places of distinct words), and what the gradient needs."""
    f, held_f = _pass(p, "f", gates["f"], ids, keep)
    b, held_b = _pass(p, "b", gates["b"], ids[:, ::-1], keep)
    h = np.concatenate([f, b[::-1]], 2)
    u = np.tanh(h @ p["att"])
    e = u @ p["focus"]
    e = np.exp(e - e.max(0))
    a = e / e.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    prob = _sigmoid(pooled @ p["out"] + p["bias"][0])
    return prob, (h, u, a, pooled, held_f, held_b) if keep else None


def _back(p: dict, d: str, held: list, slope: np.ndarray, ids: np.ndarray, g: dict, into: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Gradient of the gates of each distinct word; into: the order of ids by word, and where each word's run begins."""
    rec, dh, steps = p[f"rec_{d}"], np.zeros_like(slope[0]), np.empty((len(held), len(ids), 3 * HIDDEN), np.float32)
    for t in range(len(held) - 1, -1, -1):
        h, z, r, c = held[t]
        dh = dh + slope[t]
        dz, dc = dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)
        drh = dc @ rec[:, 2 * HIDDEN :].T
        dr = drh * h * r * (1 - r)
        both = np.concatenate([dz, dr], 1)
        g[f"rec_{d}"][:, : 2 * HIDDEN] += h.T @ both
        g[f"rec_{d}"][:, 2 * HIDDEN :] += (r * h).T @ dc
        steps[t] = np.concatenate([both, dc], 1)
        dh = dh * (1 - z) + drh * r + both @ rec[:, : 2 * HIDDEN].T
    order, first = into
    out = np.zeros((rows, 3 * HIDDEN), np.float32)
    flat = ids.T.ravel()[order]
    out[flat[first]] = np.add.reduceat(steps.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    return out


def backward(p: dict, x: np.ndarray, ids: np.ndarray, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the words' inputs, for the slope of the loss in each window's logit."""
    h, u, a, pooled, held_f, held_b = kept
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram") and not k.startswith("odds")}
    g["out"], g["bias"] = slope @ pooled, slope.sum(keepdims=True)
    dp = slope[:, None] * p["out"]
    da = (h * dp).sum(2)
    dh = a[:, :, None] * dp
    de = a * (da - (a * da).sum(0))
    g["focus"] = np.einsum("tn,tnk->k", de, u)
    du = de[:, :, None] * p["focus"] * (1 - u * u)
    g["att"] = np.einsum("tnh,tnk->hk", h, du)
    dh = dh + du @ p["att"].T
    dx = np.zeros_like(x)
    for d, held, way, part in (("f", held_f, ids, dh[:, :, :HIDDEN]), ("b", held_b, ids[:, ::-1], dh[::-1, :, HIDDEN:])):
        flat = way.T.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        dgates = _back(p, d, held, part, way, g, (order, first), len(x))
        g[f"in_{d}"], g[f"add_{d}"] = x.T @ dgates, dgates.sum(0)
        dx += dgates @ p[f"in_{d}"].T
    return g, dx


def _gates(p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ p[f"in_{d}"] + p[f"add_{d}"] for d in "fb"}


def _score_windows(p: dict, x: np.ndarray, place: np.ndarray, first: np.ndarray, length: np.ndarray, most: int = 2048) -> np.ndarray:
    gates, out = _gates(p, x), np.zeros(len(first), np.float32)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        for lo in range(0, len(own), most):
            some = own[lo : lo + most]
            out[some] = forward(p, gates, place[first[some][:, None] + np.arange(n)])[0]
    return out


def score_block(p: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text of a block; a text without words has that of the bias alone."""
    starts, ends, limits = spans(data, offsets, ALNUM_WORDS)
    out = np.full(len(offsets) - 1, _sigmoid(p["bias"])[0])
    if len(starts):
        place, words = lexicon(data, starts, ends)
        first, length, row = windows(limits)
        score = _score_windows(p, inputs(p, words), place, first, length)
        lead = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[lead]] = np.maximum.reduceat(score, lead)
    return out


def train(texts: list[str], toxic: list[int], rounds: int = 40, rate: float = 0.02, seed: int = 11, support: int = 8, slow: float = 0.02) -> dict[str, np.ndarray]:
    """Parameters learned from labelled texts; the same input gives the same result.

    A word bucket found in fewer than `support` of the texts has no vector; the first number of the others is their
    smoothed log-odds throughout. Vectors learn at `slow` times the rate of the network, so as not to learn texts by heart. After an eighth of the rounds the loss is the generalised cross-entropy, which weighs a text by
    the 0.7th power of the probability of its label: labels that the rest contradicts stop to count. One class or no
    texts give the parameters of the start, without word vectors.
    """
    p = initial(seed)
    p["word"][:] = 0
    if not any(toxic) or all(toxic):
        return p
    _, _, data, offsets = next(iter(blocks(pa.array(texts, pa.string()), 1 << 40)))
    starts, ends, limits = spans(data, offsets, ALNUM_WORDS)
    place, words = lexicon(data, starts, ends)
    bucket, (gram, count) = words["word"], words[3]
    first, length, row = windows(limits)
    label = np.array(toxic, np.float32)
    share = label.mean()
    doc = np.repeat(np.arange(len(label)), np.diff(limits))
    pairs = np.unique(doc * len(bucket) + place)
    doc, at = pairs // len(bucket), pairs % len(bucket)

    def odds(own: np.ndarray, many: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed log-odds of each bucket among toxic texts, and whether it has them; many: buckets of each word."""
        begin = np.cumsum(many) - many
        n = many[at]
        each = np.unique(np.repeat(doc, n) * size + own[np.repeat(begin[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        seen = np.stack([np.bincount(each[label[each // size] == c] % size, minlength=size) for c in (0, 1)])
        known = seen.sum(0) >= support
        value = np.log((seen[1] + 3 * share) / (label.sum() + 3)) - np.log((seen[0] + 3 * (1 - share)) / ((1 - label).sum() + 3))
        return np.where(known, np.clip(value, -1, 4) * 0.5, 0).astype(np.float32), known

    first_number, known = odds(bucket, np.ones(len(bucket), np.int64), WORDS)
    p["word"] = initial(seed)["word"] * known[:, None]
    p["word"][:, 0] = first_number
    for n, bits in SIZES.items():
        if n > 3:
            p[f"odds{n}"] = odds(*words[n], 1 << bits)[0]
    fixed = {k for k in p if k.startswith("odds")}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items() if k not in fixed} for _ in range(2))
    lead = np.flatnonzero(np.diff(row, prepend=-1))
    ends_at = np.append(lead[1:], len(row))
    have = row[lead]
    weight = np.where(label[have] > 0, 0.35 / share, 0.65 / (1 - share)) / len(have)
    grams_at = np.concatenate([[0], np.cumsum(count)])
    for i in range(1, rounds + 1):
        x = inputs(p, words)
        if i < 4 or i % 10 == 0:
            score = _score_windows(p, x, place, first, length)
            top = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(lead, ends_at, strict=True)])
        gates, total, dx = _gates(p, x), None, np.zeros_like(x)
        for n in np.unique(length[top]):
            own = np.flatnonzero(length[top] == n)
            ids = place[first[top[own]][:, None] + np.arange(n)]
            prob, kept = forward(p, gates, ids, keep=True)
            y = label[have[own]]
            trust = np.where(y > 0, prob, 1 - prob) ** (0.7 if 8 * i > rounds else 0.0)
            g, part = backward(p, x, ids, kept, ((prob - y) * weight[own] * trust).astype(np.float32))
            total = g if total is None else {k: total[k] + g[k] for k in g}
            dx += part
        used = np.flatnonzero(np.abs(dx).sum(1))
        total |= {"word": np.zeros_like(p["word"]), "gram": np.zeros_like(p["gram"])}
        np.add.at(total["word"], bucket[used], dx[used, :WIDE])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(grams_at[w], grams_at[w + 1]) for w in used)]).astype(np.int64)
        np.add.at(total["gram"], gram[at], np.repeat(dx[used, WIDE : 2 * WIDE] / count[used, None], count[used], axis=0))
        total["word"] *= known[:, None]
        total["word"][:, 0] = 0
        for k in p.keys() - fixed:
            g = total[k] + (3e-5 if k in ("word", "gram") else 1e-4) * p[k]
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
            step = (slow if k in ("word", "gram") else 1.0) * rate * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.99**i)) + 1e-5)
            p[k] = (p[k] - (step * known[:, None] * (np.arange(WIDE) > 0) if k == "word" else step)).astype(np.float32)
    return p


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: the remainder of crc32(doc_id as text) by 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, most_bytes: int = 50_000) -> dict[str, np.ndarray]:
    """Train on at most `sample` labelled rows of each class, those of the least hash of the id that are not held out;
    texts above `most_bytes` bytes are not learned from (they are scored whole). labels(doc_id, toxic 0/1, ...)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select("doc_id", "text").where(f"octet_length(text) between 1 and {most_bytes}").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(2 * sample).collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def toxicity(docs: DataFrame, model: dict[str, np.ndarray], cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text, ...), each whole text scored.

    A null or empty text, or one without words, has the score of the bias alone; a null doc_id stays null; repeated
    rows stay repeated; other columns are not read; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(score_block(sent.value, data, offsets).astype(float))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
