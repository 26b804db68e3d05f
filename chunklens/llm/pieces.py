"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, the pieces that end there (it follows the output links); each relaxes the best
score of its end from that of its start. Where scores are logarithms of probabilities (a unigram vocabulary) they add
up. Where they are ranks of merges (a BPE vocabulary) a link between two pieces scores nothing if merging their text
gives just these two again, and minus infinity otherwise: of the paths to a position exactly one then has a score, the
one that merging makes. A character that no piece covers costs more than any piece and becomes its UTF-8 bytes. Runs of
text that no piece can cross (a space run and what follows up to the next space or line break) are encoded apart and
remembered, up to a bound.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

#: The piece character that stands for a space (a fixed value).
MARK = "▁"


def read_vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) in order of ids, from a SentencePiece model file; kind: normal, byte or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class _Memo(dict):
    """ids (as bytes) of runs; what is missing is encoded. At most `most` are held, then it starts anew."""

    def __init__(self, encode, prefix: str, most: int) -> None:
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, most

    def __missing__(self, run: str) -> bytes:
        ids = np.array(self.encode(self.prefix + run), np.int32).tobytes()
        if len(run) < 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary. Text is taken as it is (no normalisation); a space is put before it.

    merges: scores are ranks of merges; None takes them so if they differ and are whole numbers.
    """

    def __init__(self, vocabulary: list[tuple[str, float, str]], memory: int = 500_000, merges: bool | None = None) -> None:
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(vocabulary) if kind == "normal" and p]
        self.automaton = ahocorasick.Automaton()
        for i, p, s in normal:
            self.automaton.add_word(p, (i, len(p), s))
        self.automaton.make_automaton()
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary lacks byte pieces, so that some texts could not be restored")
        self.outside = min((s for _, _, s in normal), default=0.0) - 10.0
        used = set("".join(p for _, p, _ in normal))
        self.no_piece = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in used)
        self.apart = not any(MARK in p.lstrip(MARK) or " " in p for _, p, _ in normal)
        self.lines = self.apart and "\n" not in used
        scores = [s for _, _, s in normal]
        self.merges = len(set(scores)) > 1 and all(s == int(s) for s in scores) if merges is None else merges
        self.pieces, self.score, self.memory = [p for p, _, _ in vocabulary], {p: s for _, p, s in normal}, memory
        self.links: dict[str, dict[int, bool]] = {}
        self.held = 0
        path = self.merge_path if self.merges else self.viterbi
        self.text = [bytes([int(p[1:-1], 16)]) if kind == "byte" else p.replace(MARK, " ").encode() if kind == "normal" else b"" for p, _, kind in vocabulary]
        self.spaced, self.bare = _Memo(path, " ", memory), _Memo(path, "", memory // 4)
        self.line = np.array([self.bytes[10]], np.int32).tobytes()

    def viterbi(self, run: str) -> list[int]:
        """The ids of the best-scoring pieces of a run; of equal scores the longer last piece wins."""
        shown = run.replace(MARK, self.no_piece).replace(" ", MARK)
        n = len(shown)
        best, back = [0.0] + [float("-inf")] * n, [(-1, 0)] * (n + 1)
        done = 0
        for end, (i, length, score) in self.automaton.iter(shown):
            while done < end:  # nothing more ends at done + 1
                if best[done] + self.outside > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + self.outside, (-1, 1)
                done += 1
            value = best[end + 1 - length] + score
            if value > best[end + 1]:
                best[end + 1], back[end + 1] = value, (i, length)
        while done < n:
            if best[done] + self.outside > best[done + 1]:
                best[done + 1], back[done + 1] = best[done] + self.outside, (-1, 1)
            done += 1
        out, at = [], n
        while at:
            i, length = back[at]
            if i < 0:
                out += [self.bytes[b] for b in reversed(run[at - 1].encode())]
            else:
                out.append(i)
            at -= length
        return out[::-1]

    def merged(self, shown: str) -> list[str]:
        """The strings that are left of a short text when the best merge, of equal ones the first, is done until none is."""
        parts, get, none = list(shown), self.score.get, float("-inf")
        scores = [get(x + y, none) for x, y in itertools.pairwise(parts)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def linked(self, before: str, i: int) -> bool:
        """Whether merging keeps piece i apart from the string before it ("": at the start), and both whole."""
        if self.held >= self.memory:
            self.links.clear()
            self.held = 0
        piece = self.pieces[i]
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.links.setdefault(before, {})[i] = found
        self.held += 1
        return found

    def merge_path(self, run: str) -> list[int]:
        """The ids of the pieces that merging makes of a run, by the one path of links at each position."""
        shown = run.replace(MARK, self.no_piece).replace(" ", MARK)
        n, links, pieces = len(shown), self.links, self.pieces
        last, back, done, none = [""] + [None] * n, [-1] * (n + 1), 0, {}
        for end, (i, length, _) in self.automaton.iter(shown):
            end += 1
            while done < end - 1:  # nothing more ends at done + 1
                done += 1
                if last[done] is None:
                    last[done] = shown[done - 1]
            if last[end] is None:
                before = last[end - length]
                found = links.get(before, none).get(i)
                if found or found is None and self.linked(before, i):
                    last[end], back[end] = pieces[i], i
        while done < n:
            done += 1
            if last[done] is None:
                last[done] = shown[done - 1]
        out, at = [], n
        while at:
            if back[at] < 0:
                out += [self.bytes[b] for b in reversed(run[at - 1].encode())]
            else:
                out.append(back[at])
            at -= len(last[at])
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.apart:
            return np.array((self.merge_path if self.merges else self.viterbi)(" " + text), np.int32)
        parts: list[bytes] = []
        for i, line in enumerate(text.split("\n") if self.lines else [text]):
            if i:
                parts.append(self.line)
            words = line.split(" ")
            if "" in words:
                runs = re.findall(r" *[^ ]+| +", line if i else " " + line)
                parts += [self.spaced[r[1:]] if r[0] == " " else self.bare[r] for r in runs]
            else:
                parts.append(self.bare[words[0]] if i else self.spaced[words[0]])
                parts += map(self.spaced.__getitem__, words[1:])
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 (which encode() never makes) become replacement characters."""
        out = b"".join(map(self.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode(errors="replace")
        return out.removeprefix(" ")


def _codecs(docs: DataFrame, vocabulary: list[tuple[str, float, str]]):
    sent, made = docs.sparkSession.sparkContext.broadcast(vocabulary), []

    def get() -> Codec:
        if not made:
            made.append(Codec(sent.value))
        return made[0]

    return get


def encoded(docs: DataFrame, vocabulary: list[tuple[str, float, str]]) -> DataFrame:
    """docs with ids (array of int) in place of text, and exact: decoding gives the text again.

    A null text has null ids and exact true; an empty one no ids. Other columns and rows pass, in place, but a column
    named ids or exact is replaced. The vocabulary (some ten thousand pieces, whatever the corpus) is broadcast.
    """
    get = _codecs(docs, vocabulary)
    others = [c for c in docs.columns if c not in ("text", "ids", "exact")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                ids = [None if t is None else codec.encode(t) for t in texts]
                exact = [t is None or codec.decode(x) == t for t, x in zip(texts, ids, strict=True)]
                limits = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
                array = pa.ListArray.from_arrays(pa.array(limits), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), array, pa.array(exact)], [*others, "ids", "exact"])

    schema = docs.select(*others).schema.add("ids", ArrayType(IntegerType())).add("exact", "boolean")
    return docs.select(*others, "text").mapInArrow(run, schema)


def decoded(docs: DataFrame, vocabulary: list[tuple[str, float, str]]) -> DataFrame:
    """docs with text in place of ids (null where ids are null)."""
    get = _codecs(docs, vocabulary)
    others = [c for c in docs.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    return docs.select(*others, "ids").mapInArrow(run, docs.select(*others).schema.add("text", "string"))
