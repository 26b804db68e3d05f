"""Personal data: base patterns, and more spans by weak supervision.

Base spans are fixed patterns. Candidates (the base spans, phone numbers without a country code, social-security
shapes and titled names) are voted on by labellers on patterns, word lists and context; expectation-maximisation over
the counts of all vote patterns in the corpus estimates their reliabilities, and a linear span classifier is trained
on the posteriors. A candidate that the classifier accepts is a span; base spans stay whatever it says.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from chunklens.llm.shared import Scratch
from chunklens.llm.weak_labels import ABSTAIN, NO, YES, logistic, reliabilities

KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "name")
#: Word lists of the labellers.
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu at ch it".split())
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
NAMES = frozenset(
    "Adam Alice Ana Andrea Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Christian Claire Claude Daniel David Diego Elena Elizabeth Emily Emma Eric Eva "
    "Fernando Francisco Franz François George Hans Heinrich Helen Isabel Jack Jacques James Jane Javier Jean Jennifer Johann John Jorge Jose José Joseph Juan Julia "
    "Julie Karl Karen Klaus Laura Linda Louis Lucas Lucia Luis Manuel Marc Margaret Maria Marie Mark Martin Mary Michael Michel Miguel Monika Nancy Nicole Olivier "
    "Pablo Patricia Paul Pedro Peter Philippe Pierre Richard Robert Rosa Sabine Sandra Sarah Sophie Stefan Steven Susan Sven Thomas Ursula Werner William Wolfgang "
    "Anderson Becker Bernard Brown Davis Dubois Durand Fernandez Fischer Garcia Gomez Gonzalez Hernandez Hoffmann Johnson Jones Lopez Martinez Meyer Miller Moreau "
    "Müller Perez Petit Rodriguez Sanchez Schmidt Schneider Schulz Smith Taylor Torres Wagner Weber Williams Wilson".split()
)
CUES = re.compile(r"(?:call|tel|phone|mobile|fax|mail|contact|card|visa|address|ssn|social|write|reach|name)", re.I | re.A)
AGAINST = re.compile(r"(?:version|order|invoice|isbn|serial|ref|part|chapter|page|figure|id|no\.|nr\.)", re.I | re.A)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(rf"(?:{'|'.join(map(re.escape, TITLES))})\x20[^\W\d_a-z][^\W\d_]+(?:\x20[^\W\d_a-z][^\W\d_]+)?")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, sought from each @ back over the characters of a local part: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        after = at + 1
        if start < at and (found := _DOMAIN.match(text, at)):
            yield start, found.end()
            end = after = found.end()
        else:
            end = max(end, after)  # the local part ends at the @; a later one begins behind it
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ascending, in code points."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def _votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """The labellers, in order: pattern, format, word list, cue before, counter-cue before, edges, repeated digits."""
    own, before = text[start:end], text[max(0, start - 24) : start]
    digits = "".join(c for c in own if "0" <= c <= "9")
    pattern = YES if base else ABSTAIN
    shape = ABSTAIN
    if kind in (3, 4):
        shape = ABSTAIN if 10 <= len(digits) <= 13 else NO
    elif kind == 5:
        shape = NO if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else ABSTAIN
    listed = ABSTAIN
    if kind == 0:
        listed = YES if own.rpartition(".")[2].lower() in DOMAINS else NO
    elif kind == 1:
        listed = NO if own.split(".")[0] in ("0", "127", "255") else ABSTAIN
    elif kind == 6:
        listed = YES if NAMES & set(own.split()) else ABSTAIN
    cue = YES if CUES.search(before) else ABSTAIN
    against = NO if AGAINST.search(before) else ABSTAIN
    edges = NO if (start and text[start - 1].isalnum() and own[0].isalnum()) or text[end : end + 1].isalnum() else ABSTAIN
    repeated = ABSTAIN if kind in (0, 1, 6) else NO if len(set(digits)) <= 2 else ABSTAIN
    return pattern, shape, listed, cue, against, edges, repeated


LABELLERS = 7
#: What a candidate's pattern alone says: the share of candidates that are personal data, before the labellers vote.
PRIOR = 0.7
#: Values of the text's features that the classifier sees beside the votes.
SHAPES = (3, 3, 4, 3)


def _shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """The character before and the one after (none or space, letter or digit, other), the length, the share of digits."""
    beside = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    length, digits = end - start, sum("0" <= c <= "9" for c in text[start:end])
    return beside(text[start - 1 : start] if start else ""), beside(text[end : end + 1]), (length > 8) + (length > 14) + (length > 20), (digits > 0) + (2 * digits > length)


def spans_of(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, base, code of votes, shape and kind) of all candidates of a text, ascending; the base spans among them."""
    base = base_spans(text)
    more = []
    if any(c in text for c in "-. ") and _DIGITS.search(text):
        taken = [(s, e) for s, k, e in base if k in (2, 3)]
        for kind, pattern in ((4, _LOCAL_PHONE), (5, _NATIONAL)):
            more += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if not any(s < m.end() and m.start() < e for s, e in taken)]
    if any(t in text for t in TITLES):
        more += [(m.start(), 6, m.end()) for m in _NAME.finditer(text)]
    out = []
    for own, is_base in ((base, True), (more, False)):
        for s, k, e in own:
            code = 0
            for v in _votes(text, s, k, e, is_base):
                code = code * 3 + v
            for v, many in zip(_shape(text, s, e), SHAPES, strict=True):
                code = code * many + v
            out.append((s, k, e, is_base, code * len(KINDS) + k))
    return sorted(out)


_FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, found array<struct<start:int,kind:int,end:int,base:boolean,code:int>>"
_NAMES = ("start", "kind", "end", "base", "code")
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())])


def candidates(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all candidates, of each row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [spans_of(t) if t else [] for t in part.column(1).to_pylist()]
                digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, b, _ in x if b).encode()).hexdigest() for x in found]
                counts = [pa.array([sum(b and k == kind for _, k, _, b, _ in x) for x in found], pa.int64()) for kind in range(4)]
                spans = pa.array([[dict(zip(_NAMES, s, strict=True)) for s in x] for x in found], pa.list_(_SPAN))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *counts, pa.array(digests, pa.string()), spans], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def accepted(found: DataFrame) -> list[int]:
    """The codes whose spans the trained classifier accepts, from all rows of candidates(): expectation-maximisation by
    kind, over the votes; then one linear classifier of votes, shape and kind for all, so that what a kind's votes leave
    open is decided by what its spans look like. As many rows are collected as codes occur, however many spans there are."""
    rows = found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()
    if not rows:
        return []
    codes, counts = np.array([r["code"] for r in rows], np.int64), np.array([r["count"] for r in rows], float)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    kinds, rest, features, posterior = codes % len(KINDS), codes // len(KINDS), [], np.zeros(len(codes))
    for many in reversed(SHAPES):
        features.append(np.eye(many)[rest % many])
        rest = rest // many
    votes = np.stack([rest // 3**i % 3 for i in range(LABELLERS - 1, -1, -1)], 1)
    for kind in np.unique(kinds):
        own = kinds == kind
        posterior[own] = reliabilities(votes[own], counts[own], prior=PRIOR, belief=0.95, one_sided=True)[0]
    features = np.concatenate([np.eye(len(KINDS))[kinds], *(np.eye(3)[votes[:, i]] for i in range(LABELLERS)), *features], 1)
    w, b = logistic(features, posterior, np.sqrt(counts))
    return codes[features @ w + b > 0].tolist()


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs(doc_id, text, ...).

    spans: kind:start:end of all spans, by start and then kind, comma-joined; offsets are code points, ends exclusive.
    A null or empty text has none; a null doc_id stays null, repeated rows stay repeated; other columns are not read.
    """
    found = Scratch(docs.sparkSession, "personal").keep(candidates(docs), "candidates")
    codes = F.array(*map(F.lit, accepted(found))).cast("array<int>")
    kept = F.filter("found", lambda x: x["base"] | F.array_contains(codes, x["code"]))
    kinds = F.array(*map(F.lit, KINDS))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.array_join(F.transform(kept, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ",").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal_data() in text replaced by its kind in brackets, overlapping spans by the kind of
    the first. n_chars, where docs has it, is the length of the new text. Other columns pass unchanged, repeated rows
    stay repeated, null and empty texts stay so; a column of docs may have any other name. The spans are sought once:
    rows with their candidates are written to the shared folder, and the classifier's choice is applied to those."""
    name, columns = "candidates", docs.columns
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    span = ArrayType(StructType([StructField(x, IntegerType()) for x in ("start", "kind", "end")] + [StructField("base", BooleanType()), StructField("code", IntegerType())]))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [spans_of(t) if t else [] for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[dict(zip(_NAMES, s, strict=True)) for s in x] for x in found], pa.list_(_SPAN))], [*part.schema.names, name])

    kept = Scratch(docs.sparkSession, "redact").keep(docs.mapInArrow(seek, StructType([*docs.schema.fields, StructField(name, span)])), name)
    codes = set(accepted(kept.select(F.col(name).alias("found"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.schema.get_field_index("text"), []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(name)).to_pylist(), strict=True):
                parts, end, stop = [], 0, 0
                for x in found or ():
                    if not x["base"] and x["code"] not in codes:
                        continue
                    if x["start"] >= stop:
                        parts += [text[end : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
                    stop = end = max(stop, x["end"])
                out.append("".join([*parts, text[end:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select(columns)

    done = kept.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
