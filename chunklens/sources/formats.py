"""Trace file formats as Spark data sources: chunk_trace_pb and chunk_trace_legacy, one partition for each file.

Both give the rows (path, entry, filename, file_size, file_type, file_label, partial, chunk_seq, digest, size); a file
without chunks gives one row with a null chunk_seq. The data source API reads with Python's open(): for paths that only
Spark can read, use parse() over the binaryFile source.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, entry bigint, filename string, file_size bigint, file_type string, file_label string, partial boolean, chunk_seq int, digest string, size bigint"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); a number that the data cut short is an error."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def _fields(message: bytes) -> dict[int, object]:
    out, at = {}, 0
    while at < len(message):
        tag, at = _varint(message, at)
        if tag & 7 == 0:
            out[tag >> 3], at = _varint(message, at)
        elif tag & 7 == 2:
            n, at = _varint(message, at)
            out[tag >> 3], at = message[at : at + n], at + n
        elif tag & 7 in (1, 5):
            at += 8 if tag & 7 == 1 else 4
        else:
            raise ValueError(f"wire type {tag & 7}")
    return out


def _write_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def encode_message(fields: dict[int, object]) -> bytes:
    """A length-delimited message of integer, text and byte fields."""
    body = b""
    for number, value in fields.items():
        if isinstance(value, int):
            body += _write_varint(number << 3) + _write_varint(int(value))
        else:
            raw = value.encode() if isinstance(value, str) else value
            body += _write_varint(number << 3 | 2) + _write_varint(len(raw)) + raw
    return _write_varint(len(body)) + body


def encode_entry(filename: str, chunks: list[tuple[bytes, int]], size: int = 0, kind: str = "", label: str = "", partial: bool = False) -> bytes:
    """A file message and its chunk messages."""
    return encode_message({1: filename, 2: size, 3: kind, 4: len(chunks), 5: label, 6: int(partial)}) + b"".join(encode_message({2: d, 3: n}) for d, n in chunks)


def encode_legacy(filename: str, chunks: list[tuple[bytes, int]], size: int = 0, kind: str = "") -> bytes:
    """A text header, a record for each chunk (sizes under 2 ** 32, digests cut or padded to 20 bytes), and the end mark."""
    records = b"".join(b"\x18" + n.to_bytes(4, "little") + d[:20].ljust(20, b"\0") for d, n in chunks)
    return "\t".join([filename, str(size), *([kind] if kind else [])]).encode() + b"\n" + records + b"0\n"


def read_pb(path: str, data: bytes) -> Iterator[tuple]:
    """Length-delimited file messages, each with as many chunk messages as it says, to the end."""
    at = entry = 0
    while at < len(data):
        n, at = _varint(data, at)
        f, at = _fields(data[at : at + n]), at + n
        text = lambda k, f=f: f.get(k, b"").decode(errors="replace")
        head = (path, entry, text(1), f.get(2, 0), text(3), text(5), bool(f.get(6, 0)))
        for i in range(f.get(4, 0)):
            n, at = _varint(data, at)
            c, at = _fields(data[at : at + n]), at + n
            yield (*head, i, c.get(2, b"").hex(), c.get(3, 0))
        if not f.get(4, 0):
            yield (*head, None, None, None)
        entry += 1


def read_legacy(path: str, data: bytes) -> Iterator[tuple]:
    """Text headers "name, size[, type]" by tabs, then records: 24, a 4-byte little-endian size, a 20-byte digest; a 0
    and a line end close the list. A size of 64 KB or more ends the file's chunks there."""
    at = entry = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        parts = data[at:end].decode(errors="replace").split("\t")
        at, i, open_ = end + 1, 0, True
        size = int(parts[1]) if len(parts) > 1 and parts[1].strip().isdigit() else 0
        head = (path, entry, parts[0], size, parts[2] if len(parts) > 2 else "", "", False)
        while at < len(data) and data[at] == 24:
            n = int.from_bytes(data[at + 1 : at + 5], "little")
            open_ = open_ and n < 64 * 1024
            if open_:
                yield (*head, i, data[at + 5 : at + 25].hex(), n)
                i += 1
            at += 25
        if not i:
            yield (*head, None, None, None)
        at += 2  # the 0 and the line end
        entry += 1


PARSERS = {"pb": read_pb, "legacy": read_legacy}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, parser: str) -> None:
        self.path, self.parser = options["path"], parser

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found if os.path.isfile(p)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from PARSERS[self.parser](partition.path, f.read())


class PbTrace(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_trace_pb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "pb")


class LegacyTrace(PbTrace):
    @classmethod
    def name(cls) -> str:
        return "chunk_trace_legacy"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "legacy")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PbTrace)
    spark.dataSource.register(LegacyTrace)


def parse(files: DataFrame) -> DataFrame:
    """Rows of files(path, content) of the binaryFile source; a path with a folder named imt is read as legacy."""

    def run(batches):
        import itertools

        import pandas as pd

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for rows in batches:
            found = itertools.chain.from_iterable(PARSERS["legacy" if "imt" in path.split("/") else "pb"](path, bytes(content)) for path, content in zip(rows["path"], rows["content"], strict=True))
            while out := list(itertools.islice(found, 20_000)):  # rows of many small files or a part of a large one
                yield pd.DataFrame(out, columns=columns).astype({"chunk_seq": "Int32", "size": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def encode(files: DataFrame, kind: str) -> DataFrame:
    """(path, content) of files(path, filename, chunks: array of (digest as hex, size)), a trace file for each row.

    pb: the first half of the chunks goes into a partial message, the rest into the whole one that follows.
    """

    def run(batches):
        import pandas as pd

        for rows in batches:
            contents = []
            for name, found in zip(rows["filename"], rows["chunks"], strict=True):
                chunks = [(bytes.fromhex(c["digest"]), int(c["size"])) for c in found]
                half = len(chunks) // 2
                contents.append(encode_legacy(name, chunks) if kind == "legacy" else encode_entry(name, chunks[:half], partial=True) + encode_entry(name, chunks[half:]))
            yield pd.DataFrame({"path": rows["path"], "content": contents})

    return files.select("path", "filename", "chunks").mapInPandas(run, "path string, content binary")


def assemble(rows: DataFrame) -> DataFrame:
    """Partial messages of a file name joined with the first whole one that follows: (path, entry, filename, chunk_count,
    chunk_seq, fp, size), chunk_count that of the last part."""
    from pyspark.sql import Window

    messages = rows.groupBy("path", "entry", "filename", "partial").agg(F.count("chunk_seq").alias("n"))
    before = Window.partitionBy("path", "filename").orderBy("entry")
    group = F.coalesce(F.sum((~F.col("partial")).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = messages.withColumn("grp", group)
    whole = Window.partitionBy("path", "filename", "grp")
    parts = parts.withColumn("last", F.max("entry").over(whole)).withColumn("chunk_count", F.max_by("n", "entry").over(whole)).withColumn("closed", F.max((~F.col("partial")).cast("int")).over(whole) == 1)
    offset = F.coalesce(F.sum("n").over(whole.orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("offset", offset).where("closed").select("path", "entry", "last", "chunk_count", "offset")
    from chunklens.functions.fingerprint import truncate

    return rows.where("chunk_seq is not null").join(parts, ["path", "entry"]).select(
        "path", F.col("last").alias("entry"), "filename", "chunk_count", (F.col("offset") + F.col("chunk_seq")).cast("bigint").alias("chunk_seq"), truncate(F.col("digest")).alias("fp"), "size"
    )
