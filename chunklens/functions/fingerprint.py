"""Scalar functions on fingerprints (24 lower-case hex digits), positions and sizes, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = 24  # bytes of an index entry
ZERO = "0" * 24


def truncate(digest: Column) -> Column:
    """The first 12 bytes of a hex digest; shorter ones are padded with zeros (never with bytes of another chunk)."""
    return F.rpad(F.substring(digest, 1, 24), 24, "0")


def _hex(part: Column) -> Column:
    return F.conv(part, 16, 10).cast("bigint")


def is_hook(fp: Column, factor: int) -> Column:
    """One of 2 ** factor fingerprints: the first factor div 8 bytes are 0, and the low factor % 8 bits of the next."""
    whole, bits = divmod(factor, 8)
    test = F.substring(fp, 1, 2 * whole) == "0" * (2 * whole) if whole else F.lit(True)
    return test & (_hex(F.substring(fp, 1 + 2 * whole, 2)).bitwiseAND(F.lit((1 << bits) - 1)) == 0) if bits else test


def is_landmark(fp: Column, divisor: int) -> Column:
    """The first four bytes as a little-endian number are a multiple of divisor (segment size / mean chunk size)."""
    low_first = F.concat(*(F.substring(fp, i, 2) for i in (7, 5, 3, 1)))
    return _hex(low_first) % divisor == 0


def dice(fp: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the fingerprint and seed alone: the simulated filter's false positives."""
    return _hex(F.substring(F.md5(F.concat(fp, F.lit(f"|{seed}"))), 1, 12)) / F.lit(float(1 << 48))


def page_of_position(pos: Column, page_bytes: int) -> Column:
    return F.floor(pos / (page_bytes // ENTRY)).cast("bigint")


def page_of_unit(unit_id: Column, page_bytes: int, unit_bytes: int, mean_chunk: int) -> Column:
    """Page of a container or block; a mapping larger than a page has a page of its own."""
    return F.floor(unit_id / max(1, page_bytes // ((unit_bytes // mean_chunk) * ENTRY))).cast("bigint")


def round_up(value: Column, multiple: int) -> Column:
    return (F.ceil(value / multiple) * multiple).cast("bigint")


def container_metadata(container_bytes: int, mean_chunk: int) -> int:
    return -(-ENTRY * (container_bytes // mean_chunk) // 4096) * 4096


def segment_bytes(distinct: Column) -> Column:
    return 24 + 20 * distinct


def block_distance(current: Column, last: Column) -> Column:
    """Difference modulo 2 ** 32."""
    return F.pmod(current - last, F.lit(1 << 32)).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / whole.cast("double"))


def shard(fp: Column, shards: int = 256) -> Column:
    return _hex(F.substring(fp, 1, 2)) % shards


def wide_shard(fp: Column, shards: int = 1024) -> Column:
    """The first eight bytes as a little-endian number, modulo shards: a power of two up to 65 536, so that two count."""
    return _hex(F.concat(F.substring(fp, 3, 2), F.substring(fp, 1, 2))) % shards
