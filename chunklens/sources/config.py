"""Configurations: one JSON object in a file, read into a dataclass."""

from __future__ import annotations

import dataclasses
import json
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def read_config(spark: SparkSession, path: str, kind: type[T]) -> T:
    """An instance of the dataclass `kind` with the settings of a file anywhere that Spark can read.

    Names match whatever their case and underscores (SegmentSize is segment_size); names that the dataclass lacks are
    left out, as are nulls, so that its defaults hold. A file that holds no object, or two settings of one name, is a
    ValueError; a field without a default that the file lacks is a TypeError.
    """
    plain = lambda name: name.replace("_", "").lower()
    fields, found = {plain(f.name): f.name for f in dataclasses.fields(kind) if f.init}, {}
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no JSON object")
    for name, value in given.items():
        field = fields.get(plain(name))
        if field and value is not None:
            if field in found:
                raise ValueError(f"{path} sets {field} twice")
            found[field] = value
    return kind(**found)
