"""Properties files: one key=value a line."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def read(text: str) -> dict[str, str]:
    """Comments (# or !), blank lines and lines without = don't count; later keys win; no escapes."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, eq, value = line.partition("=")
        if eq and line[0] not in "#!":
            out[key.strip()] = value.strip()
    return out


def write(values: Mapping[str, Any], title: str) -> str:
    """A title comment and the values in order, None left out."""
    return "".join([f"#{title}\n", *(f"{k}={v}\n" for k, v in values.items() if v is not None)])


def pairs(text: Column) -> Column:
    """array<struct<key,value>> of a properties text, in order of lines."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x.contains("=") & ~x.rlike("^[#!]"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
