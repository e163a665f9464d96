"""Sinks: JSON lines that keep nesting, Parquet with nested columns as JSON text, by the path's suffix."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Writes by suffix: ``.parquet``, else JSON lines. The job's commit makes the output appear at once."""
    out = (flat(df) if path.endswith(".parquet") else df).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path) if path.endswith(".parquet") else out.json(path)


class FrozenError(ValueError):
    """A frozen artifact isn't what its hash says."""


def freeze(payload: dict, path: str) -> str:
    """Writes a configuration-sized artifact and its hash beside it, each at once; returns the hash."""
    raw = json.dumps(payload, sort_keys=True, ensure_ascii=False, indent=1).encode()
    digest = "sha256:" + hashlib.sha256(raw).hexdigest()
    for name, content in ((path, raw), (f"{path}.hash", digest.encode())):
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(name)), delete=False) as file:
            file.write(content)
        os.replace(file.name, name)
    return digest


def thaw(path: str) -> dict:
    """Reads a frozen artifact; raises FrozenError if it was changed."""
    with open(path, "rb") as file, open(f"{path}.hash", "rb") as stored:
        raw, digest = file.read(), stored.read().decode()
    if "sha256:" + hashlib.sha256(raw).hexdigest() != digest:
        raise FrozenError(path)
    return json.loads(raw)
