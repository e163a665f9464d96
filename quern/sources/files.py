"""Document sources: local files of several formats as ``id, text``."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Reader of each suffix.
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".txt": "text", ".md": "text"}


def text_column(df: DataFrame, fields: list[str]) -> Column:
    """One field, or several joined by a blank line; empty and null ones are left out, '' for none."""
    missing = [f for f in fields if f not in df.columns]
    if missing or not fields:
        raise ValueError(f"no such text column: {missing or 'none given'}")
    if len(fields) == 1:
        return F.coalesce(F.col(fields[0]).cast("string"), F.lit(""))
    return F.concat_ws("\n\n", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields])


def _identified(df: DataFrame, fields: list[str], id_field: str | None) -> DataFrame:
    """``id, text``; without an id column, or where it is null, the id is the row's index in its file.

    Indices are counted by blocks of a file (its own row index in Parquet), so no task reads a whole file, and are the
    same however files are split. With several files their names go before the index.
    """
    text = text_column(df, fields).alias("text")
    known = F.col(id_field).cast("string") if id_field and id_field in df.columns else F.lit(None).cast("string")
    if id_field and id_field in df.columns and "_index" not in df.columns:
        return df.select(known.alias("id"), text)
    several = len(df.inputFiles()) > 1
    name = F.element_at(F.split("_file", "/"), -1)
    index = F.col("_index").cast("string")
    return df.select(F.coalesce(known, F.concat_ws("#", name, index) if several else index).alias("id"), text)


def indexed(raw: DataFrame) -> DataFrame:
    """``raw`` rows of files with ``_file`` and ``_index``, their place in the file (blank lines count)."""
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))
    blocks = placed.groupBy("_file", "_block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, ["_file", "_block"]).withColumn("_index", F.col("_start") + F.col("_m") - F.col("_first")).drop("_block", "_m", "_first", "_start")


def load(spark: SparkSession, path: str, fields: list[str] = ("text",), id_field: str | None = "id", kind: str | None = None, text_mode: str = "lines", limit: int | None = None) -> DataFrame:
    """Documents of a local path; the format by ``kind`` or else by suffix (a folder counts as Parquet).

    ``text_mode``: ``lines`` for a document a line (blank lines are none), ``file`` for a document a file. A JSON file
    is an array of records, or an object with the array in ``data``. A missing text is ''.
    """
    kind = kind or SUFFIXES.get(PurePosixPath(path).suffix.lower()) or ("parquet" if "." not in PurePosixPath(path).name else None)
    if kind is None:
        raise ValueError(f"no reader for {path}")
    fields = list(fields)
    if kind == "parquet":
        raw = spark.read.parquet(path)
        if id_field not in raw.columns:
            raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
        rows = _identified(raw, fields, id_field)
    elif kind == "csv":
        rows = _identified(indexed(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)), fields, id_field)
    elif kind == "jsonl":
        schema = spark.read.json(path).schema
        lines = indexed(spark.read.text(path)).filter(F.trim("value") != "")
        rows = _identified(lines.select(F.from_json("value", schema).alias("r"), "_file", "_index").select("r.*", "_file", "_index"), fields, id_field)
    elif kind == "json":
        raw = spark.read.option("multiLine", True).json(path)
        if raw.columns == ["data"]:
            raw = raw.select(F.posexplode("data").alias("_index", "r"), F.col("_metadata.file_path").alias("_file")).select("r.*", "_file", "_index")
        else:
            raw = indexed(raw)
        rows = _identified(raw, fields, id_field)
    elif kind == "text":
        raw = spark.read.text(path, wholetext=text_mode == "file")
        rows = _identified(indexed(raw), ["value"], None)
        rows = rows.filter(F.trim("text") != "") if text_mode == "lines" else rows
    else:
        raise ValueError(f"unknown kind {kind}")
    return rows.limit(limit) if limit is not None else rows


def documents(spark: SparkSession, source: str, **arguments) -> DataFrame:
    """Dispatch on the source: ``local`` (files), ``disk`` (a saved Parquet folder, with an optional split)."""
    if source == "local":
        if not arguments.get("path"):
            raise ValueError("a local source needs a path")
        return load(spark, **arguments)
    if source == "disk":
        path, split = arguments.pop("path", None), arguments.pop("split", None)
        if not path:
            raise ValueError("a saved source needs a path")
        return load(spark, f"{path}/{split}" if split else path, kind="parquet", **arguments)
    raise ValueError(f"unknown source {source}")
