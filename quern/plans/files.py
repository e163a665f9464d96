"""Queries that pass tables through the file sources, the sinks and a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.plans.catalog import query
from quern.runtime import shared_folder, table
from quern.sources import files, sinks
from quern.streaming import ingest


def _place(spark, suffix: str) -> str:
    return f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}{suffix}"


@query("src_4_json_lines", "select id, coalesce(text, '') as text from clean_records")
def json_lines(spark, folder):
    path = _place(spark, ".jsonl")
    sinks.write(table(spark, folder, "clean_records").select("id", "text", "ghost_tokens"), path)
    return files.load(spark, path)


@query("src_5_json_array", "select doc_id::varchar as id, text from documents where text is not null")
def json_array(spark, folder):
    path = _place(spark, "")
    # one array a file, as exported by other programs
    rows = table(spark, folder, "documents").filter("text is not null").select(F.expr("doc_id div 256").alias("batch"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("r"))
    rows.groupBy("batch").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")).select("value").write.option("lineSep", "\n").text(path)
    arrays = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<id:string,text:string>>")).alias("r"))
    return arrays.select("r.id", "r.text")


@query("src_6_csv", "select doc_id::varchar as id, coalesce(source, '') as text from documents")
def csv(spark, folder):
    path = _place(spark, ".csv")
    table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source").write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.load(spark, path, ["source"])


@query("src_8_text_lines", "select l as text, count(*) as n from (select unnest(string_split(site, chr(10))) as l from extracted_pages where site is not null) where trim(l) <> '' group by 1")
def text_lines(spark, folder):
    path = _place(spark, ".txt")
    table(spark, folder, "extracted_pages").filter("site is not null").select("site").write.text(path)
    return files.load(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("snk_1_json_round_trip", "select id, clean_len, ghost_tokens['pipe_angle'] as pipe_angle from clean_records")
def json_round_trip(spark, folder):
    path = _place(spark, ".jsonl")
    sinks.write(table(spark, folder, "clean_records").select("id", "clean_len", "ghost_tokens"), path)
    return spark.read.schema("id string, clean_len int, ghost_tokens map<string,int>").json(path).select("id", "clean_len", F.try_element_at("ghost_tokens", F.lit("pipe_angle")).alias("pipe_angle"))


@query("snk_2_parquet_flat", "select id, ghost_tokens::json::varchar as ghost_tokens from clean_records")
def parquet_flat(spark, folder):
    path = _place(spark, ".parquet")
    sinks.write(table(spark, folder, "clean_records").select("id", "ghost_tokens"), path)
    return spark.read.parquet(path)


@query("stream_append", "select distinct doc_id, source from documents")
def stream_append(spark, folder):
    source = table(spark, folder, "documents").select("doc_id", "source")
    path, log = _place(spark, ".parquet"), _place(spark, "-log")
    stream = ingest.open_stream(spark, f"{folder}/documents.parquet*", table(spark, folder, "documents").schema).select("doc_id", "source")
    ingest.append_stream(stream, path, log, ["doc_id"]).awaitTermination()
    return spark.read.schema(source.schema).parquet(path)


@query("stream_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark, folder):
    return ingest.windowed_counts(table(spark, folder, "events"))
