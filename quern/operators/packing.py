"""Fixed-length windows filled from endless lane streams, in closed form.

A lane's documents, epoch after epoch, form one line of tokens; its windows, in order of (step, slot), are consecutive
intervals of that line. A window's segments are the overlaps of the two, so every step can be computed by itself.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order import running
from quern.runtime import ship


def windows(slots: DataFrame) -> DataFrame:
    """Interval ``ws, we`` of each (step, slot) on the line of its lane."""
    placed = running(slots, ["lane"], ["step", "slot"], F.col("sequence_length").cast("bigint"), F.floor(F.col("step") / 64), "ws")
    return placed.withColumn("we", F.col("ws") + F.col("sequence_length"))


def stream(pool: DataFrame, wins: DataFrame, seed: str) -> DataFrame:
    """Interval ``ds, de`` of each document in each epoch that the windows reach.

    ``pool``: ``lane, shard_id, document_id, start_token, end_token, response_start_token``. Within an epoch documents
    are ordered by a hash of (seed, lane, epoch, document); its leading digits are the parts of the running sum.
    """
    length = F.col("end_token") - F.col("start_token")
    totals = pool.groupBy("lane").agg(F.sum(length).alias("lane_tokens"))  # a row a lane
    needed = wins.groupBy("lane").agg(F.max("we").alias("reach")).join(totals, "lane").withColumn("epochs", F.ceil(F.col("reach") / F.col("lane_tokens")))
    rows = pool.join(F.broadcast(needed), "lane").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.lit("lane_sequence"), "lane", F.col("epoch").cast("string"), "shard_id", "document_id"), 256)
    ordered = rows.withColumn("key", key).withColumn("n", length)
    placed = running(ordered, ["lane", "epoch"], ["key"], F.col("n"), F.substring("key", 1, 2), "offset")
    return placed.withColumn("ds", F.col("epoch") * F.col("lane_tokens") + F.col("offset")).withColumn("de", F.col("ds") + F.col("n"))


def segments(wins: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Overlaps of windows and documents of a lane, as an equi-join on (lane, bucket of ``width`` tokens).

    ``width`` is at least the longest window. A pair is kept only in the bucket where its overlap starts, so no pair
    comes twice.
    """
    bucket = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    left = wins.withColumn("bucket", bucket("ws", "we"))
    right = docs.select("lane", "shard_id", "document_id", "start_token", "end_token", "response_start_token", "ds", "de").withColumn("bucket", bucket("ds", "de"))
    start = F.greatest("ws", "ds")
    pairs = left.join(right, ["lane", "bucket"]).filter((F.col("ds") < F.col("we")) & (F.col("de") > F.col("ws")) & (F.floor(start / width) == F.col("bucket")))
    return pairs.select(
        "step",
        "slot",
        *[c for c in ("stage",) if c in wins.columns],
        "lane",
        "sequence_length",
        "shard_id",
        "document_id",
        (start - F.col("ws")).alias("w_start"),
        (F.least("we", "de") - F.col("ws")).alias("w_end"),
        (F.col("start_token") + start - F.col("ds")).alias("s_start"),
        (F.col("start_token") + F.least("we", "de") - F.col("ds")).alias("s_end"),
        "response_start_token",
    )


class Pending:
    """Documents of an epoch that wait to be packed, by length; those of one length in the epoch's order."""

    def __init__(self, docs: list[tuple]):
        self.by_length: dict[int, deque] = {}
        for doc in docs:
            self.by_length.setdefault(doc[3] - doc[2], deque()).append(doc)
        self.lengths = sorted(self.by_length)

    def pick(self, room: int) -> tuple:
        """The longest document that fits, else the shortest of all; the earliest of one length."""
        at = max(bisect.bisect_right(self.lengths, room) - 1, 0)
        own = self.by_length[self.lengths[at]]
        doc = own.popleft()
        if not own:
            del self.lengths[at]
        return doc


def best_fit_segments(wins: DataFrame, pool: DataFrame, seed: str) -> DataFrame:
    """Segments of ``wins`` (of ``windows``) where each window takes the document of the epoch that fits it best.

    Documents that don't fit are cut, and their rest goes first into the lane's next window. As each choice depends on
    all before it, a lane is one stream of narrow rows, its documents first; what waits of an epoch is in memory. Lanes
    without tokens have no segments; documents without tokens are never taken.
    """
    ship(wins.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    docs = pool.select("lane", F.lit(0).alias("kind"), none("bigint").alias("step"), none("int").alias("slot"), none("string").alias("stage"), none("int").alias("sequence_length"), "shard_id", "document_id", F.col("start_token").cast("bigint"), F.col("end_token").cast("bigint"), F.col("response_start_token").cast("bigint"))
    rows = docs.filter("end_token > start_token").unionByName(wins.select("lane", F.lit(1).alias("kind"), F.col("step").cast("bigint"), F.col("slot").cast("int"), "stage", F.col("sequence_length").cast("int"), *[none(k).alias(c) for c, k in (("shard_id", "string"), ("document_id", "string"), ("start_token", "bigint"), ("end_token", "bigint"), ("response_start_token", "bigint"))]))
    out = pa.schema([("step", pa.int64()), ("slot", pa.int32()), ("stage", pa.string()), ("lane", pa.string()), ("sequence_length", pa.int32()), ("shard_id", pa.string()), ("document_id", pa.string()), *[(c, pa.int64()) for c in ("w_start", "w_end", "s_start", "s_end", "response_start_token")]])

    def run(batches):
        lane, known, epoch, pending, carry = None, [], 0, None, None
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if r["lane"] != lane:
                    lane, known, epoch, pending, carry = r["lane"], [], 0, None, None
                if r["kind"] == 0:
                    known.append((r["shard_id"], r["document_id"], r["start_token"], r["end_token"], r["response_start_token"]))
                    continue
                at, length = 0, r["sequence_length"]
                while at < length and known:
                    if carry is None:
                        if pending is None or not pending.lengths:
                            key = lambda d, e=epoch: hashlib.sha256(f"{seed}:lane_sequence:{lane}:{e}:{d[0]}:{d[1]}".encode()).hexdigest()
                            pending, epoch = Pending(sorted(known, key=key)), epoch + 1
                        carry = pending.pick(length - at)
                    shard, doc, low, high, response = carry
                    take = min(length - at, high - low)
                    made.append((r["step"], r["slot"], r["stage"], lane, length, shard, doc, at, at + take, low, low + take, response))
                    at += take
                    carry = (shard, doc, low + take, high, response) if low + take < high else None
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(out)], schema=out)

    ordered = rows.repartition("lane").sortWithinPartitions("lane", "kind", "step", "slot", "shard_id", "start_token")
    return ordered.mapInArrow(run, "step bigint, slot int, stage string, lane string, sequence_length int, shard_id string, document_id string, w_start bigint, w_end bigint, s_start bigint, s_end bigint, response_start_token bigint")


def prompt_tokens() -> Column:
    """Masked prompt tokens of a segment: those before the response, in lanes that keep their structure."""
    response = F.col("response_start_token")
    return F.when(response > F.col("s_start"), F.least(response, F.col("s_end")) - F.col("s_start")).otherwise(F.lit(0))


def useful_tokens() -> Column:
    """Tokens of a segment that count in the loss: not the prompt, not the window's last position."""
    last = (F.col("w_end") == F.col("sequence_length")) & (F.col("w_start") + prompt_tokens() < F.col("sequence_length"))
    return F.col("w_end") - F.col("w_start") - prompt_tokens() - last.cast("int")


def samples(segs: DataFrame) -> DataFrame:
    """One row a window: its segments in order, and per position the segment, the place in it and the loss mask."""
    entry = F.struct("w_start", "w_end", "shard_id", "document_id", "s_start", "s_end", prompt_tokens().alias("prompt"))
    packed = segs.groupBy("step", "slot", "lane", "sequence_length").agg(F.array_sort(F.collect_list(entry)).alias("segments"))
    size = lambda s: (s["w_end"] - s["w_start"]).cast("int")
    segment = F.flatten(F.transform("segments", lambda s, i: F.array_repeat(i, size(s))))
    position = F.flatten(F.transform("segments", lambda s: F.sequence(F.lit(0), size(s) - 1)))
    mask = F.flatten(F.transform("segments", lambda s: F.concat(F.array_repeat(F.lit(0), s["prompt"].cast("int")), F.array_repeat(F.lit(1), size(s) - s["prompt"].cast("int")))))
    cut = F.concat(F.slice(mask, F.lit(1), F.size(mask) - 1), F.array(F.lit(0)))
    return packed.withColumn("segment_id", segment).withColumn("position_id", position).withColumn("loss_mask", cut)


def mask_hash(mask: Column) -> Column:
    """sha256 of the mask's bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(F.transform(mask, lambda x: F.when(x == 1, "01").otherwise("00")), "")), 256))
