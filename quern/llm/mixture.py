"""Mixing lanes to target weights by Pfair scheduling, with capped repetition and the shares that come out."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.labels import slug
from quern.operators.order import running
from quern.runtime import materialise, ship

#: Tokens of a block, so that no lane is further than this from its due share, however long the stage.
BLOCK = 65_536
#: A stage has at least so many blocks; shorter ones have smaller blocks.
LEAST_BLOCKS = 64
_BATCH = 50_000
_EPS = 1e-9


def mixtures(stages: DataFrame) -> DataFrame:
    """One row a lane of a stage: ``run_id, stage, span, cap, lane, weight, spelled``.

    Repeated stage rows count once (of different rows with one key, the greatest); stages without key, span or
    mixture have no lanes to mix and give none. Weights count relative to their sum; zero, negative and null
    weights take no part. A null cap is 1.
    """
    entry = F.array_sort(F.map_entries("mixture"))
    return (
        stages.filter("run_id is not null and stage is not null and mixture is not null and token_end > token_start")
        .groupBy("run_id", "stage")
        .agg(F.max(F.struct("token_start", "token_end", "max_repeat", entry.alias("entries"))).alias("s"))
        .select("run_id", "stage", (F.col("s.token_end") - F.col("s.token_start")).alias("span"), F.coalesce("s.max_repeat", F.lit(1)).alias("cap"), F.explode("s.entries").alias("e"))
        .select("run_id", "stage", "span", "cap", F.col("e.key").alias("lane"), F.col("e.value").alias("weight"), slug(F.col("e.key"), "_").alias("spelled"))
        .filter("weight > 0")
    )


def gathered(lanes: DataFrame) -> DataFrame:
    """One row a stage: ``run_id, stage, span, cap, lanes ARRAY<STRUCT<lane, weight, available>>``."""
    return lanes.groupBy("run_id", "stage", "span", "cap").agg(F.array_sort(F.collect_list(F.struct("lane", "weight", F.coalesce("available", F.lit(0)).alias("available")))).alias("lanes"))


def supplies(stages: DataFrame, lanes: DataFrame) -> DataFrame:
    """``gathered`` lanes of the stages with what ``lane_plans`` has for them.

    Of a lane's rows, spelled in any way, the latest ``recorded_at`` counts (at a tie the larger supply); no row, or a
    null supply in it, is a supply of 0.
    """
    latest = (
        lanes.filter("run_id is not null and stage is not null and lane is not null")
        .groupBy("run_id", "stage", slug(F.col("lane"), "_").alias("spelled"))
        .agg(F.max(F.struct("recorded_at", "available_tokens")).alias("last"))
        .select("run_id", "stage", "spelled", F.col("last.available_tokens").alias("available"))
    )
    return gathered(mixtures(stages).join(latest, ["run_id", "stage", "spelled"], "left"))


def pfair(weights: list[float], counts: list[int]) -> list[tuple[int, int, int, int]]:
    """Earliest deadline first over the blocks of Pfair tasks: (slot, task, release, deadline) in order of slots.

    Block ``i`` (from 1) of a task of weight ``w`` is released at ``floor((i - 1) / w)`` and due at ``ceil(i / w)``;
    weights sum to 1, so every block is served in its window and no task is a whole block from its due share.
    """
    done = [0] * len(weights)
    windows = [(0, math.ceil(1 / w - _EPS)) for w in weights]
    left = {k for k, n in enumerate(counts) if n}
    out, slot = [], 0
    while left:
        ready = [(windows[k][1], k) for k in left if windows[k][0] <= slot]
        if ready:
            _, k = min(ready)
            out.append((slot, k, *windows[k]))
            done[k] += 1
            if done[k] == counts[k]:
                left.discard(k)
            else:
                w = weights[k]
                windows[k] = (math.floor(done[k] / w + _EPS), math.ceil((done[k] + 1) / w - _EPS))
            slot += 1
        else:
            slot = min(windows[k][0] for k in left)
    return out


BLOCKS = pa.schema(
    [("run_id", pa.string()), ("stage", pa.string()), ("lane", pa.string()), ("available", pa.int64()), ("share", pa.float64()), ("target", pa.float64())]
    + [(n, pa.int64()) for n in ("slot", "block_no", "release", "deadline", "size")]
    + [("due_to", pa.float64()), ("served_to", pa.float64()), ("lag", pa.float64())]
)
_KINDS = {pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double"}


def scheduled(span: int, cap: int, lanes: list[dict], block: int = BLOCK, least: int = LEAST_BLOCKS):
    """The blocks of one stage in the order in which they are served, one tuple each (see ``serve``)."""
    total = sum(x["weight"] for x in lanes)
    size = max(1, min(block, span // least))
    shares = [x["weight"] / total for x in lanes]
    targets = [w * span for w in shares]
    taken, counts = [0] * len(lanes), [0] * len(lanes)
    for slot, k, release, due in pfair(shares, [max(1, math.ceil(t / size - _EPS)) for t in targets]):
        supply = lanes[k]["available"] * cap
        counts[k] += 1
        due_to = targets[k] if counts[k] * size > targets[k] - _EPS * size else float(counts[k] * size)
        taken[k] = max(taken[k], min(due_to, float(supply)))  # the lane gives what it has left
        yield lanes[k]["lane"], lanes[k]["available"], shares[k], targets[k], slot, counts[k], release, due, size, due_to, float(taken[k]), abs(shares[k] * (slot + 1) - counts[k])


def serve(gathered_stages: DataFrame, block: int = BLOCK, least: int = LEAST_BLOCKS) -> DataFrame:
    """Serves the lanes of every stage in Pfair order, a row a block.

    ``run_id, stage, lane, available, share, target, slot, block_no, release, deadline, size, due_to, served_to, lag``:
    after its block the lane should have given ``due_to`` tokens and has given ``served_to``, as its supply allows when
    repeated up to the stage's cap. ``lag`` is the distance from its due share in blocks, which stays below one.
    """
    ship(gathered_stages.sparkSession)

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(BLOCKS)], schema=BLOCKS)

        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                for x in scheduled(s["span"], s["cap"], s["lanes"], block, least):
                    rows.append((s["run_id"], s["stage"], *x))
                    if len(rows) == _BATCH:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return gathered_stages.mapInArrow(run, ", ".join(f"{f.name} {_KINDS[f.type]}" for f in BLOCKS))


def mix(stages: DataFrame, lanes: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each lane of each stage was served: sums over the blocks of ``serve``.

    ``run_id, stage, lane, target_share, target_tokens, available_tokens, used_tokens, repeat_factor, actual_share,
    blocks, missed_blocks, max_lag``. A block that the lane's supply, repeated up to the cap, doesn't reach is missed
    and its slot stays empty: shares are of what was served. A stage whose lanes have nothing has shares of 0. Empty
    tables give no rows; extra columns are ignored.
    """
    return summed(serve(supplies(stages, lanes), block))


def summed(served: DataFrame) -> DataFrame:
    rows = served.groupBy("run_id", "stage", "lane").agg(
        F.first("share").alias("target_share"), F.first("target").alias("target_tokens"), F.first("available").alias("available_tokens"), F.max("served_to").alias("used_tokens"),
        F.count("*").alias("blocks"), F.count_if(F.col("served_to") < F.col("due_to")).alias("missed_blocks"), F.max("lag").alias("max_lag"),
    )
    total = F.sum("used_tokens").over(Window.partitionBy("run_id", "stage"))  # a stage's lanes
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.withColumn("repeat_factor", per(F.col("used_tokens"), F.col("available_tokens"))).withColumn("actual_share", per(F.col("used_tokens"), total))


def scarce(stages: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lanes that miss blocks of a stage: ``run_id, stage, lane``."""
    return serve(supplies(stages, lanes)).filter("served_to < due_to").select("run_id", "stage", "lane").distinct()


def shares(stages: DataFrame, lanes: DataFrame) -> DataFrame:
    """Targets, repeat factors and actual shares of each stage's lanes."""
    return _shown(mix(stages, lanes))


def _shown(rows: DataFrame) -> DataFrame:
    columns = [F.round(c, 6).alias(c) for c in ("target_share", "used_tokens", "repeat_factor", "actual_share")]
    return rows.select("run_id", "stage", "lane", "available_tokens", F.round("target_tokens", 3).alias("target_tokens"), *columns)


def blocks(stages: DataFrame, lanes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The interleaved blocks of each stage: ``run_id, stage, slot, lane, block_no, release, deadline, tokens``.

    ``tokens`` is what the slot was served; a stage's sums over its slots are the tokens of ``mix``.
    """
    before = F.least((F.col("block_no") - 1) * F.col("size"), F.col("served_to"))
    return serve(supplies(stages, lanes), block).select("run_id", "stage", "slot", "lane", "block_no", "release", "deadline", (F.col("served_to") - before).alias("tokens"))


# --- documents behind the lanes ---------------------------------------------------------------------------------------------


def lane_lines(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, spelled, ds, de``: place of each document on the line of its lane; ``spelled, available``).

    Tokens are those of byte mode (UTF-8 bytes of the trimmed text and an end); documents without text or lane are on no
    line. A line's order is that of a hash of the ids, whose leading bits are the parts of the running sum.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    sized = documents.select("doc_id", slug(F.col("capability_lane"), "_").alias("spelled"), F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.octet_length(text) + 1).cast("bigint").alias("n"))
    sized = materialise(sized.filter("n > 0 and spelled is not null and doc_id is not null"), "sized").withColumn("h", F.xxhash64("doc_id"))
    placed = running(sized, ["spelled"], ["h", "doc_id"], F.col("n"), F.shiftright("h", 52), "ds")
    return placed.select("doc_id", "spelled", "ds", (F.col("ds") + F.col("n")).alias("de")), sized.groupBy("spelled").agg(F.sum("n").alias("available"))


def supplied(documents: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks served from the documents themselves, their lines, tokens of each lane)."""
    lines, totals = lane_lines(documents)
    return serve(gathered(mixtures(stages).join(F.broadcast(totals), "spelled", "left"))), lines, totals  # a row a lane


def repeats(documents: DataFrame, stages: DataFrame) -> DataFrame:
    """``shares`` of each stage's lanes with the documents' own tokens as supply, repeated up to the stage's cap."""
    return _shown(summed(supplied(documents, stages)[0]))


def placed(documents: DataFrame, stages: DataFrame, width: int = BLOCK) -> DataFrame:
    """Documents in the slots of each stage: ``run_id, stage, slot, lane, first_doc, first_epoch, last_doc, last_epoch, tokens``.

    A slot holds its lane's documents from the first to the last in the order of the lane's line (``lane_lines``), which
    starts again with each epoch; first and last may be held in part. Slots whose lane has nothing left are left out.
    Places are looked up once each, however many stages share them, by an equi-join on parts of ``width`` tokens.
    """
    served, lines, totals = supplied(documents, stages)
    start = (F.col("block_no") - 1) * F.col("size")
    slots = served.withColumn("start", start.cast("double")).filter("served_to > start").withColumn("spelled", slug(F.col("lane"), "_"))
    slots = slots.select("run_id", "stage", "slot", "lane", "spelled", "start", F.ceil("served_to").alias("end"), "available", (F.col("served_to") - F.col("start")).alias("tokens"))
    first, last = F.col("start").cast("bigint"), F.greatest(F.col("end") - 1, F.col("start").cast("bigint"))
    slots = materialise(slots.select("run_id", "stage", "slot", "lane", "spelled", "tokens", F.expr("cast(start as bigint) div available").alias("first_epoch"), (first % F.col("available")).alias("p"), F.floor(last / F.col("available")).alias("last_epoch"), (last % F.col("available")).alias("q")), "slots")
    wanted = slots.select("spelled", "p").union(slots.select("spelled", "q")).distinct().withColumn("bucket", F.expr(f"p div {width}"))
    cut = lines.withColumn("bucket", F.explode(F.sequence(F.expr(f"ds div {width}"), F.expr(f"(de - 1) div {width}"))))
    at = materialise(wanted.join(cut, ["spelled", "bucket"]).filter("ds <= p and p < de").select("spelled", "p", "doc_id"), "places")
    ends = slots.join(at.withColumnRenamed("doc_id", "first_doc"), ["spelled", "p"]).join(at.select("spelled", F.col("p").alias("q"), F.col("doc_id").alias("last_doc")), ["spelled", "q"])
    return ends.select("run_id", "stage", "slot", "lane", "first_doc", "first_epoch", "last_doc", "last_epoch", F.round("tokens", 6).alias("tokens"))


_LANES_SQL = """
with stage as (
  select distinct run_id, stage, token_end - token_start as span, max_repeat as cap, unnest(map_entries(mixture)) as e
  from mixture_stages where run_id is not null and stage is not null and token_end > token_start
), lane as (
  select run_id, stage, span, cap, e.key as lane, e.value as weight, sum(e.value) over (partition by run_id, stage) as total
  from stage where e.value > 0
), latest as (
  select run_id, stage, regexp_replace(trim(lower(lane)), '[\\s_-]+', '_', 'g') as lane, arg_max(available_tokens, recorded_at) as available
  from lane_plans group by all
), target as (
  select l.run_id, l.stage, l.lane, weight / total as share, weight / total * span as target, coalesce(available, 0) as available, coalesce(cap, 1) as cap
  from lane l left join latest a on l.run_id = a.run_id and l.stage = a.stage and l.lane = a.lane
)
"""
SCARCE_SQL = _LANES_SQL + "select run_id, stage, lane from target where available * cap < target"
SHARES_SQL = (
    _LANES_SQL
    + """, used as (select *, least(target, available * cap) as used from target)
select run_id, stage, lane, available as available_tokens, round(target, 3) as target_tokens, round(share, 6) as target_share,
  round(used, 6) as used_tokens, round(case when available > 0 then used / available else 0 end, 6) as repeat_factor,
  round(case when sum(used) over (partition by run_id, stage) > 0 then used / sum(used) over (partition by run_id, stage) else 0 end, 6) as actual_share
from used"""
)
REPEATS_SQL = r"""
with stage as (
  select distinct run_id, stage, token_end - token_start as span, coalesce(max_repeat, 1) as cap, unnest(map_entries(mixture)) as e
  from mixture_stages where run_id is not null and stage is not null and token_end > token_start
), trimmed as (select capability_lane, coalesce(regexp_replace(text, '^[\s\p{Z}\x{85}\x0b]+|[\s\p{Z}\x{85}\x0b]+$', '', 'g'), '') as text from documents),
have as (select regexp_replace(trim(lower(capability_lane)), '[\s_-]+', '_', 'g') as lane, sum(strlen(text) + 1)::bigint as available from trimmed where text <> '' group by 1),
target as (
  select run_id, stage, e.key as lane, e.value / sum(e.value) over (partition by run_id, stage) as share, share * span as target, coalesce(available, 0) as available, cap
  from stage left join have on have.lane = e.key where e.value > 0
), used as (select *, least(target, available * cap) as used from target)
select run_id, stage, lane, available as available_tokens, round(target, 3) as target_tokens, round(share, 6) as target_share,
  round(used, 6) as used_tokens, round(case when available > 0 then used / available else 0 end, 6) as repeat_factor,
  round(case when sum(used) over (partition by run_id, stage) > 0 then used / sum(used) over (partition by run_id, stage) else 0 end, 6) as actual_share
from used
"""
