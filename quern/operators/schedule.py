"""Curriculum schedules: supply and scarcity of lanes, steps, mixtures at a step, and lanes of batch slots."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import ship

#: Batch slots of a step.
BATCH = 8

_STATE = "array<struct<ord:int,eff:double,status:string,cum:double>>"
_OK = "acc.prior + x.target <= x.available + 1e-9"
_EFFECTIVE = f"""case when {_OK} then x.target
  when x.policy = 'repeat' then if(x.available > 0, x.target, 0D)
  when x.policy = 'reduce_share' then greatest(greatest(0D, x.available - acc.prior), x.floor)
  else 0D end"""
_STATUS = f"""case when {_OK} then 'ok'
  when x.policy = 'repeat' then if(x.available > 0, 'scarce_repeat', 'impossible')
  when x.policy = 'reduce_share' then case when x.floor > 1e-9 and x.available <= 0 then 'impossible'
    when greatest(greatest(0D, x.available - acc.prior), x.floor) >= x.target - 1e-6 then 'ok' else 'scarce_reduced' end
  else 'deferred' end"""


class ScarcityError(ValueError):
    """A lane must be served and has no tokens at all."""


def compile_lanes(lanes: DataFrame) -> DataFrame:
    """Effective tokens of each lane in each stage of a run.

    ``lanes``: ``run_id, stage, ord, lane, weight, floor_weight, span, policy, available``. What a lane used in
    earlier stages is taken from its supply, clamped by the stage's policy, so the stages of a lane are folded in
    order (an array of a run's stages a lane). ``status`` is ``impossible`` where a share can't be had at all.
    """
    entry = F.struct(
        F.col("ord").cast("int").alias("ord"),
        (F.col("weight") * F.col("span")).alias("target"),
        (F.coalesce("floor_weight", F.lit(0.0)) * F.col("span")).alias("floor"),
        F.col("available").cast("double").alias("available"),
        "policy",
        "stage",
        "weight",
        F.col("span").cast("double").alias("span"),
    )
    folded = lanes.groupBy("run_id", "lane").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    step = f"""aggregate(rows, named_struct('prior', 0D, 'out', cast(array() as {_STATE})),
      (acc, x) -> named_struct('prior', acc.prior + {_EFFECTIVE}, 'out', concat(acc.out, array(named_struct('ord', x.ord, 'eff', {_EFFECTIVE}, 'status', {_STATUS}, 'cum', acc.prior + {_EFFECTIVE})))),
      acc -> acc.out)"""
    out = folded.select("run_id", "lane", F.inline(F.arrays_zip("rows", F.expr(step).alias("out"))))
    return out.select(
        "run_id",
        "lane",
        F.col("rows.ord").alias("ord"),
        F.col("rows.stage").alias("stage"),
        F.col("rows.weight").alias("target_weight"),
        (F.col("out.eff") / F.col("rows.span")).alias("effective_weight"),
        F.col("rows.target").alias("target_tokens"),
        F.col("out.eff").alias("effective_tokens"),
        F.col("rows.available").alias("available_tokens"),
        F.col("out.cum").alias("cumulative_tokens_after"),
        F.col("out.status").alias("status"),
        F.try_divide("out.cum", "rows.available").alias("repeat_factor"),
    )


def require_supply(compiled: DataFrame) -> None:
    """Raises ScarcityError if a lane of a schedule (of configuration size) is impossible."""
    bad = compiled.filter("status = 'impossible'").select("run_id", "stage", "lane").head(1)
    if bad:
        raise ScarcityError(f"run {bad[0].run_id}, stage {bad[0].stage}: lane {bad[0].lane} has no tokens")


def positive(weights: DataFrame) -> DataFrame:
    """Rows of positive ``weight``; raises if there is none."""
    rows = weights.filter("weight > 0")
    if not rows.head(1):
        raise ValueError("no lane has a positive weight")
    return rows


def steps(stages: DataFrame, batch: int = BATCH) -> DataFrame:
    """``step_start, step_end`` of each stage: spans are whole steps of ``sequence_length * batch`` tokens."""
    length = F.floor((F.col("token_end") - F.col("token_start")) / (F.col("sequence_length") * batch)).cast("bigint")
    order = Window.partitionBy("run_id").orderBy("token_start", "stage")
    ended = F.sum("_steps").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stages.withColumn("_steps", length).withColumn("ord", F.row_number().over(order)).withColumn("step_end", ended).withColumn("step_start", F.col("step_end") - F.col("_steps")).drop("_steps")


def stage_mixtures(stages: DataFrame, compiled: DataFrame) -> DataFrame:
    """Stages with their own and the previous stage's effective mixture, as maps."""
    mixture = compiled.groupBy("run_id", "ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", "effective_weight")))).alias("mixture_now"))
    order = Window.partitionBy("run_id").orderBy("ord")
    return stages.join(mixture, ["run_id", "ord"]).withColumn("mixture_before", F.lag("mixture_now").over(order))


def at_steps(mixed: DataFrame, batch: int = BATCH) -> DataFrame:
    """One row a step with its mixture: in the warm-up of a stage a linear ramp from the stage before."""
    warm = F.floor(F.col("warmup_tokens") / (F.col("sequence_length") * batch))
    # the stages are few and small, their steps many: stages are dealt out first, so the steps of no run are one task
    parallel = mixed.sparkSession.sparkContext.defaultParallelism
    blocks = F.explode(F.sequence("step_start", F.col("step_end") - 1, F.lit(256).cast("bigint"))).alias("first")
    dealt = mixed.filter("step_end > step_start").select("*", blocks).repartition(4 * parallel)
    rows = dealt.select("*", F.explode(F.sequence("first", F.least(F.col("first") + 255, F.col("step_end") - 1))).alias("step")).drop("first")
    ramps = F.col("mixture_before").isNotNull() & (F.col("warmup_tokens") > 0) & (warm > 0)
    progress = F.when(ramps, F.least(F.lit(1.0), (F.col("step") - F.col("step_start")) / warm)).otherwise(F.lit(1.0))
    lanes = F.array_sort(F.array_union(F.map_keys("mixture_now"), F.coalesce(F.map_keys("mixture_before"), F.array().cast("array<string>"))))
    weight = lambda name, lane: F.coalesce(F.try_element_at(F.col(name), lane), F.lit(0.0))
    return rows.withColumn("progress", progress).withColumn(
        "weights",
        F.when(F.col("progress") >= 1.0, F.transform(F.array_sort(F.map_entries("mixture_now")), lambda e: F.struct(e["key"].alias("lane"), e["value"].alias("weight")))).otherwise(
            F.transform(lanes, lambda lane: F.struct(lane.alias("lane"), ((1 - F.col("progress")) * weight("mixture_before", lane) + F.col("progress") * weight("mixture_now", lane)).alias("weight")))
        ),
    )


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only: the first eight bytes of their hash."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


_SLOTS = pa.schema([("run_id", pa.string()), ("stage", pa.string()), ("ord", pa.int32()), ("step", pa.int64()), ("sequence_length", pa.int32()), ("slot", pa.int32()), ("lane", pa.string())])
#: Steps that one row of a stage makes at once.
_STEPS = 256


@lru_cache(maxsize=2048)
def _draws(seed: str, block: int, batch: int) -> np.ndarray:
    """``uniform(seed, 'lane', step, slot)`` of the steps of a block, which all runs share."""
    keys = (f"{seed}:lane:{step}:{slot}" for step in range(block * _STEPS, (block + 1) * _STEPS) for slot in range(batch))
    return np.array([int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") / 2**64 for k in keys]).reshape(_STEPS, batch)


def slots(mixed: DataFrame, seed: str, batch: int = BATCH) -> DataFrame:
    """Lane of each (step, slot) of the stages of ``stage_mixtures``: ``run_id, stage, ord, step, sequence_length, slot, lane``.

    Weights change only in a warm-up, so a stage's running sums are made once for a block of steps, and a step needs
    nothing of the steps before it. The draw of a slot is that of ``uniform``; a slot takes the lane whose part of the
    sum of weights holds it, none where no lane has any.
    """
    ship(mixed.sparkSession)
    entries = lambda c: F.array_sort(F.map_entries(c))
    warm = F.floor(F.col("warmup_tokens") / (F.col("sequence_length") * batch)).cast("bigint")
    blocks = F.explode(F.sequence(F.expr(f"step_start div {_STEPS}"), F.expr(f"(step_end - 1) div {_STEPS}"))).alias("block")
    rows = mixed.filter("step_end > step_start").select("run_id", "stage", F.col("ord").cast("int"), "step_start", "step_end", "sequence_length", warm.alias("warm"), entries("mixture_now").alias("now"), entries("mixture_before").alias("before"), blocks)

    def run(batches):
        for rows_ in batches:
            for r in rows_.to_pylist():
                low, high = max(r["step_start"], r["block"] * _STEPS), min(r["step_end"], (r["block"] + 1) * _STEPS)
                steps_ = np.arange(low, high)
                now = {e["key"]: e["value"] for e in r["now"]}
                before = {e["key"]: e["value"] for e in r["before"] or ()}
                ramps = r["before"] is not None and (r["warm"] or 0) > 0
                progress = np.minimum(1.0, (steps_ - r["step_start"]) / r["warm"]) if ramps else np.ones(len(steps_))
                lanes = sorted(now.keys() | before.keys()) if ramps else sorted(now)
                a, b = (np.array([x.get(k) or 0.0 for k in lanes], "f8") for x in (now, before))
                weights = np.where(progress[:, None] >= 1, a, (1 - progress[:, None]) * b + progress[:, None] * a)
                sums = np.cumsum(np.maximum(weights, 0), axis=1) if lanes else np.zeros((len(steps_), 1))
                draw = _draws(seed, r["block"], batch)[low - r["block"] * _STEPS : high - r["block"] * _STEPS] * sums[:, -1:]
                inside = draw[:, :, None] < sums[:, None, :]
                last = (weights > 0).shape[1] - 1 - (weights > 0)[:, ::-1].argmax(axis=1) if lanes else np.zeros(len(steps_), "i8")
                at = np.where(inside.any(axis=2), inside.argmax(axis=2), last[:, None]).ravel()
                names = pa.array(lanes or [None], pa.string()).take(pa.array(at))
                if not lanes or not (sums[:, -1] > 0).all():
                    names = pa.array([x if ok else None for x, ok in zip(names.to_pylist(), np.repeat(sums[:, -1] > 0, batch))], pa.string())
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(r[c], _SLOTS.field(c).type), n) if c in ("run_id", "stage", "ord", "sequence_length") else pa.array(np.repeat(steps_, batch)) if c == "step" else pa.array(np.tile(np.arange(batch, dtype="i4"), len(steps_))) if c == "slot" else names for c in _SLOTS.names],
                    schema=_SLOTS,
                )

    parallel = mixed.sparkSession.sparkContext.defaultParallelism  # stages are few and their steps many, so they are dealt out
    return rows.repartition(4 * parallel).mapInArrow(run, "run_id string, stage string, ord int, step bigint, sequence_length int, slot int, lane string")
