"""Queries of curriculum schedules over all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import schedule as S
from quern.plans.catalog import query
from quern.runtime import table

SEED = "seed-17"


def stage_table(stages: DataFrame) -> DataFrame:
    """Stages, repeated rows once, with steps in order."""
    keep = ["token_start", "token_end", "sequence_length", "warmup_tokens", "scarcity_policy", "max_repeat"]
    entries = [F.array_sort(F.map_entries(c)).alias(c) for c in ("mixture", "protected_floors")]
    one = stages.filter("run_id is not null and stage is not null and mixture is not null").groupBy("run_id", "stage").agg(F.max(F.struct(*keep, *entries)).alias("s"))
    return S.steps(one.select("run_id", "stage", "s.*"))


def supply(lanes: DataFrame) -> DataFrame:
    """The largest supply recorded for each lane of a run."""
    spelled = F.regexp_replace(F.lower(F.trim("lane")), r"[\s_\-]+", "_")
    return lanes.groupBy("run_id", spelled.alias("lane")).agg(F.max("available_tokens").alias("available"))


def lane_rows(stages: DataFrame, supplies: DataFrame) -> DataFrame:
    total = F.aggregate("mixture", F.lit(0.0), lambda a, e: a + e["value"])
    rows = stages.withColumn("total", total).select("run_id", "stage", "ord", (F.col("token_end") - F.col("token_start")).alias("span"), F.col("scarcity_policy").alias("policy"), "total", F.map_from_entries(F.coalesce("protected_floors", F.array().cast("array<struct<key:string,value:double>>"))).alias("floors"), F.explode("mixture").alias("e"))
    named = rows.select("run_id", "stage", "ord", "span", "policy", F.col("e.key").alias("lane"), (F.col("e.value") / F.col("total")).alias("weight"), F.try_element_at("floors", F.col("e.key")).alias("floor_weight"))
    return named.join(supplies, ["run_id", "lane"], "left").withColumn("available", F.coalesce("available", F.lit(0)))


_STAGE_SQL = f"""stage0 as (select distinct run_id, stage, token_start, token_end, sequence_length, warmup_tokens, scarcity_policy, mixture, protected_floors from mixture_stages where run_id is not null and stage is not null and mixture is not null),
stage1 as (select *, row_number() over (partition by run_id order by token_start, stage) as ord, (token_end - token_start) // (sequence_length * {S.BATCH}) as steps, list_sum(map_values(mixture)) as total from stage0),
stage as (select *, sum(steps) over (partition by run_id order by ord)::bigint as step_end, (sum(steps) over (partition by run_id order by ord) - steps)::bigint as step_start from stage1)"""
_LANES_SQL = """supply as (select run_id, regexp_replace(trim(lower(lane)), '[\\s_-]+', '_', 'g') as lane, max(available_tokens) as available from lane_plans group by all),
lanes0 as (select run_id, stage, ord, token_end - token_start as span, scarcity_policy as policy, unnest(map_keys(mixture)) as lane, mixture, protected_floors, total from stage),
lanes as (select l.run_id, l.stage, l.ord, l.span, l.policy, l.lane, mixture[l.lane] / total as weight, mixture[l.lane] / total * span as target, coalesce(protected_floors[l.lane], 0) * span as floor, coalesce(available, 0)::double as available,
  row_number() over (partition by l.run_id, l.lane order by ord) as k from lanes0 l left join supply s on s.run_id = l.run_id and s.lane = l.lane)"""
_EFF = "case when prior + target <= available + 1e-9 then target when policy = 'repeat' then case when available > 0 then target else 0 end when policy = 'reduce_share' then greatest(greatest(0, available - prior), floor) else 0 end"
_STAT = "case when prior + target <= available + 1e-9 then 'ok' when policy = 'repeat' then case when available > 0 then 'scarce_repeat' else 'impossible' end when policy = 'reduce_share' then case when floor > 1e-9 and available <= 0 then 'impossible' when greatest(greatest(0, available - prior), floor) >= target - 1e-6 then 'ok' else 'scarce_reduced' end else 'deferred' end"
_COMPILED_SQL = f"""with recursive {_STAGE_SQL}, {_LANES_SQL},
fold as (select *, {_EFF} as eff, {_STAT} as status from (select run_id, lane, k, target, floor, policy, available, 0::double as prior from lanes where k = 1)
  union all select *, {_EFF}, {_STAT} from (select l.run_id, l.lane, l.k, l.target, l.floor, l.policy, l.available, (f.prior + f.eff)::double as prior from fold f join lanes l on l.run_id = f.run_id and l.lane = f.lane and l.k = f.k + 1)),
compiled as (select l.run_id, l.stage, l.ord, l.lane, l.weight as target_weight, f.eff / l.span as effective_weight, l.target, f.eff, l.available, f.prior + f.eff as cum, f.status from lanes l join fold f on l.run_id = f.run_id and l.lane = f.lane and l.k = f.k)"""


def compiled(spark, folder) -> tuple[DataFrame, DataFrame]:
    stages = stage_table(table(spark, folder, "mixture_stages"))
    return stages, S.compile_lanes(lane_rows(stages, supply(table(spark, folder, "lane_plans"))))


@query(
    "mix_4_compiled",
    _COMPILED_SQL + " select run_id, stage, lane, status, round(target_weight, 6) as target_weight, round(effective_weight, 6) as effective_weight, round(target, 3) as target_tokens, round(eff, 3) as effective_tokens, round(cum, 3) as cumulative_tokens_after, case when available > 0 then round(cum / available, 6) end as repeat_factor from compiled",
)
def compile_all(spark, folder):
    _, lanes = compiled(spark, folder)
    rounded = {"target_weight": 6, "effective_weight": 6, "target_tokens": 3, "effective_tokens": 3, "cumulative_tokens_after": 3, "repeat_factor": 6}
    return lanes.select("run_id", "stage", "lane", "status", *[F.round(c, n).alias(c) for c, n in rounded.items()])


@query("mix_3_status_counts", _COMPILED_SQL + " select stage, lane, status, count(*) as n from compiled group by all")
def status_counts(spark, folder):
    return compiled(spark, folder)[1].groupBy("stage", "lane", "status").agg(F.count("*").alias("n"))


@query("win_4_steps", f"with {_STAGE_SQL} select run_id, stage, ord, step_start, step_end from stage")
def stage_steps(spark, folder):
    return stage_table(table(spark, folder, "mixture_stages")).select("run_id", "stage", F.col("ord").cast("bigint").alias("ord"), "step_start", "step_end")


@query("mix_1_contiguity", f"with {_STAGE_SQL} select run_id, stage, token_end <= token_start as empty, coalesce(token_start <> lag(token_end) over (partition by run_id order by ord), false) as gap from stage")
def contiguity(spark, folder):
    before = F.lag("token_end").over(Window.partitionBy("run_id").orderBy("ord"))
    rows = stage_table(table(spark, folder, "mixture_stages"))
    return rows.select("run_id", "stage", (F.col("token_end") <= F.col("token_start")).alias("empty"), F.coalesce(F.col("token_start") != before, F.lit(False)).alias("gap"))


@query("map_2_unallocated", _COMPILED_SQL + " select run_id, stage, round(sum(effective_weight), 6) as total, round(greatest(0, 1 - sum(effective_weight)), 6) as unallocated from compiled group by all")
def unallocated(spark, folder):
    total = F.sum("effective_weight")
    return compiled(spark, folder)[1].groupBy("run_id", "stage").agg(F.round(total, 6).alias("total"), F.round(F.greatest(F.lit(0.0), 1 - total), 6).alias("unallocated"))


@query("prj_16_stages_of_lane", _COMPILED_SQL + " select run_id, lane, array_to_string(list(stage order by ord), ',') as stages from compiled where effective_weight > 0 group by all")
def stages_of_lane(spark, folder):
    rows = compiled(spark, folder)[1].filter("effective_weight > 0").groupBy("run_id", "lane").agg(F.array_sort(F.collect_list(F.struct("ord", "stage"))).alias("s"))
    return rows.select("run_id", "lane", F.array_join(F.col("s.stage"), ",").alias("stages"))


@query("prj_12_positive_weights", "select distinct run_id, stage, k as lane, mixture[k] as weight from (select run_id, stage, mixture, unnest(map_keys(mixture)) as k from mixture_stages) where mixture[k] > 0")
def positive_weights(spark, folder):
    return S.positive(table(spark, folder, "mixture_stages").select("run_id", "stage", F.explode("mixture").alias("lane", "weight"))).distinct()


_STEP_SQL = (
    _COMPILED_SQL
    + f""", now as (select c.run_id, c.ord, c.lane, c.effective_weight as w from compiled c),
ramp as (select s.*, warmup_tokens // (sequence_length * {S.BATCH}) as warm, exists (select 1 from stage p where p.run_id = s.run_id and p.ord = s.ord - 1) as has_before from stage s),
step as (select run_id, stage, ord, sequence_length, step, case when has_before and warmup_tokens > 0 and warm > 0 then least(1::double, (step - step_start) / warm::double) else 1::double end as progress
  from (select *, unnest(range(step_start, step_end)) as step from ramp)),
own as (select step.run_id, stage, step.ord, sequence_length, step, lane, progress, w as w_now, 0::double as w_before from step join now on now.run_id = step.run_id and now.ord = step.ord),
before as (select step.run_id, stage, step.ord, sequence_length, step, lane, progress, 0::double as w_now, w as w_before from step join now on now.run_id = step.run_id and now.ord = step.ord - 1 where progress < 1.0),
weights as (select run_id, stage, ord, sequence_length, step, lane, case when max(progress) >= 1.0 then sum(w_now) else (1 - max(progress)) * sum(w_before) + max(progress) * sum(w_now) end as weight from (select * from own union all select * from before) group by all)"""
)


def step_table(spark, folder) -> DataFrame:
    stages, lanes = compiled(spark, folder)
    return S.at_steps(S.stage_mixtures(stages, lanes))


@query("mix_5_mixture_at_step", _STEP_SQL + " select run_id, stage, lane, count(*) as steps, round(sum(weight), 6) as weight_sum, round(min(weight), 6) as low, round(max(weight), 6) as high from weights group by all")
def mixture_at_step(spark, folder):
    rows = step_table(spark, folder).select("run_id", "stage", F.inline("weights"))
    return rows.groupBy("run_id", "stage", "lane").agg(F.count("*").alias("steps"), F.round(F.sum("weight"), 6).alias("weight_sum"), F.round(F.min("weight"), 6).alias("low"), F.round(F.max("weight"), 6).alias("high"))


@query("jon_9_mixture_change", _COMPILED_SQL + ", pair as (select c.run_id, c.ord, c.lane, c.effective_weight as w, 0::double as v from compiled c union all select run_id, ord + 1, lane, 0::double, effective_weight from compiled) select p.run_id, s.stage, lane, round(sum(w) - sum(v), 9) as change from pair p join stage s on s.run_id = p.run_id and s.ord = p.ord where p.ord > 1 group by all")
def mixture_change(spark, folder):
    stages, lanes = compiled(spark, folder)
    now = lanes.select("run_id", "ord", "lane", F.col("effective_weight").alias("w"))
    before = lanes.select("run_id", (F.col("ord") + 1).alias("ord"), "lane", F.col("effective_weight").alias("v"))
    both = now.join(before, ["run_id", "ord", "lane"], "full_outer").filter("ord > 1")
    return both.join(stages.select("run_id", "ord", "stage"), ["run_id", "ord"]).select("run_id", "stage", "lane", F.round(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)), 9).alias("change"))


_SLOT_SQL = (
    _STEP_SQL
    + f""", cum as (select *, sum(weight) over (partition by run_id, step order by lane) as upto, sum(weight) over (partition by run_id, step) as total from weights where weight > 0),
draw as (select run_id, step, slot, (('0x' || substring(sha256('{SEED}:lane:' || step || ':' || slot), 1, 16))::ubigint)::double / 18446744073709551616.0 as u from (select distinct run_id, step from weights), range({S.BATCH}) r(slot)),
slots as (select d.run_id, d.step, d.slot, coalesce(min(case when u * total < upto then lane end), max(lane)) as lane from draw d join cum c on c.run_id = d.run_id and c.step = d.step group by all)"""
)


@query("cur_1_lane_slots", _SLOT_SQL + " select run_id, lane, count(*) as slots, sum(step * 8 + slot)::bigint as checksum from slots group by all")
def lane_slots(spark, folder):
    rows = S.slots(S.stage_mixtures(*compiled(spark, folder)), SEED).filter("lane is not null")
    return rows.groupBy("run_id", "lane").agg(F.count("*").alias("slots"), F.sum(F.col("step") * 8 + F.col("slot")).alias("checksum"))


@query("mth_1_uniform", f"select doc_id, (('0x' || substring(sha256('{SEED}:' || doc_id || ':x'), 1, 16))::ubigint)::double / 18446744073709551616.0 as u from documents")
def uniform(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.uniform(F.lit(SEED), F.col("doc_id"), F.lit("x")).alias("u"))


@query("mth_2_derived_order", f"select doc_id, sha256('{SEED}:lane_sequence:' || doc_id) as digest from documents")
def derived_order(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.concat_ws(":", F.lit(SEED), F.lit("lane_sequence"), F.col("doc_id").cast("string")), 256).alias("digest"))


@query("jon_6_step_to_stage", f"with {_STAGE_SQL}, l as (select distinct run_id, global_step from learning_ledger) select l.run_id, l.global_step, stage from l join stage s on s.run_id = l.run_id and l.global_step >= step_start and l.global_step < step_end")
def step_to_stage(spark, folder):
    """Equi-join on the run, then the range: no nested loop, whatever the number of stages."""
    ledger = table(spark, folder, "learning_ledger").select("run_id", "global_step").distinct()
    stages = stage_table(table(spark, folder, "mixture_stages")).select("run_id", "stage", "step_start", "step_end")
    return ledger.join(stages, "run_id").filter("global_step >= step_start and global_step < step_end").select("run_id", "global_step", "stage")


@query("sup_10_step_at_fraction", f"with {_STAGE_SQL} select run_id, stage, greatest(step_start, least(step_start + floor((step_end - step_start) * 0.5)::bigint, step_end - 1)) as step from stage")
def step_at_fraction(spark, folder):
    at = F.col("step_start") + F.floor((F.col("step_end") - F.col("step_start")) * 0.5)
    return stage_table(table(spark, folder, "mixture_stages")).select("run_id", "stage", F.greatest("step_start", F.least(at, F.col("step_end") - 1)).alias("step"))


@query("jsn_2_schedule", _COMPILED_SQL + " select run_id, stage, lane, round(effective_weight, 6) as effective_weight from compiled")
def schedule_of_json(spark, folder):
    """Schedules written as JSON, one text a stage, and rebuilt from it."""
    entry = F.struct("lane", "effective_weight")
    texts = compiled(spark, folder)[1].groupBy("run_id", "stage").agg(F.to_json(F.collect_list(entry)).alias("plan"))
    return texts.select("run_id", "stage", F.inline(F.from_json("plan", "array<struct<lane: string, effective_weight: double>>"))).select("run_id", "stage", "lane", F.round("effective_weight", 6).alias("effective_weight"))


@query("sup_26_recompiled", _COMPILED_SQL + " select stage, lane, status, round(eff, 3) as effective_tokens from compiled where run_id = (select min(run_id) from compiled where run_id not in (select run_id from compiled where status = 'impossible'))")
def recompiled(spark, folder):
    """The schedule of one run compiled by itself; a lane that can't be had raises."""
    good = compiled(spark, folder)[1].groupBy("run_id").agg(F.max(F.col("status") == "impossible").alias("bad")).filter("not bad").agg(F.min("run_id")).first()[0]
    own = F.col("run_id") == good
    stages = stage_table(table(spark, folder, "mixture_stages").filter(own))
    lanes = S.compile_lanes(lane_rows(stages, supply(table(spark, folder, "lane_plans").filter(own))))
    S.require_supply(lanes)
    return lanes.select("stage", "lane", "status", F.round("effective_tokens", 3).alias("effective_tokens"))
