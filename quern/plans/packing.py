"""Queries of packing, ledgers, replay and audit, over all documents with one curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import packing as P
from quern.operators import schedule as S
from quern.plans.catalog import query
from quern.plans.schedule import SEED
from quern.plans.shards import _BINS_SQL, shard_spans
from quern.runtime import materialise, table

#: The curriculum of these queries, as shares of the corpus' own tokens, all of which it serves once over:
#: (stage, start, end, sequence_length, mixture, floors, warm-up, policy).
LANES = ("code", "general_web", "indic", "instruction", "math_science")
CURRICULUM = (
    ("foundation", 0.0, 0.4, 256, (0.2, 0.5, 0.05, 0.1, 0.15), (0.0, 0.0, 0.02, 0.0, 0.0), 0.0, "repeat"),
    ("expansion", 0.4, 0.8, 512, (0.3, 0.25, 0.15, 0.1, 0.2), (0.0, 0.0, 0.05, 0.0, 0.0), 0.08, "reduce_share"),
    ("anneal", 0.8, 1.0, 512, (0.25, 0.15, 0.1, 0.3, 0.2), (0.0, 0.0, 0.0, 0.05, 0.0), 0.04, "repeat"),
)
#: Token positions of stages are multiples of this, whole steps of every sequence length.
ALIGN = 4096
WIDTH = 512
MICROBATCH = 4


def schedule(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, stages with their mixtures, slots) of the curriculum with the corpus' own supply."""
    spans = materialise(shard_spans(spark, folder), "spans")  # the frozen manifests: all that follows reads them
    supply = spans.groupBy("lane").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("available"))
    total = supply.agg(F.sum("available")).first()[0] or 0
    at = lambda share: int(total * share) // ALIGN * ALIGN
    rows = [("run", s[0], at(s[1]), at(s[2]), s[3], at(s[6]), s[7]) for s in CURRICULUM]
    stages = S.steps(spark.createDataFrame(rows, "run_id string, stage string, token_start bigint, token_end bigint, sequence_length int, warmup_tokens bigint, scarcity_policy string"))
    weights = [("run", s[0], lane, w, f) for s in CURRICULUM for lane, w, f in zip(LANES, s[4], s[5])]
    shares = spark.createDataFrame(weights, "run_id string, stage string, lane string, weight double, floor_weight double")
    lanes = shares.join(stages.select("run_id", "stage", "ord", (F.col("token_end") - F.col("token_start")).alias("span"), F.col("scarcity_policy").alias("policy")), ["run_id", "stage"]).join(supply, "lane", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    mixed = materialise(S.stage_mixtures(stages, S.compile_lanes(lanes)), "mixtures")
    return spans, mixed, materialise(S.slots(mixed, SEED), "slots")


def packed(spark, folder, seed: str = SEED, frozen: tuple | None = None, steps: tuple[int, int] | None = None) -> DataFrame:
    """Segments of every window of the curriculum, or of a range of steps: windows of other steps are never filled."""
    spans, _, slots = frozen or schedule(spark, folder)
    wins = P.windows(slots)
    if steps:
        wins = materialise(wins.filter((F.col("step") >= steps[0]) & (F.col("step") < steps[1])), "windows")
    return P.segments(wins, P.stream(spans, wins, seed), WIDTH)


_CUR_SQL = ", ".join(f"('{s[0]}', {s[1]}::double, {s[2]}::double, {s[3]}, {s[6]}::double, '{s[7]}', {k + 1})" for k, s in enumerate(CURRICULUM))
_MIX_SQL = ", ".join(f"('{s[0]}', '{lane}', {w}::double, {f}::double)" for s in CURRICULUM for lane, w, f in zip(LANES, s[4], s[5]))
_B = S.BATCH
_PACK_SQL = (
    _BINS_SQL
    + f""", tot as (select coalesce(sum(end_token - start_token), 0)::bigint as t from s), c1(stage, a, b, len, w, policy, ord) as (values {_CUR_SQL}),
c0 as (select stage, floor(t * a)::bigint // {ALIGN} * {ALIGN} as token_start, floor(t * b)::bigint // {ALIGN} * {ALIGN} as token_end, len, floor(t * w)::bigint // {ALIGN} * {ALIGN} as warmup, policy, ord from c1, tot), m0(stage, lane, weight, fl) as (values {_MIX_SQL}),
c as (select *, (sum(k) over (order by ord) - k)::bigint as step_start, sum(k) over (order by ord)::bigint as step_end from (select *, (token_end - token_start) // (len * {_B}) as k from c0)),
sup as (select lane, sum(end_token - start_token)::double as available from s group by 1),
l as (select c.stage, c.ord, m0.lane, weight, weight * (token_end - token_start) as target, fl * (token_end - token_start) as floor, policy, (token_end - token_start) as span, coalesce(available, 0) as available from c join m0 using (stage) left join sup using (lane)),
fold as (select *, case when target <= available + 1e-9 then target when policy = 'repeat' then case when available > 0 then target else 0 end when policy = 'reduce_share' then greatest(greatest(0, available), floor) else 0 end as eff, 0::double as prior from l where ord = 1
  union all select l.*, case when p.prior + p.eff + l.target <= l.available + 1e-9 then l.target when l.policy = 'repeat' then case when l.available > 0 then l.target else 0 end when l.policy = 'reduce_share' then greatest(greatest(0, l.available - p.prior - p.eff), l.floor) else 0 end, p.prior + p.eff from fold p join l on l.lane = p.lane and l.ord = p.ord + 1),
st as (select stage, ord, len, step, case when ord > 1 and warmup > 0 and warmup // (len * {_B}) > 0 then least(1.0::double, (step - step_start) / (warmup // (len * {_B}))::double) else 1.0::double end as progress from (select *, unnest(range(step_start, step_end)) as step from c)),
wt as (select st.stage, st.ord, st.len, st.step, f.lane, case when progress >= 1 then f.eff / f.span else (1 - progress) * coalesce(g.eff / g.span, 0) + progress * f.eff / f.span end as weight from st join fold f on f.ord = st.ord left join fold g on g.ord = st.ord - 1 and g.lane = f.lane),
cum as (select *, sum(weight) over (partition by step order by lane) as upto, sum(weight) over (partition by step) as total from wt where weight > 0),
slots as (select c.stage, c.step, r.slot, c.len, coalesce(min(case when (('0x' || substring(sha256('{SEED}:lane:' || c.step || ':' || r.slot), 1, 16))::ubigint)::double / 18446744073709551616.0 * total < upto then lane end), max(lane)) as lane from cum c, range({_B}) r(slot) group by all),
win as (select *, (sum(len) over (partition by lane order by step, slot) - len)::bigint as ws, sum(len) over (partition by lane order by step, slot)::bigint as we from slots),
need as (select win.lane, ceil(max(we) / any_value(available))::bigint as epochs, any_value(available)::bigint as lane_tokens from win join sup on sup.lane = win.lane group by 1),
doc0 as (select s.*, lane_tokens, unnest(range(epochs)) as epoch from s join need using (lane)),
doc as (select *, (epoch * lane_tokens + sum(end_token - start_token) over (partition by lane, epoch order by sha256('{SEED}:lane_sequence:' || lane || ':' || epoch || ':' || shard_id || ':' || document_id)))::bigint as de from doc0),
seg as (select step, slot, w.lane, len, w.stage, shard_id, document_id, greatest(ws, de - (end_token - start_token)) - ws as w_start, least(we, de) - ws as w_end, start_token + greatest(ws, de - (end_token - start_token)) - (de - (end_token - start_token)) as s_start, start_token + least(we, de) - (de - (end_token - start_token)) as s_end, start_token + response as resp
  from win w join doc d on d.lane = w.lane and de - (end_token - start_token) < we and de > ws),
seg1 as (select *, case when resp > s_start then least(resp, s_end) - s_start else 0 end as prompt from seg),
seg2 as (select *, w_end - w_start - prompt - case when w_end = len and w_start + prompt < len then 1 else 0 end as useful, row_number() over (partition by step, slot order by w_start) - 1 as seg_no from seg1)"""
)


@query("win_11_slots", _PACK_SQL + " select step, slot, lane from slots")
def slots(spark, folder):
    return schedule(spark, folder)[2].select("step", "slot", "lane")


@query("win_8_epoch_order", _PACK_SQL + " select lane, epoch, document_id, (de - (end_token - start_token))::bigint as ds, de from doc")
def epoch_order(spark, folder):
    spans, _, slot_rows = schedule(spark, folder)
    return P.stream(spans, P.windows(slot_rows), SEED).select("lane", "epoch", "document_id", "ds", "de")


@query("jon_7_segments", _PACK_SQL + " select step, slot, lane, shard_id, document_id, w_start, w_end, s_start, s_end from seg2")
def segments(spark, folder):
    return packed(spark, folder).drop("stage", "sequence_length", "response_start_token")


@query("win_12_segment_ids", _PACK_SQL + " select step, slot, w_start, seg_no::int as segment from seg2")
def segment_ids(spark, folder):
    order = Window.partitionBy("step", "slot").orderBy("w_start")
    return packed(spark, folder).select("step", "slot", "w_start", (F.row_number().over(order) - 1).alias("segment"))


@query(
    "pck_2_windows",
    _PACK_SQL
    + """, wn as (select step, slot, lane, count(*) as segments, string_agg(repeat(seg_no::varchar || ',', (w_end - w_start)::int), '' order by w_start) as ids, string_agg(repeat('0', prompt::int) || repeat('1', (w_end - w_start - prompt)::int), '' order by w_start) as mask from seg2 group by all)
select step, slot, lane, segments, sha256(ids) as segment_hash, sha256(substring(mask, 1, length(mask) - 1) || '0') as mask_hash from wn""",
)
def windows(spark, folder):
    rows = P.samples(packed(spark, folder))
    ids = F.concat(F.array_join("segment_id", ","), F.lit(","))
    return rows.select("step", "slot", "lane", F.size("segments").cast("bigint").alias("segments"), F.sha2(ids, 256).alias("segment_hash"), F.sha2(F.array_join("loss_mask", ""), 256).alias("mask_hash"))


@query(
    "win_13_positions",
    _PACK_SQL + " select step, slot, sum((w_end - w_start) * (w_end - w_start - 1) // 2)::bigint as position_sum, max(w_end - w_start - 1)::int as last_position from seg2 group by all",
)
def positions(spark, folder):
    rows = P.samples(packed(spark, folder))
    return rows.select("step", "slot", F.aggregate("position_id", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position_sum"), F.array_max("position_id").alias("last_position"))


@query("pck_3_useful_by_window", _PACK_SQL + " select step, slot, lane, sum(useful)::bigint as useful, sum(prompt)::bigint as prompt from seg2 group by all")
def useful_by_window(spark, folder):
    rows = packed(spark, folder)
    return rows.groupBy("step", "slot", "lane").agg(F.sum(P.useful_tokens()).alias("useful"), F.sum(P.prompt_tokens()).alias("prompt"))


@query("arr_8_mask_hashes")
def mask_hashes(spark, folder):
    return P.samples(packed(spark, folder)).select("step", "slot", P.mask_hash(F.col("loss_mask")).alias("loss_mask_hash"))


@query("win_14_microbatches", _PACK_SQL + f" select step, slot // {MICROBATCH} as microbatch, slot % {MICROBATCH} as place, lane from slots")
def microbatches(spark, folder):
    rows = schedule(spark, folder)[2]
    return rows.select("step", F.expr(f"slot div {MICROBATCH}").alias("microbatch"), (F.col("slot") % MICROBATCH).alias("place"), "lane")


# --- ledger, replay, audit ---------------------------------------------------------------------------------------------------

# 1.0 and 0.0 as float32 in the order of bytes of a ledger.
ONE, ZERO = "0000803f", "00000000"
VERSION = "1"

_LEDGER_SQL = (
    _PACK_SQL
    + f""", sample as (select step, slot, lane, stage, len, string_agg(shard_id || ':' || s_start || '-' || s_end, ',' order by w_start) as spans, list(shard_id order by w_start) as shards, count(*) as segments, sum(w_end - w_start)::bigint as served, sum(useful)::bigint as useful,
  string_agg(repeat('{ZERO}', prompt::int) || repeat('{ONE}', (w_end - w_start - prompt)::int), '' order by w_start) as mask0 from seg2 group by all),
ledger as (select 'run' as run_id, 'main' as branch_id, step, slot // {MICROBATCH} as mb, 0 as rank, stage, 'mb-' || step || '-' || (slot // {MICROBATCH}) as batch_id, string_agg('ps-' || step || '-' || slot, ',' order by slot) as sample_ids, string_agg(lane, ',' order by slot) as lanes,
  array_to_string(list_sort(list_distinct(flatten(list(shards)))), ',') as shard_ids, string_agg(spans, ';' order by slot) as spans, 'sha256:' || sha256(unhex(string_agg(substring(mask0, 1, length(mask0) - 8) || '{ZERO}', '' order by slot))) as loss_mask_hash,
  'causal+segment' as attention_policy, 'reset_per_segment' as position_policy, 'bytes' as tokenizer_version, '{VERSION}' as dataloader_version, null::varchar as decision_id, sum(segments)::bigint as segments, sum(served)::bigint as served from sample group by step, slot // {MICROBATCH}, stage)"""
)


def sample_rows(spark, folder, seed: str = SEED, frozen: tuple | None = None, steps: tuple[int, int] | None = None) -> DataFrame:
    """A row a window, with what it holds and the hash of its loss mask."""
    rows = packed(spark, folder, seed, frozen, steps)
    span = F.concat("shard_id", F.lit(":"), "s_start", F.lit("-"), "s_end")
    return rows.groupBy("step", "slot", "stage", "lane", "sequence_length").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_start", span.alias("span")))), lambda x: x["span"]), ",").alias("spans"),
        F.array_sort(F.collect_set("shard_id")).alias("shards"),
        F.count("*").alias("segments"),
        F.sum(F.col("w_end") - F.col("w_start")).alias("served"),
        F.sum(P.useful_tokens()).alias("useful"),
        mask_bytes(),
    )


def mask_bytes() -> Column:
    """``mask``: a window's loss mask as the hexadecimal digits of its float32 numbers."""
    part = F.concat(F.repeat(F.lit(ZERO), P.prompt_tokens().cast("int")), F.repeat(F.lit(ONE), (F.col("w_end") - F.col("w_start") - P.prompt_tokens()).cast("int")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_start", part.alias("mask")))), lambda x: x["mask"]), "")
    return F.concat(F.left(whole, F.length(whole) - 8), F.lit(ZERO)).alias("mask")  # the last position has no target


def ledger(samples: DataFrame, run: str = "run", branch: str = "main", decision: str | None = None) -> DataFrame:
    """A ledger entry a microbatch, a pure function of its samples: all the fields of an entry, and its sums."""
    place = F.expr(f"slot div {MICROBATCH}")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("slot", c))), lambda x: x[c])
    ids = F.format_string("ps-%d-%d", "step", "slot")
    rows = samples.withColumn("id", ids).groupBy("step", place.alias("mb"), "stage").agg(
        F.array_join(ordered("id"), ",").alias("sample_ids"),
        F.array_join(ordered("lane"), ",").alias("lanes"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards")))), ",").alias("shard_ids"),
        F.array_join(ordered("spans"), ";").alias("spans"),
        F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(ordered("mask"), "")), 256)).alias("loss_mask_hash"),
        F.sum("segments").alias("segments"),
        F.sum("served").alias("served"),
    )
    fixed = {"run_id": run, "branch_id": branch, "rank": 0, "attention_policy": "causal+segment", "position_policy": "reset_per_segment", "tokenizer_version": "bytes", "dataloader_version": VERSION}
    rows = rows.withColumns({c: F.lit(v) for c, v in fixed.items()}).withColumn("decision_id", F.lit(decision).cast("string"))
    return rows.withColumn("batch_id", F.format_string("mb-%d-%d", "step", "mb")).select(*ENTRY, "segments", "served")


#: Fields of an entry.
ENTRY = ("run_id", "branch_id", "step", "mb", "batch_id", "rank", "stage", "sample_ids", "lanes", "shard_ids", "spans", "loss_mask_hash", "attention_policy", "position_policy", "tokenizer_version", "dataloader_version", "decision_id")
#: Fields that a replay compares.
COMPARED = ("sample_ids", "spans", "loss_mask_hash")


@query("led_1_entries", _LEDGER_SQL + f" select {', '.join(ENTRY)}, segments, served from ledger")
def entries(spark, folder):
    return ledger(sample_rows(spark, folder))


def compared(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """Recorded entries against recomputed ones, by ``COMPARED``; an entry that can't be recomputed matches in nothing."""
    other = again.select("step", "mb", *[F.col(c).alias(f"{c}_2") for c in COMPARED])
    return recorded.join(other, ["step", "mb"], "left").select("step", "mb", *[F.col(c).eqNullSafe(F.col(f"{c}_2")).alias(f"{c}_match") for c in COMPARED])


def stored_ledger(spark, folder, frozen: tuple) -> DataFrame:
    """The ledger of the curriculum as it was written to storage."""
    return materialise(ledger(sample_rows(spark, folder, frozen=frozen)), "ledger")


@query("rpl_1_replay", _LEDGER_SQL + f" select step, mb, {', '.join(f'{c} is not null as {c}_match' for c in COMPARED)} from ledger where step >= 10 and step < 60")
def replay(spark, folder, start: int = 10, end: int = 60):
    """Entries of a range of steps in the stored ledger against entries recomputed for these steps from frozen manifests."""
    frozen = schedule(spark, folder)
    recorded = stored_ledger(spark, folder, frozen).filter((F.col("step") >= start) & (F.col("step") < end))
    return compared(recorded, ledger(sample_rows(spark, folder, frozen=frozen, steps=(start, end))))


@query("rpl_2_one_step", _LEDGER_SQL + " select mb, lanes, spans from ledger where step = 40")
def one_step(spark, folder):
    return ledger(sample_rows(spark, folder, steps=(40, 41))).select("mb", "lanes", "spans")


@query("rpl_3_resume", _LEDGER_SQL + " select max(step) + 1 as next_step, count_if(step = (select max(step) from ledger)) = any_value(n) as verified from ledger, (select count(*) as n from ledger where step = (select max(step) from ledger) and spans is not null and loss_mask_hash is not null) group by n")
def resume(spark, folder):
    """A resume is right if the last stored step can be recomputed entry by entry."""
    frozen = schedule(spark, folder)
    recorded = stored_ledger(spark, folder, frozen)
    last = recorded.agg(F.max("step")).first()[0]
    if last is None:
        return spark.createDataFrame([], "next_step bigint, verified boolean")
    rows = compared(recorded.filter(F.col("step") == last), ledger(sample_rows(spark, folder, frozen=frozen, steps=(last, last + 1))))
    same = F.bool_and(F.col("sample_ids_match") & F.col("spans_match") & F.col("loss_mask_hash_match"))
    return rows.agg((F.max("step") + 1).alias("next_step"), same.alias("verified"))


@query("jon_12_fork_divergence")
def fork_divergence(spark, folder):
    """Entries of a fork with another seed that differ from the parent's at equal steps."""
    frozen = schedule(spark, folder)
    parent = ledger(sample_rows(spark, folder, frozen=frozen)).select("step", "mb", "spans")
    fork = ledger(sample_rows(spark, folder, "fork-seed", frozen)).select("step", "mb", F.col("spans").alias("fork_spans"))
    return parent.join(fork, ["step", "mb"]).filter("spans <> fork_spans").groupBy("step").agg(F.count("*").alias("changed"))


@query(
    "agg_9_audit",
    _LEDGER_SQL
    + """ select stage, count(*) as samples, sum(len)::bigint as capacity, sum(served)::bigint as served, round(sum(served) / sum(len)::double, 6) as utilization, round(sum(segments) / count(*)::double, 6) as avg_segments,
  sum(greatest(served - 1, 0))::bigint as estimated_useful, array_to_string(list_sort(list(distinct lane)), ',') as lanes from sample group by 1""",
)
def audit(spark, folder):
    return sample_rows(spark, folder).groupBy("stage").agg(
        F.count("*").alias("samples"),
        F.sum("sequence_length").alias("capacity"),
        F.sum("served").alias("served"),
        F.round(F.sum("served") / F.sum("sequence_length"), 6).alias("utilization"),
        F.round(F.sum("segments") / F.count("*"), 6).alias("avg_segments"),
        F.sum(F.greatest(F.col("served") - 1, F.lit(0))).alias("estimated_useful"),
        F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"),
    )


@query("agg_10_audit_range", _LEDGER_SQL + " select count(*) as samples, sum(served)::bigint as served, count(distinct step) as steps from sample where step >= 20 and step < 80")
def audit_range(spark, folder):
    rows = sample_rows(spark, folder, steps=(20, 80))
    return rows.agg(F.count("*").alias("samples"), F.sum("served").alias("served"), F.count_distinct("step").alias("steps"))


@query("agg_12_exact_useful", _PACK_SQL + " select lane, shard_id, sum(useful)::bigint as useful from seg2 group by grouping sets ((lane), (shard_id), ())")
def exact_useful(spark, folder):
    return packed(spark, folder).withColumn("useful", P.useful_tokens()).groupingSets([["lane"], ["shard_id"], []], "lane", "shard_id").agg(F.sum("useful").alias("useful"))


@query(
    "agg_13_compliance",
    _PACK_SQL
    + """, planned as (select lane, sum(weight) / (select count(distinct step) from wt) as planned from (select step, lane, weight / sum(weight) over (partition by step) as weight from wt) group by 1), actual as (select lane, count(*) / (select count(*) from slots)::double as actual from slots group by 1)
select coalesce(p.lane, a.lane) as lane, round(coalesce(planned, 0), 6) as planned, round(coalesce(actual, 0), 6) as actual, round(coalesce(actual, 0) - coalesce(planned, 0), 6) as delta from planned p full outer join actual a on a.lane = p.lane""",
)
def compliance(spark, folder):
    _, mixed, slot_rows = schedule(spark, folder)
    steps = S.at_steps(mixed)
    weights = steps.select("step", F.inline("weights"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("step"))
    count = steps.agg(F.count_distinct("step").alias("steps"))  # one row
    planned = weights.withColumn("share", share).groupBy("lane").agg(F.sum("share").alias("sum")).join(F.broadcast(count), how="cross").select("lane", (F.col("sum") / F.col("steps")).alias("planned"))
    total = slot_rows.agg(F.count("*").alias("total"))  # one row
    actual = slot_rows.groupBy("lane").agg(F.count("*").alias("n")).join(F.broadcast(total), how="cross").select("lane", (F.col("n") / F.col("total")).alias("actual"))
    p, a = F.coalesce("planned", F.lit(0.0)), F.coalesce("actual", F.lit(0.0))
    return planned.join(actual, "lane", "full_outer").select("lane", F.round(p, 6).alias("planned"), F.round(a, 6).alias("actual"), F.round(a - p, 6).alias("delta"))


@query("agg_17_last_microbatch", _LEDGER_SQL + " select step, mb from ledger order by step desc, mb desc limit 1")
def last_microbatch(spark, folder):
    return ledger(sample_rows(spark, folder)).agg(F.max(F.struct("step", "mb")).alias("m")).select("m.*")


@query("sup_11_step_log", _LEDGER_SQL + " select step, stage, array_to_string(list_sort(list(distinct lane)), ',') as lanes from sample group by all")
def step_log(spark, folder):
    return sample_rows(spark, folder).groupBy("step", "stage").agg(F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"))


@query("set_5_shards_of_samples", _PACK_SQL + " select step, slot, array_to_string(list(shard_id order by first), ',') as shards from (select step, slot, shard_id, min(w_start) as first from seg2 group by all) group by all")
def shards_of_samples(spark, folder):
    rows = packed(spark, folder).groupBy("step", "slot").agg(F.array_sort(F.collect_list(F.struct("w_start", "shard_id"))).alias("s"))
    return rows.select("step", "slot", F.array_join(F.array_distinct(F.col("s.shard_id")), ",").alias("shards"))


@query("jon_21_attention_pairs", _PACK_SQL + " select step, slot, sum((w_end - w_start) * (w_end - w_start + 1) // 2)::bigint as pairs from seg2 group by all")
def attention_pairs(spark, folder):
    """Pairs of positions that may see each other (same segment, not ahead), counted without making them."""
    return packed(spark, folder).groupBy("step", "slot").agg(F.sum(F.expr("(w_end - w_start) * (w_end - w_start + 1) div 2")).alias("pairs"))


@query("pck_4_best_fit")
def best_fit(spark, folder):
    """Segments of the curriculum's windows when documents are chosen by how well they fit."""
    spans, _, slot_rows = schedule(spark, folder)
    return P.best_fit_segments(P.windows(slot_rows), spans, SEED).drop("stage", "sequence_length", "response_start_token")


ROOMS = (16, 64, 256, 1024, 4096)


@query("srt_6_best_choice", _BINS_SQL + f", r(room) as (values {', '.join(f'({x})' for x in ROOMS)}) select lane, room, coalesce(arg_max(document_id, (n, -doc_id)) filter (n <= room), arg_min(document_id, (n, doc_id))) as document_id from (select lane, document_id, doc_id, (end_token - start_token)::bigint as n from s), r group by all")
def best_choice(spark, folder):
    """Of each lane's documents the longest that fits a room, else the shortest; the earliest of one length."""
    docs = shard_spans(spark, folder).select("lane", "document_id", "doc_id", (F.col("end_token") - F.col("start_token")).alias("n"))
    rooms = [F.struct(F.lit(x).alias("room"), F.max_by("document_id", F.when(F.col("n") <= x, F.struct("n", -F.col("doc_id")))).alias("fits")) for x in ROOMS]
    rows = docs.groupBy("lane").agg(F.array(*rooms).alias("rooms"), F.min_by("document_id", F.struct("n", "doc_id")).alias("least"))
    return rows.select("lane", F.explode("rooms").alias("r"), "least").select("lane", "r.room", F.coalesce("r.fits", "least").alias("document_id"))
