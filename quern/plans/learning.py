"""Queries of selection, learning ledgers, branch lineage, evidence and reports."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import checkpoints as C
from quern.operators import packing as P
from quern.operators import schedule as S
from quern.plans.catalog import query
from quern.plans.packing import _PACK_SQL, packed, sample_rows, schedule
from quern.plans.schedule import _STAGE_SQL, stage_table
from quern.plans.shards import _CORPUS_SQL, hashed_corpus
from quern.runtime import materialise, shared_folder, ship, spread, table

REJECT_BELOW, DEFER_ABOVE = 4.0, 7.5
PROTECTED = ("indic",)
THRESHOLD = 1e-3


def usefulness(delta: Column) -> Column:
    return F.when(delta <= -THRESHOLD, "useful").when(delta >= THRESHOLD, "harmful").when(delta.isNotNull(), "neutral")


@query("prj_14_usefulness", "select distinct run_id, branch_id, global_step, shard_id, loss_delta_before_after, case when loss_delta_before_after <= -0.001 then 'useful' when loss_delta_before_after >= 0.001 then 'harmful' when loss_delta_before_after is not null then 'neutral' end as computed from learning_ledger")
def classify(spark, folder):
    return table(spark, folder, "learning_ledger").select("run_id", "branch_id", "global_step", "shard_id", "loss_delta_before_after", usefulness(F.col("loss_delta_before_after")).alias("computed")).distinct()


@query(
    "prj_15_phase",
    f"with {_STAGE_SQL}, e as (select run_id, max(step_end) as total from stage group by 1), l as (select distinct run_id, global_step from learning_ledger) select l.run_id, l.global_step, case when stage like '%anneal%' then 'anneal' when l.global_step < e.total / 3.0::double then 'early' when l.global_step < e.total * 2.0::double / 3 then 'mid' else 'late' end as phase from l join stage s on s.run_id = l.run_id and l.global_step >= step_start and l.global_step < step_end join e on e.run_id = l.run_id",
)
def phase(spark, folder):
    stages = stage_table(table(spark, folder, "mixture_stages")).withColumn("total", F.max("step_end").over(Window.partitionBy("run_id")))
    rows = table(spark, folder, "learning_ledger").select("run_id", "global_step").distinct().join(stages.select("run_id", "stage", "step_start", "step_end", "total"), "run_id")
    named = F.when(F.lower("stage").contains("anneal"), "anneal").when(F.col("global_step") < F.col("total") / 3, "early").when(F.col("global_step") < F.col("total") * 2 / 3, "mid").otherwise("late")
    return rows.filter("global_step >= step_start and global_step < step_end").select("run_id", "global_step", named.alias("phase"))


@query("prj_17_step_range", "select run_id, branch_id, global_step, count(*) as n from learning_ledger where global_step >= 100 and global_step < 400 group by all")
def step_range(spark, folder, start: int = 100, end: int = 400):
    if start >= end:
        raise ValueError(f"the range [{start}, {end}) is empty")
    return table(spark, folder, "learning_ledger").filter((F.col("global_step") >= start) & (F.col("global_step") < end)).groupBy("run_id", "branch_id", "global_step").agg(F.count("*").alias("n"))


@query("prj_18_branch", "select run_id, shard_id, count(*) as n from learning_ledger where branch_id = 'fork-a' group by all")
def branch(spark, folder):
    return table(spark, folder, "learning_ledger").filter("branch_id = 'fork-a'").groupBy("run_id", "shard_id").agg(F.count("*").alias("n"))


@query("win_15_repeated_pass", "select distinct run_id, branch_id, shard_id, global_step, count(*) over (partition by run_id, branch_id, shard_id order by global_step range between unbounded preceding and current row) as pass from learning_ledger")
def repeated_pass(spark, folder):
    """Entries at or before each step that touch its shard; steps are pre-aggregated, so a shard's rows are its steps."""
    steps = table(spark, folder, "learning_ledger").groupBy("run_id", "branch_id", "shard_id", "global_step").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("run_id", "branch_id", "shard_id").orderBy("global_step")
    return steps.withColumn("pass", F.sum("n").over(upto)).drop("n")


# --- selection -----------------------------------------------------------------------------------------------------------------


def letter_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, c, n`` of the characters of each document's whole trimmed text, counted where it is read."""
    ship(documents.sparkSession)

    def run(batches):
        for batch in batches:
            docs, chars, counts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(text)
                docs += [doc] * len(found)
                chars += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(chars, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "c", "n"])

    texts = documents.select("doc_id", T.strip(F.col("text")).alias("text")).filter("text is not null and text <> ''")
    return spread(texts).mapInArrow(run, "doc_id bigint, c string, n bigint")


def scored(spark, folder) -> DataFrame:
    """Score of each document by a unigram model of the corpus' characters: mean -ln p; less than two give 0.0.

    Whole texts make the model and are scored. The model has a row a character of Unicode at most, so it is broadcast.
    """
    per_doc = materialise(letter_counts(table(spark, folder, "documents")), "letters")
    counts = per_doc.groupBy("c").agg(F.sum("n").alias("total"))
    everything = counts.agg(F.sum("total").alias("all"))  # one row
    model = counts.join(F.broadcast(everything), how="cross").select("c", (-F.ln(F.col("total") / F.col("all"))).alias("cost"))
    mean = F.sum(F.col("n") * F.col("cost")) / F.sum("n")
    scores_ = per_doc.join(F.broadcast(model), "c").groupBy("doc_id").agg(F.round(F.when(F.sum("n") < 2, 0.0).otherwise(mean), 6).alias("score"), F.sum("n").alias("n"))
    return hashed_corpus(spark, folder).select("document_id", "doc_id", "lane").join(scores_, "doc_id").drop("doc_id")


def decided(scores: DataFrame, reject: float, defer: float, protected: tuple[str, ...]) -> DataFrame:
    raw = F.when(F.col("score") < reject, "rejected").when(F.col("score") > defer, "deferred").otherwise("accepted")
    reason = F.when(F.col("raw") == "rejected", "low_proxy_utility").when(F.col("raw") == "deferred", "anomalous_high_loss")
    override = F.col("lane").isin(*protected) & (F.col("raw") != "accepted")
    rows = scores.withColumn("raw", raw).withColumn("override", override)
    return rows.select("document_id", "lane", "score", F.when(F.col("override"), "accepted").otherwise(F.col("raw")).alias("status"), F.when(~F.col("override"), reason).alias("reason"), "override")


_SCORE_SQL = f"""with {_CORPUS_SQL}, ch as (select document_id, lane, c, count(*) as n from (select document_id, lane, unnest(list_transform(range(1, length(text)::bigint + 1), lambda i: substring(text, i, 1))) as c from corpus) group by all),
cost as (select c, -ln(sum(n) / (select sum(n) from ch)::double) as cost from ch group by 1),
score as (select document_id, lane, round(case when sum(n) < 2 then 0 else sum(n * cost) / sum(n) end, 6) as score from ch join cost using (c) group by all),
raw as (select *, case when score < {REJECT_BELOW} then 'rejected' when score > {DEFER_ABOVE} then 'deferred' else 'accepted' end as raw from score),
decision as (select document_id, lane, score, case when lane = 'indic' then 'accepted' else raw end as status, case when lane = 'indic' then null when raw = 'rejected' then 'low_proxy_utility' when raw = 'deferred' then 'anomalous_high_loss' end as reason, lane = 'indic' and raw <> 'accepted' as override from raw)"""


@query("ops_1_scores", _SCORE_SQL + " select document_id, lane, score from score")
def scores(spark, folder):
    return scored(spark, folder).select("document_id", "lane", "score")


@query("ops_2_decisions", _SCORE_SQL + " select * from decision")
def decisions(spark, folder):
    return decided(scored(spark, folder), REJECT_BELOW, DEFER_ABOVE, PROTECTED)


@query("prj_13_thresholds", "select distinct shard_id, opus_score, case when opus_score < 7 then 'rejected' when opus_score > 9 then 'deferred' else 'accepted' end as status from learning_ledger where opus_score is not null")
def thresholds(spark, folder):
    status = F.when(F.col("opus_score") < 7, "rejected").when(F.col("opus_score") > 9, "deferred").otherwise("accepted")
    return table(spark, folder, "learning_ledger").filter("opus_score is not null").select("shard_id", "opus_score", status.alias("status")).distinct()


_SHARD_SCORE_SQL = "d as (select shard_id, min(opus_score) as score, case when avg(opus_score) < 8.36 then 'rejected' when avg(opus_score) > 8.44 then 'deferred' else 'accepted' end as status from learning_ledger group by 1), m as (select distinct shard_id, capability_lane, token_count from shard_manifests)"


def shard_decisions(spark, folder) -> DataFrame:
    low = F.min("opus_score")
    return table(spark, folder, "learning_ledger").groupBy("shard_id").agg(low.alias("score"), F.when(F.avg("opus_score") < 8.36, "rejected").when(F.avg("opus_score") > 8.44, "deferred").otherwise("accepted").alias("status"))


def shard_list(spark, folder) -> DataFrame:
    return table(spark, folder, "shard_manifests").select("shard_id", "capability_lane", "token_count").distinct()


@query("jon_3_accepted_pool", f"with {_SHARD_SCORE_SQL} select m.* from m where shard_id in (select shard_id from d where status = 'accepted')")
def accepted_pool(spark, folder):
    return shard_list(spark, folder).join(shard_decisions(spark, folder).filter("status = 'accepted'"), "shard_id", "left_semi")


@query("jon_5_known_scores", f"with {_SHARD_SCORE_SQL} select m.shard_id, score from m join d using (shard_id) where score is not null")
def known_scores(spark, folder):
    return shard_list(spark, folder).join(shard_decisions(spark, folder), "shard_id").filter("score is not null").select("shard_id", "score")


@query("agg_15_decision_counts", f"with {_SHARD_SCORE_SQL} select capability_lane, count_if(status = 'accepted')::bigint as accepted, count_if(status = 'deferred')::bigint as deferred, count_if(status = 'rejected')::bigint as rejected from m join d using (shard_id) group by 1")
def decision_counts(spark, folder):
    rows = shard_list(spark, folder).join(shard_decisions(spark, folder), "shard_id")
    return rows.groupBy("capability_lane").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "deferred", "rejected")])


@query("agg_16_outside_by_stage", f"with {_SHARD_SCORE_SQL}, s as (select distinct stage, k as lane from (select stage, mixture, unnest(map_keys(mixture)) as k from mixture_stages) where mixture[k] > 0) select stage, status, count(*) as n from m join d using (shard_id) join s on s.lane = m.capability_lane where status <> 'accepted' group by all")
def outside_by_stage(spark, folder):
    fed = table(spark, folder, "mixture_stages").select("stage", F.explode("mixture").alias("capability_lane", "w")).filter("w > 0").groupBy("capability_lane").agg(F.array_sort(F.collect_set("stage")).alias("stages"))
    rows = shard_list(spark, folder).join(shard_decisions(spark, folder), "shard_id").filter("status <> 'accepted'").join(fed, "capability_lane")
    return rows.select(F.explode("stages").alias("stage"), "status").groupBy("stage", "status").agg(F.count("*").alias("n"))


# --- losses of served tokens ------------------------------------------------------------------------------------------------------

# a whole-number loss of each served token, so that sums are exact
_LOSS = "(s_end * (s_end - 1) - s_start * (s_start - 1)) / 2"


@query("agg_7_shard_loss", _PACK_SQL + " select step, shard_id, round(sum((s_end * (s_end - 1) - s_start * (s_start - 1)) / 2.0::double) / sum(w_end - w_start), 6) as avg_loss, sum(useful)::bigint as useful from seg2 group by all having sum(useful) > 0")
def shard_loss(spark, folder):
    rows = packed(spark, folder).groupBy("step", "shard_id").agg(F.round(F.sum(F.expr(_LOSS)) / F.sum(F.col("w_end") - F.col("w_start")), 6).alias("avg_loss"), F.sum(P.useful_tokens()).alias("useful"))
    return rows.filter("useful > 0")


@query("agg_8_shard_score", _PACK_SQL + ", " + _SCORE_SQL[_SCORE_SQL.index("ch as (") : _SCORE_SQL.index("raw as (")].rstrip().rstrip(",") + " select shard_id, round(sum(score * (w_end - w_start)) / sum(w_end - w_start)::double, 6) as score from seg2 join score using (document_id) group by 1")
def shard_score(spark, folder):
    """Mean score of the served tokens of each shard; documents without a score don't count."""
    n = F.col("w_end") - F.col("w_start")
    known = scored(spark, folder).filter("score is not null").select("document_id", "score")
    return packed(spark, folder).join(known, "document_id").groupBy("shard_id").agg(F.round(F.sum(F.col("score") * n) / F.sum(n), 6).alias("score"))


@query(
    "led_2_learning_entries",
    _PACK_SQL
    + """, le as (select step, shard_id, sum(w_end - w_start)::bigint as served, sum((s_end * (s_end - 1) - s_start * (s_start - 1)) / 2.0::double) / sum(w_end - w_start) as loss from seg2 group by all having sum(useful) > 0),
lf as (select *, count(*) over (partition by shard_id order by step)::bigint as pass, loss - lag(loss) over (partition by shard_id order by step) as delta from le)
select step, shard_id, served, pass, round(loss, 6) as avg_loss, round(delta, 6) as delta, case when delta <= -0.001 then 'useful' when delta >= 0.001 then 'harmful' when delta is not null then 'neutral' end as usefulness from lf""",
)
def learning_entries(spark, folder):
    """An entry a shard and step: its loss, the change since the shard's pass before (none at first) and what it says."""
    n = F.sum(F.col("w_end") - F.col("w_start"))
    rows = packed(spark, folder).groupBy("step", "shard_id").agg(n.alias("served"), (F.sum(F.expr(_LOSS)) / n).alias("loss"), F.sum(P.useful_tokens()).alias("useful")).filter("useful > 0")
    passes = Window.partitionBy("shard_id").orderBy("step")
    marked = rows.withColumn("pass", F.count("*").over(passes)).withColumn("delta", F.col("loss") - F.lag("loss").over(passes))
    return marked.select("step", "shard_id", "served", "pass", F.round("loss", 6).alias("avg_loss"), F.round("delta", 6).alias("delta"), usefulness(F.col("delta")).alias("usefulness"))


@query("jon_11_before_after", "with b as (select shard_id, avg(avg_token_loss) as loss from learning_ledger where global_step < 500 group by 1), a as (select shard_id, avg(avg_token_loss) as loss from learning_ledger where global_step >= 500 group by 1) select shard_id, round(a.loss - b.loss, 6) as delta from a join b using (shard_id)")
def before_after(spark, folder):
    log = table(spark, folder, "learning_ledger")
    mean = lambda rows, name: rows.groupBy("shard_id").agg(F.avg("avg_token_loss").alias(name))
    both = mean(log.filter("global_step < 500"), "b").join(mean(log.filter("global_step >= 500"), "a"), "shard_id")
    return both.select("shard_id", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("jon_8_planned_actual", "with p as (select lane, avg(target_weight) as w from lane_plans where lane in ('code', 'indic', 'instruction', 'general_web', 'archive_misc') group by 1), a as (select capability_lane as lane, count(*) / (select count(*) from shard_manifests)::double as w from shard_manifests group by 1) select coalesce(p.lane, a.lane) as lane, round(coalesce(p.w, 0), 6) as planned, round(coalesce(a.w, 0), 6) as actual from p full outer join a on a.lane = p.lane")
def planned_actual(spark, folder):
    plan = table(spark, folder, "lane_plans").filter("lane in ('code', 'indic', 'instruction', 'general_web', 'archive_misc')").groupBy("lane").agg(F.avg("target_weight").alias("p"))
    shards = table(spark, folder, "shard_manifests")
    total = F.broadcast(shards.agg(F.count("*").alias("t")))  # one row
    actual = shards.groupBy(F.col("capability_lane").alias("l")).agg(F.count("*").alias("n")).join(total, how="cross").select("l", (F.col("n") / F.col("t")).alias("a"))
    both = plan.join(actual, plan["lane"].eqNullSafe(actual["l"]), "full_outer")
    return both.select(F.coalesce("lane", "l").alias("lane"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("planned"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("actual"))


@query("jon_10_replay_mismatch", "with r as (select shard_id, max(token_count) as token_count, max(document_count) as document_count from shard_manifests group by 1), c as (select shard_id, max(s.end_token) as token_count, count(distinct s.document_id) as document_count from (select shard_id, unnest(document_spans) as s from shard_manifests) group by 1) select r.shard_id, r.token_count is not distinct from c.token_count as tokens_match, r.document_count is not distinct from c.document_count as documents_match from r left join c using (shard_id)")
def replay_mismatch(spark, folder):
    m = table(spark, folder, "shard_manifests")
    recorded = m.groupBy("shard_id").agg(F.max("token_count").alias("t"), F.max("document_count").alias("d"))
    again = m.select("shard_id", F.explode("document_spans").alias("s")).groupBy("shard_id").agg(F.max("s.end_token").alias("t2"), F.count_distinct("s.document_id").alias("d2"))
    return recorded.join(again, "shard_id", "left").select("shard_id", F.col("t").eqNullSafe(F.col("t2")).alias("tokens_match"), F.col("d").eqNullSafe(F.col("d2")).alias("documents_match"))


@query("jon_14_known_shards", "select (select count(distinct shard_id) from learning_ledger where shard_id not in (select shard_id from shard_manifests where shard_id is not null)) as unknown, (select count(*) from learning_ledger) > 0 as present")
def known_shards(spark, folder):
    log = table(spark, folder, "learning_ledger")
    unknown = log.select("shard_id").distinct().join(table(spark, folder, "shard_manifests").select("shard_id"), "shard_id", "left_anti")
    return unknown.agg(F.count("*").alias("unknown")).join(log.agg((F.count("*") > 0).alias("present")), how="cross")


# --- branches ----------------------------------------------------------------------------------------------------------------------

_EDGE_SQL = """edge as (select run_id, branch_id, lag(branch_id) over w as parent, case when lag(branch_id) over w is not null then first end as fork_step from (select run_id, branch_id, min(global_step) as first from learning_ledger group by run_id, branch_id) window w as (partition by run_id order by first, branch_id))"""


def edges(spark, folder) -> DataFrame:
    """Branches with their parents, as the ledger tells them: a run's first branch is its root, and each later one starts
    at its first step from the branch that started before it."""
    rows = table(spark, folder, "learning_ledger").groupBy("run_id", "branch_id").agg(F.min("global_step").alias("first"))
    parent = F.lag("branch_id").over(Window.partitionBy("run_id").orderBy("first", "branch_id"))
    return rows.withColumn("parent", parent).select("run_id", "branch_id", "parent", F.when(F.col("parent").isNotNull(), F.col("first")).alias("fork_step"))


def lineage(edge: DataFrame, depth: int = 64) -> DataFrame:
    """Chain of each branch up to its root: ``run_id, branch_id, ancestor, level, fork_step``.

    Parent pointers are followed by recursion in the engine; a branch deeper than ``depth`` is a cycle and raises.
    """
    spark = edge.sparkSession
    edge.createOrReplaceTempView("quern_edges")
    return spark.sql(f"""with recursive chain(run_id, branch_id, ancestor, parent, fork_step, level) as (
      select run_id, branch_id, branch_id, parent, fork_step, 0 from quern_edges
      union all select c.run_id, c.branch_id, e.branch_id, e.parent, e.fork_step, c.level + 1 from chain c join quern_edges e on e.run_id = c.run_id and e.branch_id = c.parent
    ) select run_id, branch_id, ancestor, if(level >= {depth}, raise_error('cycle in the lineage'), level) as level, fork_step from chain""")


_CHAIN_SQL = f"""with recursive {_EDGE_SQL}, chain as (select run_id, branch_id, branch_id as ancestor, parent, fork_step, 0 as level from edge
  union all select c.run_id, c.branch_id, e.branch_id, e.parent, e.fork_step, c.level + 1 from chain c join edge e on e.run_id = c.run_id and e.branch_id = c.parent)"""


@query("jon_15_lineage", _CHAIN_SQL + " select run_id, branch_id, ancestor, level, fork_step from chain")
def lineages(spark, folder):
    return lineage(edges(spark, folder))


_STITCH_SQL = (
    _CHAIN_SQL
    + """, seg as (select run_id, branch_id, ancestor, coalesce(fork_step + 1, 0) as low, lead(fork_step) over (partition by run_id, branch_id order by level desc) + 1 as high from chain),
st as (select g.run_id, g.branch_id, l.global_step, l.shard_id from seg g join learning_ledger l on l.run_id = g.run_id and l.branch_id = g.ancestor and l.global_step >= low and (high is null or l.global_step < high))"""
)


def stitched(spark, folder) -> DataFrame:
    """Entries of a branch's whole history, each ancestor clipped at the fork after it; the branch's own part is open."""
    order = Window.partitionBy("run_id", "branch_id").orderBy(F.col("level").desc())
    parts = lineage(edges(spark, folder)).select("run_id", "branch_id", "ancestor", F.coalesce(F.col("fork_step") + 1, F.lit(0)).alias("low"), (F.lead("fork_step").over(order) + 1).alias("high"))
    log = table(spark, folder, "learning_ledger").select("run_id", F.col("branch_id").alias("ancestor"), "global_step", "shard_id")
    return parts.join(log, ["run_id", "ancestor"]).filter("global_step >= low and (high is null or global_step < high)").select("run_id", "branch_id", "global_step", "shard_id")


@query("jon_16_stitched", _STITCH_SQL + " select run_id, branch_id, global_step, count(*) as n from st group by all")
def stitched_counts(spark, folder):
    return stitched(spark, folder).groupBy("run_id", "branch_id", "global_step").agg(F.count("*").alias("n"))


@query("agg_11_lineage_audit", _STITCH_SQL + " select run_id, branch_id, count(*) as entries, count(distinct shard_id) as shards, max(global_step) as last_step from st group by all")
def lineage_audit(spark, folder):
    return stitched(spark, folder).groupBy("run_id", "branch_id").agg(F.count("*").alias("entries"), F.count_distinct("shard_id").alias("shards"), F.max("global_step").alias("last_step"))


@query("set_8_history", _STITCH_SQL + " select branch_id, count(*) as n from st group by 1")
def history(spark, folder):
    return stitched(spark, folder).groupBy("branch_id").agg(F.count("*").alias("n"))


@query("agg_18_checkpoints", "select run_id, branch_id, min(global_step) as earliest, max(global_step) as latest, max(global_step) + 1 as next from learning_ledger group by all")
def checkpoints(spark, folder):
    return table(spark, folder, "learning_ledger").groupBy("run_id", "branch_id").agg(F.min("global_step").alias("earliest"), F.max("global_step").alias("latest"), (F.max("global_step") + 1).alias("next"))


# --- reports ------------------------------------------------------------------------------------------------------------------------


@query("agg_14_throughput", "select event_type, sum(value) > 0 as positive, round(sum(value), 4) as seconds, count(*) as steps, round(case when sum(value) > 0 then count(*) / sum(value) else 0 end, 6) as rate from events group by 1")
def throughput(spark, folder):
    total = F.sum("value")
    return table(spark, folder, "events").groupBy("event_type").agg((total > 0).alias("positive"), F.round(total, 4).alias("seconds"), F.count("*").alias("steps"), F.round(F.when(total > 0, F.count("*") / total).otherwise(0.0), 6).alias("rate"))


_EVIDENCE_SQL = """with e as (select 'unique documents' as claim, count(*) = count(distinct doc_id) as passed from documents union all select 'registry hashes', bool_and(content_hash = 'sha256:' || sha256(text)) from eval_registry union all select 'known outcomes', bool_and(usefulness_classification is null or usefulness_classification in ('useful', 'harmful', 'neutral')) from learning_ledger)"""


@query("snk_9_evidence", _EVIDENCE_SQL + " select claim, passed, (select coalesce(bool_and(passed), true) from e) as overall from e")
def evidence(spark, folder):
    docs = table(spark, folder, "documents").agg(F.lit("unique documents").alias("claim"), (F.count("*") == F.count_distinct("doc_id")).alias("passed"))
    items = table(spark, folder, "eval_registry").agg(F.lit("registry hashes").alias("claim"), F.bool_and(F.col("content_hash") == F.concat(F.lit("sha256:"), F.sha2("text", 256))).alias("passed"))
    known = F.col("usefulness_classification").isNull() | F.col("usefulness_classification").isin("useful", "harmful", "neutral")
    log = table(spark, folder, "learning_ledger").agg(F.lit("known outcomes").alias("claim"), F.bool_and(known).alias("passed"))
    rows = docs.unionByName(items).unionByName(log)
    return rows.join(rows.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("overall")), how="cross")


@query("agg_19_all_pass", "select bool_and(loss_delta_before_after < 1) as passed, count_if(loss_delta_before_after > 0.009)::bigint as failing from learning_ledger")
def all_pass(spark, folder):
    return table(spark, folder, "learning_ledger").agg(F.bool_and(F.col("loss_delta_before_after") < 1).alias("passed"), F.count_if(F.col("loss_delta_before_after") > 0.009).alias("failing"))


@query("jon_17_upsert", "with old as (select source as key, count(*) as n, 'old' as v from documents where source is not null group by 1), fresh as (select source as key, count(*) as n, 'new' as v from documents where source like '%a%' group by 1) select * from fresh union all select * from old where key not in (select key from fresh)")
def upsert(spark, folder):
    docs = table(spark, folder, "documents")
    old = docs.filter("source is not null").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"), F.lit("old").alias("v"))
    fresh = docs.filter("source like '%a%'").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"), F.lit("new").alias("v"))
    return fresh.unionByName(old.join(fresh, "key", "left_anti"))


def ordered_by(rows: DataFrame, key: str, first: list[str]) -> DataFrame:
    """``key, place`` of a bounded set of keys: ``first`` in its order, then the others; an unknown one in it raises."""
    known = {r[0] for r in rows.filter(F.col(key).isin(*first)).distinct().collect()}
    if unknown := [k for k in first if k not in known]:
        raise ValueError(f"unknown {key}: {', '.join(unknown)}")
    ranks = F.coalesce(*[F.when(F.col(key) == k, n) for n, k in enumerate(first)], F.lit(len(first)))
    return rows.select(key, F.row_number().over(Window.orderBy(ranks, key)).alias("place"))


@query("jon_18_custom_order", "select domain, (row_number() over (order by coalesce(case domain when 'code' then 0 when 'web' then 1 end, 99), domain))::int as place from (select distinct domain from documents where domain is not null)")
def custom_order(spark, folder):
    return ordered_by(table(spark, folder, "documents").filter("domain is not null").select("domain").distinct(), "domain", ["code", "web"])


@query("rep_1_profiles", "select coalesce(source, '') as key, count(*) as n_docs, coalesce(sum(length(text)), 0)::bigint as chars, count_if(coalesce(trim(text), '') = '')::bigint as empty from documents group by 1")
def profiles(spark, folder):
    return table(spark, folder, "documents").groupBy(F.coalesce("source", F.lit("")).alias("key")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"))


@query("sup_20_percent", "select id, coalesce(printf('%.1f%%', script_purity * 100), '—') as value from (select distinct id, script_purity from clean_records)")
def percent(spark, folder):
    shown = F.coalesce(F.when(F.col("script_purity").isNotNull(), F.format_string("%.1f%%", F.col("script_purity") * 100)), F.lit("—"))
    return table(spark, folder, "clean_records").select("id", "script_purity").distinct().select("id", shown.alias("value"))


@query(
    "win_7_ramp",
    f"with {_STAGE_SQL}, warm as (select *, warmup_tokens // (sequence_length * {S.BATCH}) as warm from stage) select run_id, stage, step, round(case when ord > 1 and warm > 0 then least(1, (step - step_start) / warm::double) else 1 end, 6) as progress from (select *, unnest(range(step_start, step_end)) as step from warm)",
)
def ramp(spark, folder):
    """Progress of each step between the mixture before and its stage's own; a run's first stage never ramps."""
    stages = stage_table(table(spark, folder, "mixture_stages")).filter("step_end > step_start")
    warm = F.floor(F.col("warmup_tokens") / (F.col("sequence_length") * S.BATCH))
    progress = F.when((F.col("ord") > 1) & (warm > 0), F.least(F.lit(1.0), (F.col("step") - F.col("step_start")) / warm)).otherwise(1.0)
    return stages.withColumn("step", F.explode(F.sequence("step_start", F.col("step_end") - 1))).select("run_id", "stage", "step", F.round(progress, 6).alias("progress"))


@query("win_21_snapshots", "select run_id, global_step from (select distinct run_id, global_step, max(global_step) over (partition by run_id) as last from learning_ledger) where global_step % 50 = 0 or global_step = last")
def snapshots(spark, folder):
    steps = table(spark, folder, "learning_ledger").select("run_id", "global_step").distinct()
    last = steps.groupBy("run_id").agg(F.max("global_step").alias("last"))
    return steps.join(last, "run_id").filter("global_step % 50 = 0 or global_step = last").select("run_id", "global_step")


def timings(spark, folder) -> DataFrame:
    """Served tokens by step of the curriculum (input of a throughput report)."""
    return sample_rows(spark, folder).groupBy("step").agg(F.sum("served").alias("served"))


@query("str_22_ids", _PACK_SQL + " select 'ps-' || step || '-' || slot as sample_id, 'opus-' || min(shard_id) || '-' || min(document_id) as candidate_id from seg2 group by step, slot")
def ids(spark, folder):
    rows = packed(spark, folder).groupBy("step", "slot").agg(F.min("shard_id").alias("s"), F.min("document_id").alias("d"))
    return rows.select(F.format_string("ps-%d-%d", "step", "slot").alias("sample_id"), F.format_string("opus-%s-%s", "s", "d").alias("candidate_id"))


# --- checkpoints and forks ---------------------------------------------------------------------------------------------------------


@query("rpl_5_checkpoints", "select run_id, branch_id, max(global_step) as global_step, null::varchar as parent_branch_id, null::int as fork_step from learning_ledger group by all")
def stored_checkpoints(spark, folder):
    """Checkpoint metadata of each branch's last step, saved and restored (tensors are no data of this engine)."""
    store = C.Checkpoints(spark, f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}")
    last = table(spark, folder, "learning_ledger").groupBy("run_id", "branch_id").agg(F.max("global_step").alias("global_step"))
    store.save(last)
    store.save(last)  # a second time is no write
    return store.table()


@query("frk_1_forks", "select run_id, 'trial' as branch_id, min(global_step) as earliest, max(global_step) as latest, branch_id as parent_branch_id from learning_ledger where branch_id = 'main' group by run_id, branch_id having max(global_step) = min(global_step) union all select run_id, 'trial', max(global_step), max(global_step), 'main' from learning_ledger where branch_id = 'main' group by run_id having max(global_step) <> min(global_step)")
def forks(spark, folder):
    """A new branch of each run from the last checkpoint of ``main``; its first checkpoint carries the lineage."""
    store = C.Checkpoints(spark, f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}")
    last = table(spark, folder, "learning_ledger").filter("branch_id = 'main'").groupBy("run_id", "branch_id").agg(F.max("global_step").alias("global_step"))
    store.save(last)
    store.fork(last.withColumnRenamed("global_step", "fork_step"), "trial")
    return store.ends().filter("parent_branch_id is not null")
