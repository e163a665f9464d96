"""Smaller queries: literal tables, aligned frames, characters by script, noise counters, joins of tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import config
from quern.operators import packing as P
from quern.operators import schedule as S
from quern.plans.catalog import query
from quern.plans.fertility import _ATOMS, _GROUP_SQL, _UNITS, atoms, token_groups
from quern.plans.packing import _PACK_SQL, packed, schedule
from quern.plans.schedule import _COMPILED_SQL, SEED, compiled
from quern.plans.shards import _BINS_SQL, shard_spans
from quern.plans.text import _CONTROL, _ZERO, _sql_count
from quern.plans.vectors import dot
from quern.runtime import materialise, ship, spread, table

TOY = (("doc-a", "web", "en", "The canal was closed."), ("doc-b", "code", "en", "import os"), ("doc-c", "news", "hi", "नदी का पानी"), ("doc-d", "instruction", "en", "Prompt Response: yes"))


@query("src_11_literal_table", "select * from (values " + ", ".join(str(r) for r in TOY) + ") t(id, domain, language, text)")
def literal_table(spark, folder):
    return spark.createDataFrame(TOY, "id string, domain string, language string, text string")


@query("str_12_noise_counters", f"select doc_id, {_sql_count('text', f'[{_CONTROL}]')}::int as control, {_sql_count('text', f'[{_ZERO}]')}::int as zero_width, {_sql_count('text', chr(0xFFFD))}::int as broken from documents where text is not null")
def noise_counters(spark, folder):
    count = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", count(f"[{T.CONTROL}]").alias("control"), count(f"[{T.ZERO_WIDTH}]").alias("zero_width"), count("�").alias("broken"))


@query("prj_10_empty_after_clean", f"select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[{_CONTROL}{_ZERO}�]', '', 'g'), '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')) = '' as empty from documents")
def empty_after_clean(spark, folder):
    clean = T.collapsed(T.drop_noise(T.drop_replacement(F.coalesce("text", F.lit("")))))
    return table(spark, folder, "documents").select("doc_id", (clean == "").alias("empty"))


@query("prj_19_letters_by_script", r"select doc_id, len(regexp_extract_all(text, '[\x{0904}-\x{0939}\x{093d}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097f}]'))::int as devanagari, len(regexp_extract_all(text, '\p{Latin}'))::int as latin from documents where text is not null")
def letters_by_script(spark, folder):
    count = lambda name: F.regexp_count("text", F.lit(rf"[\p{{L}}&&\p{{Is{name}}}]"))
    latin = F.regexp_count("text", F.lit(r"\p{IsLatin}"))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", count("Devanagari").alias("devanagari"), latin.alias("latin"))


def principal_axes(vectors: DataFrame) -> DataFrame:
    """``label, v``: the first principal axis of each label's vectors, by sums of products that tasks add up themselves."""
    ship(vectors.sparkSession)
    rows = vectors.filter("label is not null and embedding is not null").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def add(batches):
        held: dict = {}
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([1.0, *x])
                held[label] = held.get(label, 0) + np.outer(x, x)  # with the number and the sums in its first row
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))], ["label", "m"])

    def axis(batches):
        for batch in batches:
            out = []
            for m in batch.column(1).to_pylist():
                m = np.array(m).reshape(int(len(m) ** 0.5), -1)
                mean = m[0, 1:] / m[0, 0]
                v = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, -1]
                out.append((v * np.sign(v[np.abs(v).argmax()])).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["label", "v"])

    sums = spread(rows).mapInArrow(add, "label bigint, m array<double>").select("label", F.posexplode("m").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"))
    return whole.mapInArrow(axis, "label bigint, v array<double>")


@query("win_22_aligned_frames")
def aligned_frames(spark, folder):
    """First principal axis of each frame (label), turned so that it never points against that of the frame before."""
    return aligned(principal_axes(table(spark, folder, "embeddings"))).select("label", F.posexplode("v").alias("place", "x")).withColumn("x", F.round("x", 6))


def aligned(frames: DataFrame) -> DataFrame:
    """Signs follow from the turns so far, as each axis is held against the one before in either direction."""
    order = Window.orderBy("label")  # a row a frame
    turn = F.when(dot(F.col("v"), F.lag("v").over(order)) < 0, -1).otherwise(1)
    turned = F.sum(F.when(F.col("turn") < 0, 1).otherwise(0)).over(order)
    return frames.withColumn("turn", turn).withColumn("sign", F.when(turned % 2 == 1, -1.0).otherwise(1.0)).select("label", F.transform("v", lambda x: x * F.col("sign")).alias("v"))


@query("win_1_ordinals", "select doc_id, 'doc-' || lpad((row_number() over (order by doc_id) - 1)::varchar, 6, '0') as document_id from documents")
def ordinals(spark, folder):
    from quern.operators.order import running

    rows = table(spark, folder, "documents").select("doc_id")
    placed = running(rows.withColumn("g", F.lit(0)), ["g"], ["doc_id"], F.lit(1), F.floor(F.col("doc_id") / 4096), "n")
    return placed.select("doc_id", F.format_string("doc-%06d", "n").alias("document_id"))


@query("win_9_epochs", "select capability_lane, shard_id, epoch from (select distinct capability_lane, shard_id from shard_manifests), range(3) t(epoch)")
def epochs(spark, folder):
    """A lane's shards, epoch after epoch."""
    rows = table(spark, folder, "shard_manifests").select("capability_lane", "shard_id").distinct()
    return rows.select("capability_lane", "shard_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("epoch"))


@query(
    "generic_join_report",
    "select n_name, o_orderstatus, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all",
)
def join_report(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("lines"), F.round(F.sum("r"), 2).alias("revenue"))


# --- parts of composite operators, by themselves ------------------------------------------------------------------------------


@query("win_2_shard_index", _BINS_SQL + " select distinct lane, bin::int as bin, shard_id from s")
def shard_index(spark, folder):
    return shard_spans(spark, folder).select("lane", "bin", "shard_id").distinct()


@query("win_3_document_spans", _BINS_SQL + " select document_id, start_token, end_token from s")
def document_spans(spark, folder):
    return shard_spans(spark, folder).select("document_id", "start_token", "end_token")


@query("win_5_cumulative_supply", _COMPILED_SQL + " select run_id, lane, ord, round(cum, 3) as cumulative from compiled")
def cumulative_supply(spark, folder):
    return compiled(spark, folder)[1].select("run_id", "lane", F.col("ord").cast("bigint").alias("ord"), F.round("cumulative_tokens_after", 3).alias("cumulative"))


@query("win_6_thresholds", _COMPILED_SQL + " select run_id, ord, lane, round(sum(effective_weight) over (partition by run_id, ord order by lane), 6) as upto from compiled where effective_weight > 0")
def thresholds(spark, folder):
    order = Window.partitionBy("run_id", "ord").orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
    rows = compiled(spark, folder)[1].filter("effective_weight > 0")
    return rows.select("run_id", F.col("ord").cast("bigint").alias("ord"), "lane", F.round(F.sum("effective_weight").over(order), 6).alias("upto"))


@query("win_10_epochs_of_lanes", _PACK_SQL + " select lane, epoch, count(*) as documents, min(de - (end_token - start_token))::bigint as starts from doc group by all")
def epochs_of_lanes(spark, folder):
    spans, _, slots = schedule(spark, folder)
    rows = P.stream(spans, P.windows(slots), SEED)
    return rows.groupBy("lane", "epoch").agg(F.count("*").alias("documents"), F.min("ds").alias("starts"))


@query("win_20_blank_lines", r"select doc_id, regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g') as value from documents")
def blank_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"\n{3,}", "\n\n").alias("value"))


@query("set_3_merge_pairs", f"with {_GROUP_SQL}, p as (select grp, rank, substring(token, 1, 1) as a, substring(token, 2, 1) as b from g where length(token) >= 2) select a, b, grp, rank from (select *, row_number() over (partition by a, b order by grp, rank) as r from p) where r = 1")
def merge_pairs(spark, folder):
    """Merges of several groups, each pair once: the first group and rank that has it."""
    pairs = token_groups(spark, folder).filter("length(token) >= 2").select(F.substring("token", 1, 1).alias("a"), F.substring("token", 2, 1).alias("b"), "grp", "rank")
    return pairs.groupBy("a", "b").agg(F.min(F.struct("grp", "rank")).alias("m")).select("a", "b", "m.grp", "m.rank")


@query("pck_1_one_step", _PACK_SQL + " select slot, lane, document_id, w_start, w_end from seg2 where step = 5")
def one_step(spark, folder):
    """The windows of a step, from the step's own intervals: nothing before it is packed."""
    return packed(spark, folder, steps=(5, 6)).select("slot", "lane", "document_id", "w_start", "w_end")


@query("pck_5_attention", _PACK_SQL + ", p as (select seg_no, w_start + k as position from seg2, range(512) r(k) where step = 0 and slot = 0 and w_start + k < w_end) select i.position as i, j.position as j from p i join p j on i.seg_no = j.seg_no and j.position <= i.position")
def attention(spark, folder):
    """Positions of one window that see each other: same segment, not ahead."""
    rows = packed(spark, folder, steps=(0, 1)).filter("slot = 0").select("w_start", F.explode(F.sequence("w_start", F.col("w_end") - 1)).alias("i"))
    return rows.select("i", F.explode(F.sequence("w_start", "i")).alias("j"))


@query("rpl_4_next_step", "select run_id, branch_id, max(global_step) + 1 as next_step from learning_ledger group by all")
def next_step(spark, folder):
    return table(spark, folder, "learning_ledger").groupBy("run_id", "branch_id").agg((F.max("global_step") + 1).alias("next_step"))


@query("sup_5_step_batches", _PACK_SQL + " select step, slot // 4 as microbatch, string_agg(lane, ',' order by slot) as lanes from slots group by all")
def step_batches(spark, folder):
    rows = schedule(spark, folder)[2].select("step", F.expr("slot div 4").alias("microbatch"), "slot", "lane")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slot", "lane"))), lambda x: x["lane"])
    return rows.groupBy("step", "microbatch").agg(F.array_join(ordered, ",").alias("lanes"))


@query("tok_3_word_pretokens", f"select lang, count(*) as n, sum(strlen(atom))::bigint as bytes from (select lang, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '{_ATOMS}')) as atom from documents where text is not null) group by 1")
def word_pretokens(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null").select("lang", F.explode(atoms(F.col("text"))).alias("atom"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("atom")).alias("bytes"))


@query("tok_4_space_pretokens", "select piece, count(*) as n from (select unnest(list_transform(string_split(text, ' '), lambda w: '▁' || w)) as piece from documents where text is not null) group by 1")
def space_pretokens(spark, folder):
    """Words marked by the blank before them; joining them and turning the marks back gives the text."""
    pieces = F.transform(F.split("text", " ", -1), lambda w: F.concat(F.lit("▁"), w))
    return table(spark, folder, "documents").filter("text is not null").select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


_UNIFORM_SQL = "(('0x' || substring(sha256('{0}:' || doc_id || ':{1}'), 1, 16))::ubigint)::double / 18446744073709551616.0"


@query("mth_4_normal_numbers", f"select doc_id, round(sqrt(-2 * ln(greatest(u, 1e-300))) * cos(2 * pi() * v), 6) as z from (select doc_id, {_UNIFORM_SQL.format(SEED, 'u')} as u, {_UNIFORM_SQL.format(SEED, 'v')} as v from documents)")
def normal_numbers(spark, folder):
    """A standard normal number for each row, from two uniform ones that depend on the row only."""
    u, v = (S.uniform(F.lit(SEED), F.col("doc_id"), F.lit(k)) for k in "uv")
    z = F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * F.pi() * v)
    return table(spark, folder, "documents").select("doc_id", F.round(z, 6).alias("z"))


@query("mth_8_bisection", "select (min(length(text)))::bigint as least from (select text, row_number() over (order by length(text)) as r, count(*) over () as n from documents where text is not null) where r >= n * 0.5")
def bisection(spark, folder):
    """The least length that at least half of the texts don't exceed, by bisection over aggregates."""
    lengths = materialise(table(spark, folder, "documents").filter("text is not null").select(F.length("text").alias("n")).groupBy("n").agg(F.count("*").alias("c")), "lengths")
    stats = lengths.agg(F.sum("c").alias("all"), F.max("n").alias("top")).first()
    half = lambda k: (lengths.filter(F.col("n") <= int(k)).agg(F.sum("c")).first()[0] or 0) >= stats["all"] * 0.5
    least = config.bisect(0, stats["top"] or 0, half, whole=True)
    return spark.createDataFrame([(int(least),)], "least bigint")


@query("sup_21_fertility_of_text", "select doc_id, round(strlen(text) / nullif(len(regexp_extract_all(text, '" + _UNITS + "')), 0)::double, 6) as by_units from documents where text is not null")
def fertility_of_text(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.round(F.try_divide(F.octet_length("text"), T.faithful_units(F.col("text"))), 6).alias("by_units"))
