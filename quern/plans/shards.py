"""Queries of the firewall, of shards and their manifests, and of append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import order
from quern.plans.catalog import query
from quern.plans.text import _DOCS_SQL, numbered
from quern.runtime import materialise, table

BUDGET = 100_000

_LANE_SQL = "case when lang in (" + ", ".join(f"'{x}'" for x in T.INDIC) + ") then 'indic' when domain in ('code', 'qa') then 'code' when domain in ('math', 'science') then 'math_science' when domain = 'instruction' then 'instruction' else 'general_web' end"
_CORPUS_SQL = f"corpus as (select *, {_LANE_SQL} as lane, 'sha256:' || sha256(text) as content_hash from ({_DOCS_SQL}) where text <> '')"
_REGISTRY_SQL = "registry as (select distinct content_hash, benchmark_id, never_train from eval_registry union all select 'sha256:' || sha256(text), 'holdout-copy', true from corpus where source = 'oddments')"
_KEYS_SQL = f"with {_CORPUS_SQL}, {_REGISTRY_SQL}"


def hashed_corpus(spark, folder) -> DataFrame:
    """Documents that have text, as narrow rows: ids, lane, hash, byte tokens with the end token, start of the response.

    All that is asked of a text is computed where it is read, so texts don't shuffle.
    """
    text = F.col("text")
    cut = T.marker(text)
    response = F.when(F.col("lane") == "instruction", F.when(cut.isNull(), 0).otherwise(F.octet_length(F.substring(text, F.lit(1), cut))))
    rows = table(spark, folder, "documents").select("doc_id", "source", "domain", "lang", T.lane(F.col("domain"), F.col("lang")).alias("lane"), T.strip(text).alias("text"))
    narrow = rows.select("doc_id", "source", "domain", "lang", "lane", T.digest(text).alias("content_hash"), (F.octet_length("text") + 1).alias("n"), response.cast("int").alias("response"), (F.coalesce(text, F.lit("")) != "").alias("_some"))
    return numbered(narrow).filter("_some").drop("_some")


def registry(spark, folder) -> DataFrame:
    """Held-out hashes: the registry's, and texts of the corpus registered as held out beside them."""
    own = table(spark, folder, "eval_registry").select("content_hash", "benchmark_id", "never_train").distinct()
    held = hashed_corpus(spark, folder).filter("source = 'oddments'").select("content_hash", F.lit("holdout-copy").alias("benchmark_id"), F.lit(True).alias("never_train"))
    return own.unionByName(held)


def admitted(documents: DataFrame, held_out: DataFrame) -> DataFrame:
    """Documents whose hash isn't held out."""
    return documents.join(held_out.select("content_hash").distinct(), "content_hash", "left_anti")


def blocked(documents: DataFrame, held_out: DataFrame) -> DataFrame:
    """An event for each held-out document, with its benchmark (the least where several hold one hash)."""
    unique = held_out.groupBy("content_hash").agg(F.min("benchmark_id").alias("benchmark_id"))
    return documents.join(unique, "content_hash").select("document_id", "doc_id", "content_hash", "benchmark_id")


@query("jon_1_admitted", _KEYS_SQL + " select document_id, doc_id, lane from corpus where content_hash not in (select content_hash from registry)")
def admitted_documents(spark, folder):
    return admitted(hashed_corpus(spark, folder), registry(spark, folder)).select("document_id", "doc_id", "lane")


@query("jon_2_blocked", _KEYS_SQL + " select document_id, doc_id, c.content_hash, benchmark_id from corpus c join (select content_hash, min(benchmark_id) as benchmark_id from registry group by 1) r on c.content_hash = r.content_hash")
def blocked_documents(spark, folder):
    return blocked(hashed_corpus(spark, folder), registry(spark, folder))


@query("snk_8_block_events", _KEYS_SQL + " select benchmark_id, count(*) as n from corpus c join (select content_hash, min(benchmark_id) as benchmark_id from registry group by 1) r on c.content_hash = r.content_hash group by 1")
def block_events(spark, folder):
    return blocked(hashed_corpus(spark, folder), registry(spark, folder)).groupBy("benchmark_id").agg(F.count("*").alias("n"))


@query("jon_13_events_outside", "select distinct document_id from blocked_events where document_id not in (select document_id from documents where document_id is not null)")
def events_outside(spark, folder):
    return table(spark, folder, "blocked_events").join(table(spark, folder, "documents").select("document_id"), "document_id", "left_anti").select("document_id").distinct().filter("document_id is not null")


# --- append-only logs ----------------------------------------------------------------------------------------------------


def last_writes(log: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate (no sort of a key's rows)."""
    values = [c for c in log.columns if c not in key]
    latest = log.groupBy(*key).agg(F.max(F.struct(*seq, *[c for c in values if c not in seq])).alias("r"))
    return latest.select(*key, *[F.col(f"r.{c}").alias(c) for c in values])


@query(
    "src_12_last_writes",
    "select run_id, branch_id, global_step, shard_id, recorded_at, avg_token_loss from (select *, row_number() over (partition by run_id, branch_id, global_step, shard_id order by recorded_at desc, avg_token_loss desc nulls last) as r from learning_ledger) where r = 1",
)
def reload_log(spark, folder):
    log = table(spark, folder, "learning_ledger").select("run_id", "branch_id", "global_step", "shard_id", "recorded_at", "avg_token_loss")
    return last_writes(log, ["run_id", "branch_id", "global_step", "shard_id"], ["recorded_at"])


class ConflictError(ValueError):
    """A key was appended again with other content."""


def conflicts(stored: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    return new.alias("n").join(stored.alias("s"), key).filter(~F.col(f"n.{content}").eqNullSafe(F.col(f"s.{content}"))).select(*key, F.col(f"s.{content}").alias("stored"), F.col(f"n.{content}").alias("appended"))


def append(stored: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    """Rows of ``new`` to write: keys that are stored with the same content are no writes; other content raises."""
    wrong = conflicts(stored, new, key, content).head(1)
    if wrong:
        raise ConflictError(f"{wrong[0].asDict()}")
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


@query(
    "snk_4_idempotent_append",
    """with s as (select content_hash, min(benchmark_id) as benchmark_id from eval_registry where benchmark_id = 'toy-holdout' group by 1), n as (select content_hash, min(benchmark_id) as benchmark_id from eval_registry group by 1)
select content_hash, benchmark_id from n where content_hash not in (select content_hash from s)""",
)
def idempotent_append(spark, folder):
    items = table(spark, folder, "eval_registry")
    stored = items.filter("benchmark_id = 'toy-holdout'").groupBy("content_hash").agg(F.min("benchmark_id").alias("benchmark_id"))
    new = items.groupBy("content_hash").agg(F.min("benchmark_id").alias("benchmark_id"))
    return append(stored, new, ["content_hash"], "benchmark_id")


@query("sup_3_registered", "select distinct 'sha256:' || sha256(text) as computed, content_hash, benchmark_id from eval_registry")
def registered(spark, folder):
    return table(spark, folder, "eval_registry").select(T.digest(F.col("text")).alias("computed"), "content_hash", "benchmark_id").distinct()


@query("sup_1_lookup", "select distinct shard_id, token_count, document_count from shard_manifests where shard_id = 'shard-0000003'")
def lookup(spark, folder):
    return table(spark, folder, "shard_manifests").filter("shard_id = 'shard-0000003'").select("shard_id", "token_count", "document_count").distinct()


@query("sup_2_scan_in_order", "select run_id, branch_id, global_step, shard_id from learning_ledger")
def scan_in_order(spark, folder):
    return table(spark, folder, "learning_ledger").select("run_id", "branch_id", "global_step", "shard_id").orderBy("run_id", "branch_id", "global_step", "shard_id")


# --- shards ----------------------------------------------------------------------------------------------------------------


def tokenized(spark, folder) -> DataFrame:
    """Byte tokens of each document: its length with the end token, and where the response starts (instruction lane)."""
    return hashed_corpus(spark, folder).select("document_id", "doc_id", "source", "lang", "lane", "n", "response")


_TOKEN_SQL = f"""tokens as (select document_id, doc_id, source, lang, lane, (strlen(text) + 1)::int as n, case when lane = 'instruction' then coalesce(strlen(substring(text, 1, m - 1)), 0)::int end as response
  from (select *, least({', '.join(f"nullif(instr(lower(text), '{m}'), 0)" for m in T.MARKERS)}) as m from corpus))"""


@query("tok_2_byte_tokens", f"with {_CORPUS_SQL}, {_TOKEN_SQL} select document_id, lane, n, response from tokens")
def byte_tokens(spark, folder):
    return tokenized(spark, folder).select("document_id", "lane", "n", "response")


_BINS_SQL = f"""with recursive {_CORPUS_SQL}, {_TOKEN_SQL}, d as (select *, row_number() over (partition by lane order by doc_id) as rn from tokens),
w as (select lane, rn, 0 as bin, n as used from d where rn = 1
  union all select d.lane, d.rn, case when w.used + d.n > {BUDGET} then w.bin + 1 else w.bin end, case when w.used + d.n > {BUDGET} then d.n else w.used + d.n end from w join d on d.lane = w.lane and d.rn = w.rn + 1),
b as (select d.*, w.bin from d join w on d.lane = w.lane and d.rn = w.rn),
x as (select lane, bin, row_number() over (order by lane, bin) - 1 as shard from (select distinct lane, bin from b)),
s as (select b.*, 'shard-' || lpad(shard::varchar, 6, '0') as shard_id, (sum(n) over (partition by lane, bin order by doc_id) - n)::bigint as start_token, sum(n) over (partition by lane, bin order by doc_id)::bigint as end_token from b join x using (lane, bin))"""


def shard_spans(spark, folder, policy: str = "greedy", budget: int = BUDGET) -> DataFrame:
    """Span of each document in its shard; shards are numbered over (lane, bin)."""
    docs = tokenized(spark, folder)
    pack = {"greedy": order.next_fit, "best_fit": order.best_fit}[policy]
    binned = pack(docs, "lane", "doc_id", "n", budget)
    bins = binned.groupBy("lane").agg((F.max("bin") + 1).alias("bins"))  # a row a lane
    first = bins.withColumn("first", F.coalesce(F.sum("bins").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bins")
    arrival = [F.col("doc_id")] if policy == "greedy" else [F.col("n").desc(), F.col("doc_id")]
    end = F.sum("n").over(Window.partitionBy("lane", "bin").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0))
    return (
        binned.join(F.broadcast(first), "lane")
        .withColumn("shard_id", F.format_string("shard-%06d", F.col("first") + F.col("bin")))
        .withColumn("end_token", end)
        .withColumn("start_token", F.col("end_token") - F.col("n"))
        .select("lane", "bin", "shard_id", "document_id", "doc_id", "source", "lang", "start_token", "end_token", (F.col("start_token") + F.col("response")).alias("response_start_token"))
    )


@query("shd_1_next_fit", _BINS_SQL + " select document_id, lane, bin::int as bin from s")
def next_fit(spark, folder):
    return shard_spans(spark, folder).select("document_id", "lane", "bin")


@query("shd_2_best_fit")
def best_fit(spark, folder):
    return shard_spans(spark, folder, "best_fit").select("document_id", "lane", "bin", "shard_id", "start_token", "end_token")


@query("shd_3_spans", _BINS_SQL + " select shard_id, document_id, lane, start_token, end_token, (start_token + response)::bigint as response_start_token from s")
def spans(spark, folder):
    return shard_spans(spark, folder).select("shard_id", "document_id", "lane", "start_token", "end_token", "response_start_token")


#: The end token of byte mode, after the 256 bytes.
END = 256


def shard_files(spark, folder) -> DataFrame:
    """The shards themselves as written: ``shard_id, capability_lane, data, spans``; ``data`` has two bytes a token.

    A shard holds at most BUDGET tokens (or one document), so its texts are one row; they move once, to their shard.
    """
    texts = table(spark, folder, "documents").select("doc_id", F.regexp_replace(F.hex(F.encode(T.strip(F.col("text")), "UTF-8")), "(..)", "$100").alias("hex"))
    entry = F.struct("start_token", F.concat("hex", F.lit(f"{END % 256:02X}{END // 256:02X}")).alias("hex"), "document_id", "end_token", "response_start_token")
    rows = shard_spans(spark, folder).join(texts, "doc_id").groupBy("shard_id", F.col("lane").alias("capability_lane")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    data = F.unhex(F.array_join(F.transform("e", lambda x: x["hex"]), ""))
    spans_ = F.transform("e", lambda x: F.struct(x["document_id"].alias("document_id"), x["start_token"].alias("start_token"), x["end_token"].alias("end_token"), x["response_start_token"].alias("response_start_token")))
    return rows.select("shard_id", "capability_lane", data.alias("data"), spans_.alias("document_spans"))


@query(
    "snk_5_manifests",
    _BINS_SQL
    + f", bytes as (select shard_id, s.lane as lane, s.document_id, end_token, regexp_replace(hex(encode(corpus.text)), '(..)', '\\100', 'g') || '{END % 256:02X}{END // 256:02X}' as data, start_token from s join corpus on corpus.doc_id = s.doc_id) select shard_id, min(lane) as capability_lane, 'sha256:' || sha256(unhex(string_agg(data, '' order by start_token))) as content_hash, max(end_token)::bigint as token_count, count(*) as document_count, min(document_id) as first_document from bytes group by 1",
)
def manifests(spark, folder):
    """A manifest a shard, of the shards as read back from storage: the hash is that of the stored bytes."""
    stored = materialise(shard_files(spark, folder), "shards")
    last = F.aggregate("document_spans", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x["end_token"]))
    names = F.array_min(F.transform("document_spans", lambda x: x["document_id"]))
    digest = F.concat(F.lit("sha256:"), F.sha2("data", 256))
    return stored.select("shard_id", "capability_lane", digest.alias("content_hash"), last.alias("token_count"), F.size("document_spans").cast("bigint").alias("document_count"), names.alias("first_document"))


@query("agg_4_lane_tokens", "select capability_lane, sum(token_count)::bigint as tokens from (select distinct shard_id, capability_lane, token_count from shard_manifests) group by 1")
def lane_tokens(spark, folder):
    return table(spark, folder, "shard_manifests").select("shard_id", "capability_lane", "token_count").distinct().groupBy("capability_lane").agg(F.sum("token_count").alias("tokens"))


@query(
    "agg_5_pool",
    "select capability_lane, shard_id, s.document_id as document_id, s.start_token as start_token from (select capability_lane, shard_id, unnest(document_spans) as s from (select capability_lane, shard_id, document_spans, row_number() over (partition by shard_id order by token_count) as r from shard_manifests) where r = 1)",
)
def pool(spark, folder):
    one = table(spark, folder, "shard_manifests").groupBy("shard_id").agg(F.min_by(F.struct("capability_lane", "document_spans"), "token_count").alias("m"))
    return one.select("m.capability_lane", "shard_id", F.explode("m.document_spans").alias("s")).select("capability_lane", "shard_id", "s.document_id", "s.start_token")


@query("srt_4_pool_order", _BINS_SQL + " select lane, shard_id, document_id, (row_number() over (partition by lane order by shard_id, start_token) - 1)::bigint as ordinal from s")
def pool_order(spark, folder):
    rows = shard_spans(spark, folder)
    return order.running(rows, ["lane"], ["shard_id", "start_token"], F.lit(1), F.col("shard_id"), "ordinal").select("lane", "shard_id", "document_id", "ordinal")


@query(
    "agg_6_lane_report",
    "select capability_lane, count(*) as shards, sum(token_count)::bigint as tokens, sum(document_count)::bigint as documents, round(sum(token_count) / (count(*) * 100000.0)::double, 6) as utilization from (select distinct shard_id, capability_lane, token_count, document_count from shard_manifests) group by 1",
)
def lane_report(spark, folder):
    one = table(spark, folder, "shard_manifests").select("shard_id", "capability_lane", "token_count", "document_count").distinct()
    return one.groupBy("capability_lane").agg(F.count("*").alias("shards"), F.sum("token_count").alias("tokens"), F.sum("document_count").alias("documents"), F.round(F.sum("token_count") / (F.count("*") * 100000.0), 6).alias("utilization"))


@query("jon_4_span_lookup", "select d.doc_id as doc_id, shard_id, s.start_token as start_token, s.end_token as end_token from documents d join (select distinct shard_id, unnest(document_spans) as s from shard_manifests) m on m.s.document_id = d.document_id")
def span_lookup(spark, folder):
    spans_ = table(spark, folder, "shard_manifests").select("shard_id", F.explode("document_spans").alias("s")).select("shard_id", "s.document_id", "s.start_token", "s.end_token").distinct()
    return table(spark, folder, "documents").select("doc_id", "document_id").join(spans_, "document_id").select("doc_id", "shard_id", "start_token", "end_token")


@query("str_23_span_strings", "select distinct shard_id || ':' || s.start_token || '-' || s.end_token as span, s.end_token - s.start_token as length from (select shard_id, unnest(document_spans) as s from shard_manifests) where s.start_token is not null and s.end_token is not null")
def span_strings(spark, folder):
    s = table(spark, folder, "shard_manifests").select("shard_id", F.explode("document_spans").alias("s")).filter("s.start_token is not null and s.end_token is not null")
    text = s.select(F.concat("shard_id", F.lit(":"), "s.start_token", F.lit("-"), "s.end_token").alias("span")).distinct()
    number = lambda k: F.regexp_extract("span", r"^.*:(\d+)-(\d+)$", k).cast("int")
    return text.filter("span is not null").select("span", (number(2) - number(1)).alias("length"))


@query("arr_1_slices", "select doc_id, source_document_id, array_to_string(list_slice(string_split(text, ' '), 3, 7), ' ') as slice from documents where text is not null")
def slices(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", "source_document_id", F.array_join(F.slice(F.split("text", " "), 3, 5), " ").alias("slice"))


@query("srt_3_longest_first", f"with {_CORPUS_SQL}, {_TOKEN_SQL} select document_id, n from tokens order by n desc, doc_id")
def longest_first(spark, folder):
    return tokenized(spark, folder).orderBy(F.col("n").desc(), "doc_id").select("document_id", "n")
