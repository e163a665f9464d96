"""Queries of tokenizer metrics and of vocabulary merging; tokenizers themselves are never trained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.catalog import query
from quern.runtime import materialise, table

_LANGS = ("en", "hi", "mr", "te")
_UNITS = r"[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\x{85}\x0b\p{L}\p{M}\p{N}]"
_ATOMS = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{Z}\x{85}\x0b\p{L}\p{M}\p{N}_]+"
_BASE_SQL = f"f as (select lang, sum(strlen(text))::double / sum(len(regexp_extract_all(text, '{_UNITS}'))) as ratio from documents where text is not null and lang in ('en', 'hi', 'mr', 'te') group by 1)"


def by_language(spark, folder) -> DataFrame:
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull() & F.col("lang").isin(*_LANGS))
    return rows.groupBy("lang").agg((F.sum(F.octet_length("text")) / F.sum(T.faithful_units(F.col("text")))).alias("ratio"))


def atoms(text: Column) -> Column:
    """Pre-tokens: runs of word characters and of other characters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+"), 0)


@query("agg_20_type_fertility", f"select lang, sum(strlen(atom))::bigint as tokens, count(*) as atoms, round(sum(strlen(atom)) / count(*)::double, 6) as ratio from (select distinct lang, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '{_ATOMS}')) as atom from documents where text is not null and lang in ('en', 'hi', 'mr', 'te')) group by 1")
def type_fertility(spark, folder):
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull() & F.col("lang").isin(*_LANGS))
    distinct = rows.select("lang", F.explode(atoms(F.col("text"))).alias("atom")).distinct()
    return distinct.groupBy("lang").agg(F.sum(F.octet_length("atom")).alias("tokens"), F.count("*").alias("atoms"), F.round(F.sum(F.octet_length("atom")) / F.count("*"), 6).alias("ratio"))


@query("set_2_distinct_atoms", f"select lang, count(distinct atom) as n from (select lang, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '{_ATOMS}')) as atom from documents where text is not null) group by 1")
def distinct_atoms(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null").select("lang", F.explode(atoms(F.col("text"))).alias("atom")).distinct()
    return rows.groupBy("lang").agg(F.count("*").alias("n"))


@query("agg_22_spread", f"with {_BASE_SQL} select round(max(ratio) - min(ratio), 6) as spread, round(1000 / nullif(max(ratio) - min(ratio), 0), 4) as score from f")
def spread(spark, folder):
    gap = F.max("ratio") - F.min("ratio")
    return by_language(spark, folder).agg(F.round(gap, 6).alias("spread"), F.round(F.try_divide(F.lit(1000.0), gap), 4).alias("score"))


@query("agg_23_penalty", f"with {_BASE_SQL} select round(exp(greatest(0, max(case when lang = 'hi' then ratio end) / 1.2::double - 1)), 6) as penalty, round(1000 / nullif(max(ratio) - min(ratio), 0) / exp(greatest(0, max(case when lang = 'hi' then ratio end) / 1.2::double - 1)), 4) as adjusted from f")
def penalty(spark, folder):
    hindi = F.max(F.when(F.col("lang") == "hi", F.col("ratio")))
    factor = F.exp(F.greatest(F.lit(0.0), hindi / 1.2 - 1))
    score = F.try_divide(F.lit(1000.0), F.max("ratio") - F.min("ratio"))
    return by_language(spark, folder).agg(F.round(factor, 6).alias("penalty"), F.round(score / factor, 4).alias("adjusted"))


@query("prj_21_english_cap", f"with {_BASE_SQL} select lang, ratio <= 1.2 as first, ratio < 1.2 as later from f where lang = 'en'")
def english_cap(spark, folder):
    return by_language(spark, folder).filter("lang = 'en'").select("lang", (F.col("ratio") <= 1.2).alias("first"), (F.col("ratio") < 1.2).alias("later"))


@query("srt_1_by_ratio", f"with {_BASE_SQL} select lang, (row_number() over (order by ratio desc))::int as place from f")
def by_ratio(spark, folder):
    return by_language(spark, folder).select("lang", F.row_number().over(Window.orderBy(F.col("ratio").desc())).alias("place"))


@query("sup_12_worst_of_group", f"with {_BASE_SQL} select case when lang in ('hi', 'mr') then 'hi+mr' else lang end as grp, round(max(ratio), 6) as worst from f group by 1")
def worst_of_group(spark, folder):
    group = F.when(F.col("lang").isin("hi", "mr"), "hi+mr").otherwise(F.col("lang"))
    return by_language(spark, folder).groupBy(group.alias("grp")).agg(F.round(F.max("ratio"), 6).alias("worst"))


@query("srt_9_best_weight", f"with {_BASE_SQL}, w as (select k, max(abs(ratio - k)) as worst from f, range(1, 30) t(k) group by 1) select arg_min(k, (worst, k)) as best from w")
def best_weight(spark, folder):
    weights = spark.range(1, 30).withColumnRenamed("id", "k")
    tried = by_language(spark, folder).join(F.broadcast(weights), how="cross").groupBy("k").agg(F.max(F.abs(F.col("ratio") - F.col("k"))).alias("worst"))
    return tried.agg(F.min_by("k", F.struct("worst", "k")).alias("best"))


@query("sup_22_result_table", f"with {_BASE_SQL} select round(max(case when lang = 'en' then ratio end), 6) as en, round(max(case when lang = 'hi' then ratio end), 6) as hi, round(max(case when lang = 'te' then ratio end), 6) as te, round(max(case when lang = 'mr' then ratio end), 6) as mr from f")
def result_table(spark, folder):
    order = ("en", "hi", "te", "mr")
    return by_language(spark, folder).agg(*[F.round(F.max(F.when(F.col("lang") == k, F.col("ratio"))), 6).alias(k) for k in order])


def merge_vocabularies(groups: DataFrame) -> DataFrame:
    """One vocabulary of several groups' tokens (``grp, rank, token``): the first group, then the first rank, wins."""
    first = groups.groupBy("token").agg(F.min(F.struct("grp", "rank")).alias("at"))
    return first.select("token", F.col("at.grp").alias("grp"), F.col("at.rank").alias("rank"))


_GROUP_SQL = f"g as (select case lang when 'en' then 0 when 'hi' then 1 when 'mr' then 1 else 2 end as grp, token, min(doc_id) as rank from (select lang, doc_id, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '{_ATOMS}')) as token from documents where text is not null and lang in ('en', 'hi', 'mr', 'te')) group by all)"


def token_groups(spark, folder) -> DataFrame:
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull() & F.col("lang").isin(*_LANGS))
    group = F.when(F.col("lang") == "en", 0).when(F.col("lang").isin("hi", "mr"), 1).otherwise(2)
    return rows.select(group.alias("grp"), "doc_id", F.explode(atoms(F.col("text"))).alias("token")).groupBy("grp", "token").agg(F.min("doc_id").alias("rank"))


@query("tok_7_merged_vocabulary", f"with {_GROUP_SQL} select token, grp, rank from (select *, row_number() over (partition by token order by grp, rank) as r from g) where r = 1")
def merged_vocabulary(spark, folder):
    return merge_vocabularies(token_groups(spark, folder))


def script(char: str = "token") -> dict[str, Column]:
    """Scripts of a token by its letters (vowel signs are no letters)."""
    return {name: F.col(char).rlike(rf"[\p{{L}}&&\p{{Is{name}}}]") for name in ("Devanagari", "Telugu", "Latin")}


_CLASS_SQL = r"case when d + t + l + o = 0 then 'common' when d + t + l + o > 1 then 'mixed' when d = 1 then 'Devanagari' when t = 1 then 'Telugu' when l = 1 then 'Latin' else 'Other' end"
_FLAG_SQL = r"(select token, regexp_matches(token, '[\x{0904}-\x{0939}\x{093d}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097f}]')::int as d, regexp_matches(token, '[\x{0c05}-\x{0c39}\x{0c3d}\x{0c58}-\x{0c61}]')::int as t, regexp_matches(token, '\p{Latin}')::int as l, regexp_matches(regexp_replace(token, '[\x{0900}-\x{097f}\x{0c00}-\x{0c7f}\p{Latin}]', '', 'g'), '\p{L}')::int as o from g)"


def classes(tokens: DataFrame) -> DataFrame:
    flags = script()
    other = F.regexp_replace("token", r"[\p{IsDevanagari}\p{IsTelugu}\p{IsLatin}]", "").rlike(r"\p{L}")
    count = sum((f.cast("int") for f in (*flags.values(), other)), F.lit(0))
    named = F.when(count == 0, "common").when(count > 1, "mixed")
    for name, flag in flags.items():
        named = named.when(flag, name)
    return tokens.withColumn("script", named.otherwise("Other"))


@query("agg_24_script_classes", f"with {_GROUP_SQL}, c as (select token, {_CLASS_SQL} as script from {_FLAG_SQL}) select script, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as percent, case when script = 'mixed' then array_to_string(list_slice(list_sort(list_distinct(list(token))), 1, 20), ' ') end as examples from c group by 1")
def script_classes(spark, folder):
    """Tokens by class of script, with the first 20 mixed ones as examples (of which each task keeps 20)."""
    tokens = materialise(classes(token_groups(spark, folder)).select("token", "script"), "classes")
    rows = tokens.groupBy("script").agg(F.count("*").alias("n"))
    first = tokens.filter("script = 'mixed'").select("token").distinct().orderBy("token").limit(20).agg(F.lit("mixed").alias("script"), F.array_join(F.array_sort(F.collect_list("token")), " ").alias("examples"))
    counted = rows.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))  # a row a class
    return counted.join(F.broadcast(first), "script", "left")


@query("prj_20_token_class", f"with {_GROUP_SQL} select distinct token, {_CLASS_SQL} as script from {_FLAG_SQL}")
def token_class(spark, folder):
    return classes(token_groups(spark, folder)).select("token", "script").distinct()


@query("agg_25_pair_counts", "select a, b, count(*) as n from (select substring(w, i, 1) as a, substring(w, i + 1, 1) as b from (select w, unnest(range(1, length(w)::bigint)) as i from (select unnest(string_split(text, ' ')) as w from documents where text is not null) where length(w) >= 2)) group by all")
def pair_counts(spark, folder):
    """Counts of neighbouring characters of words: of each different word once, times its frequency."""
    words = table(spark, folder, "documents").filter("text is not null").select(F.explode(F.split("text", " ", -1)).alias("w")).filter("length(w) >= 2")
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    pairs = counted.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.struct(F.substr("w", i, F.lit(1)).alias("a"), F.substr("w", i + 1, F.lit(1)).alias("b")))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


_MERGE_SQL = r"""m as (select distinct substring(token, 1, 1) as a, substring(token, 2) as b from g where length(token) >= 2),
f as (select a, b, list_distinct(list_concat(sa, sb)) as scripts from (select a, b, sa, sb from m join (select token as a, scripts as sa from x) using (a) join (select token as b, scripts as sb from x) using (b)))"""
_SETS_SQL = r"""x as (select token, list_filter([case when regexp_matches(token, '[\x{0904}-\x{0939}\x{093d}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097f}]') then 'Devanagari' end, case when regexp_matches(token, '[\x{0c05}-\x{0c39}\x{0c3d}\x{0c58}-\x{0c61}]') then 'Telugu' end, case when regexp_matches(token, '\p{Latin}') then 'Latin' end], lambda s: s is not null) as scripts from (select a as token from m0 union select b from m0))"""


def script_set(token: str) -> Column:
    """The scripts of a token's letters."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in script(token).items()]))


@query(
    "set_6_script_union",
    f"with {_GROUP_SQL}, m0 as (select distinct substring(token, 1, 1) as a, substring(token, 2) as b from g where length(token) >= 2), {_SETS_SQL}, {_MERGE_SQL} select array_to_string(list_sort(scripts), '+') as scripts, count(*) as merges from f group by 1",
)
def script_union(spark, folder):
    """Merges (a token's first character and the rest) by the union of both sides' scripts."""
    merges = token_groups(spark, folder).filter("length(token) >= 2").select(F.substring("token", 1, 1).alias("a"), F.expr("substring(token, 2)").alias("b")).distinct()
    union = F.array_union(script_set("a"), script_set("b"))
    return merges.groupBy(F.array_join(F.array_sort(union), "+").alias("scripts")).agg(F.count("*").alias("merges"))


@query("set_1_union_of_lanes", "select lane from (select distinct capability_lane as lane from shard_manifests union select distinct k from (select unnest(map_keys(mixture)) as k from mixture_stages)) where lane is not null")
def union_of_lanes(spark, folder):
    stored = table(spark, folder, "shard_manifests").select(F.col("capability_lane").alias("lane"))
    planned = table(spark, folder, "mixture_stages").select(F.explode(F.map_keys("mixture")).alias("lane"))
    return stored.union(planned).distinct().filter("lane is not null")
