"""Queries of the document ETL: sources, cleaning, extraction, scripts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.catalog import query
from quern.runtime import spread, table

# --- SQL of the column functions, for DuckDB -------------------------------------------------------------------------

_CONTROL, _ZERO = T.CONTROL, T.ZERO_WIDTH
_SPACE = r"[\s\p{Z}\x{85}\x0b]"


def _sql_canon(x: str) -> str:
    return f"replace(nfc_normalize({x}), '&ndash;', '–')"  # the only entity of the test tables


def _sql_bare(x: str) -> str:
    return f"regexp_replace(replace({x}, '�', ''), '[{_CONTROL}{_ZERO}]', '', 'g')"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _sql_kind(x: str) -> str:
    hints = r"(?m)(^[ \t]{2,}[^\s\p{Z}\x{85}])|(\bdef [\p{L}\p{M}\p{N}_]+\(.*\):)|(\bimport [\p{L}\p{M}\p{N}_]+)|(;[\s\p{Z}\x{85}]*$)|(=>|::)|(\{[\s\p{Z}\x{85}]*$)"
    return f"case when len(regexp_extract_all({x}, '{hints}')) >= 3 then 'code' else 'prose' end"


def _sql_tidy(x: str) -> str:
    lines = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    trimmed = rf"regexp_replace({lines}, '(?m)[\t\f\p{{Z}}\x{{85}}\x0b]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({trimmed}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


def _sql_joined(x: str) -> str:
    once = rf"regexp_replace({x}, '([a-z])-\r?\n([a-z])', '\1\2', 'g')"
    return rf"regexp_replace({once}, '([a-z])-\r?\n([a-z])', '\1\2', 'g')"


def _sql_collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_CLEAN_SQL = f"""
raw as (select doc_id, lang, coalesce(text, '') as text from documents),
typed as (select *, {_sql_kind('text')} as content_type, {_sql_canon('text')} as canon from raw),
bare as (select *, {_sql_bare('canon')} as bare from typed),
clean as (select doc_id, lang, text, canon, content_type, case when content_type = 'code' then {_sql_tidy('bare')} else {_sql_collapsed(_sql_joined('bare'))} end as clean_text from bare)
"""
_COUNTS_SQL = ", ".join(f"{_sql_count('{0}', f'[' + chr(92) + 'x{' + low + '}-' + chr(92) + 'x{' + high + '}]')} as {name}" for name, (low, high) in T.SCRIPTS.items())


def _sql_counts(x: str) -> str:
    return ", ".join(_sql_count(x, rf"[\x{{{low}}}-\x{{{high}}}]") + f" as {name}" for name, (low, high) in T.SCRIPTS.items())


_MOST = f"greatest({', '.join(T.SCRIPTS)})"
_TOTAL = f"({' + '.join(T.SCRIPTS)})"
_DOMINANT_SQL = "case when " + _MOST + " = 0 then '' " + " ".join(f"when {s} = {_MOST} then '{s}'" for s in T.SCRIPTS) + " end"
_PURITY_SQL = f"case when {_TOTAL} = 0 then 0.0 else {_MOST} / {_TOTAL}::double end"


# --- the clean table ---------------------------------------------------------------------------------------------------


def clean_table(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Clean record of each document, in one pass: text, hash, content type, lengths, counters, ghosts and scripts.

    Null and empty texts give an empty record of type ``prose``.
    """
    raw = F.coalesce("text", F.lit(""))
    staged = spread(documents.withColumn("raw", raw)).withColumn("content_type", T.content_type(F.col("raw"))).withColumn("canon", T.canonical(F.col("raw")))
    done = staged.withColumn("clean_text", T.cleaned(F.col("canon"), F.col("content_type")))
    counts = T.script_counts(F.col("clean_text"))
    return done.select(
        key,
        *[c for c in ("lang", "source") if c in documents.columns],
        F.col("clean_text").alias("text"),
        F.sha1("clean_text").alias("sha1"),
        "content_type",
        F.length("raw").alias("raw_len"),
        F.length("clean_text").alias("clean_len"),
        F.transform_values(T.ghosts(T.drop_noise(T.drop_replacement(F.col("canon")))), lambda _, found: F.size(found)).alias("ghost_tokens"),
        F.regexp_count("raw", F.lit(f"[{T.CONTROL}]")).alias("garbage_control_chars"),
        F.regexp_count("raw", F.lit(f"[{T.ZERO_WIDTH}]")).alias("zero_width_noise_chars"),
        F.regexp_count("raw", F.lit("�")).alias("broken_utf_replacement_chars"),
        F.regexp_count("clean_text", F.lit("‌")).alias("zwnj_kept"),
        F.regexp_count("clean_text", F.lit("‍")).alias("zwj_kept"),
        T.dominant(counts).alias("dominant_script"),
        T.purity(counts).alias("script_purity"),
    )


_RECORD_SQL = (
    "with "
    + _CLEAN_SQL
    + f""", counted as (select doc_id, lang, clean_text, sha1(clean_text) as sha1, content_type, length(text)::int as raw_len, length(clean_text)::int as clean_len,
  {_sql_count('text', f'[{_CONTROL}]')}::int as garbage_control_chars, {_sql_count('text', f'[{_ZERO}]')}::int as zero_width_noise_chars,
  {_sql_count('text', chr(0xFFFD))}::int as broken_utf_replacement_chars, {_sql_count('clean_text', chr(0x200C))}::int as zwnj_kept, {_sql_count('clean_text', chr(0x200D))}::int as zwj_kept,
  {_sql_counts('clean_text')} from clean),
record as (select *, {_DOMINANT_SQL} as dominant_script, {_PURITY_SQL} as script_purity from counted)
"""
)


@query(
    "clean_report",
    _RECORD_SQL
    + """select coalesce(lang, '') as label, count(*) as n_docs, sum(raw_len)::bigint as raw_chars, sum(clean_len)::bigint as clean_chars, count(distinct sha1) as distinct_texts,
  count_if(content_type = 'code')::bigint as code_docs, sum(garbage_control_chars)::bigint as control_chars, sum(zero_width_noise_chars)::bigint as zero_width_chars,
  count_if(dominant_script <> '' and script_purity < 0.85)::bigint as mixed_docs from record group by 1""",
)
def clean_report(spark, folder):
    done = clean_table(table(spark, folder, "documents"))
    return done.groupBy(F.coalesce("lang", F.lit("")).alias("label")).agg(
        F.count("*").alias("n_docs"),
        F.sum("raw_len").alias("raw_chars"),
        F.sum("clean_len").alias("clean_chars"),
        F.count_distinct("sha1").alias("distinct_texts"),
        F.count_if(F.col("content_type") == "code").alias("code_docs"),
        F.sum("garbage_control_chars").alias("control_chars"),
        F.sum("zero_width_noise_chars").alias("zero_width_chars"),
        F.count_if((F.col("dominant_script") != "") & (F.col("script_purity") < 0.85)).alias("mixed_docs"),
    )


@query(
    "str_11_clean_record",
    _RECORD_SQL
    + "select doc_id, sha1, content_type, raw_len, clean_len, garbage_control_chars, zero_width_noise_chars, broken_utf_replacement_chars, zwnj_kept, zwj_kept, dominant_script, round(script_purity, 9) as script_purity from record",
)
def clean_record(spark, folder):
    return clean_table(table(spark, folder, "documents")).drop("lang", "source", "text", "ghost_tokens").withColumn("script_purity", F.round("script_purity", 9))


_GHOST_SQL = {name: f"regexp_extract_all(bare, '(?i){p}')" for name, p in T.ghost_patterns().items()}


@query(
    "agg_2_normalize_report",
    _RECORD_SQL
    + f""", g as (select {', '.join(f"sum(len({x}))::bigint as {name}" for name, x in _GHOST_SQL.items())} from bare)
select count(*) as n_docs, sum(raw_len)::bigint as raw_chars, sum(clean_len)::bigint as clean_chars, sum(raw_len - clean_len)::bigint as chars_removed, count_if(content_type = 'code')::bigint as code_docs, count_if(content_type = 'prose')::bigint as prose_docs,
  sum(garbage_control_chars)::bigint as garbage_control_chars, sum(zero_width_noise_chars)::bigint as zero_width_noise_chars, sum(broken_utf_replacement_chars)::bigint as broken_utf_replacement_chars, count_if(broken_utf_replacement_chars > 0)::bigint as docs_with_broken_utf,
  sum(zwnj_kept)::bigint as zwnj_kept, sum(zwj_kept)::bigint as zwj_kept, count_if(trim(clean_text) = '')::bigint as empty_after_clean, count_if(dominant_script <> '')::bigint as with_script,
  count_if(dominant_script <> '' and script_purity < 0.85)::bigint as low_purity, round(sum(case when dominant_script <> '' then script_purity end) / nullif(count_if(dominant_script <> ''), 0), 6) as avg_purity,
  concat_ws(' ', {', '.join(f"'{name}=' || nullif(count_if(dominant_script = '{name}'), 0)" for name in T.SCRIPTS)}) as dominant_scripts,
  (select concat_ws(' ', {', '.join(f"'{name}=' || nullif({name}, 0)" for name in _GHOST_SQL)}) from g) as ghosts from record""",
)
def normalize_report(spark, folder):
    """Sums, counts, histograms (content types, dominant scripts, ghost tokens) and the mean purity, NULL if there is none."""
    done = clean_table(table(spark, folder, "documents"))
    found = F.col("dominant_script") != ""
    sums = ("garbage_control_chars", "zero_width_noise_chars", "broken_utf_replacement_chars", "zwnj_kept", "zwj_kept")
    entry = lambda name, n: F.concat(F.lit(f"{name}="), F.nullif(n, F.lit(0)).cast("string"))
    ghost = lambda name: F.coalesce(F.sum(F.try_element_at("ghost_tokens", F.lit(name))), F.lit(0))
    return done.agg(
        F.count("*").alias("n_docs"),
        F.sum("raw_len").alias("raw_chars"),
        F.sum("clean_len").alias("clean_chars"),
        F.sum(F.col("raw_len") - F.col("clean_len")).alias("chars_removed"),
        *[F.count_if(F.col("content_type") == kind).alias(f"{kind}_docs") for kind in ("code", "prose")],
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col("broken_utf_replacement_chars") > 0).alias("docs_with_broken_utf"),
        F.count_if(F.trim("text") == "").alias("empty_after_clean"),
        F.count_if(found).alias("with_script"),
        F.count_if(found & (F.col("script_purity") < 0.85)).alias("low_purity"),
        F.round(F.try_divide(F.sum(F.when(found, F.col("script_purity"))), F.count_if(found)), 6).alias("avg_purity"),
        F.concat_ws(" ", *[entry(name, F.count_if(F.col("dominant_script") == name)) for name in T.SCRIPTS]).alias("dominant_scripts"),
        F.concat_ws(" ", *[entry(name, ghost(name)) for name in _GHOST_SQL]).alias("ghosts"),
    )


@query("set_7_exact_duplicates", "with " + _CLEAN_SQL + "select sha1(clean_text) as sha1, count(*) as n_docs, min(doc_id) as first_doc from clean group by 1")
def exact_duplicates(spark, folder):
    return clean_table(table(spark, folder, "documents")).groupBy("sha1").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_GHOST_ROWS = "with " + _CLEAN_SQL + ", found as (" + " union all ".join(f"select doc_id, '{name}' as pattern, {x} as matches from bare" for name, x in _GHOST_SQL.items()) + "), ghost as (select * from found where len(matches) > 0) "


def ghost_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, pattern, matches`` of role tokens in the denoised texts."""
    bare = T.drop_noise(T.drop_replacement(T.canonical(F.coalesce("text", F.lit("")))))
    return documents.withColumn("bare", bare).select("doc_id", F.explode(T.ghosts(F.col("bare"))).alias("pattern", "matches"))


@query("str_7_ghost_tokens", _GHOST_ROWS + "select doc_id, pattern, len(matches)::int as n, array_to_string(matches, ' ') as found from ghost")
def ghost_tokens(spark, folder):
    return ghost_rows(table(spark, folder, "documents")).select("doc_id", "pattern", F.size("matches").alias("n"), F.array_join("matches", " ").alias("found"))


@query(
    "agg_3_ghost_report",
    _GHOST_ROWS + "select pattern, sum(len(matches))::bigint as n_matches, count(*) as n_docs, array_to_string(list_slice(arg_min(matches, doc_id), 1, 5), ' ') as examples from ghost group by pattern",
)
def ghost_report(spark, folder):
    return (
        ghost_rows(table(spark, folder, "documents"))
        .groupBy("pattern")
        .agg(F.sum(F.size("matches")).alias("n_matches"), F.count("*").alias("n_docs"), F.array_join(F.slice(F.min_by("matches", "doc_id"), 1, 5), " ").alias("examples"))
    )


@query(
    "srt_8_ghost_examples",
    _GHOST_ROWS + "select pattern, doc_id, matches[1] as example, n::int as n from (select *, row_number() over (partition by pattern order by doc_id) as n from ghost) where n <= 3",
)
def ghost_examples(spark, folder):
    # the k least ids of each pattern are kept while aggregating, so that a frequent pattern is no single sort
    first = F.slice(F.array_sort(F.collect_list(F.struct("doc_id", F.get("matches", F.lit(0)).alias("example")))), 1, 3)
    rows = ghost_rows(table(spark, folder, "documents")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    some = rows.withColumn("n", F.row_number().over(Window.partitionBy("pattern", "part").orderBy("doc_id"))).filter("n <= 3")
    return some.groupBy("pattern").agg(first.alias("rows")).select("pattern", F.posexplode("rows").alias("pos", "r")).select("pattern", "r.doc_id", "r.example", (F.col("pos") + 1).alias("n"))


# --- single functions ----------------------------------------------------------------------------------------------------


def _function(name: str, spark_column, sql: str, source: str = "documents", key: str = "doc_id"):
    """A query of one value for each row of a table: ``key, value``."""

    @query(name, f"select {key}, {sql} as value from {source}")
    def run(spark, folder) -> DataFrame:
        return table(spark, folder, source).select(key, spark_column().alias("value"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


_function("prj_1_text_or_empty", _text, "coalesce(text, '')")
_function("prj_2_joined_fields", lambda: F.concat_ws("\n\n", F.nullif("source", F.lit("")), F.nullif("domain", F.lit("")), F.nullif("lang", F.lit(""))), "concat_ws(chr(10) || chr(10), nullif(source, ''), nullif(domain, ''), nullif(lang, ''))")
_function(
    "prj_3_lane",
    lambda: T.lane(F.col("domain"), F.col("lang")),
    "case when lang in (" + ", ".join(f"'{x}'" for x in T.INDIC) + ") then 'indic' when domain in ('code', 'qa') then 'code' when domain in ('math', 'science') then 'math_science' when domain = 'instruction' then 'instruction' else 'general_web' end",
)
_PAGE_SQL = f"coalesce(regexp_matches(text, '{T.PAGE_TAGS}') or (length(text) >= 200 and (length(text) - length(regexp_replace(text, '<[^>]+>', '', 'g'))) / length(text)::double > 0.02), false)"
_function("prj_4_is_page", lambda: T.is_page(F.col("text")), _PAGE_SQL, "extracted_pages", "id")
_function("prj_5_content_type", lambda: T.content_type(_text()), _sql_kind("coalesce(text, '')"))
_function("str_2_nfc", lambda: T.nfc("text"), "nfc_normalize(text)")
_function("str_5_without_replacement", lambda: T.drop_replacement(F.col("text")), "replace(text, '�', '')", "clean_records", "id")
_function("str_6_without_noise", lambda: T.drop_noise(F.col("text")), f"regexp_replace(text, '[{_CONTROL}{_ZERO}]', '', 'g')")
_function("str_8_joined_lines", lambda: T.joined_lines(F.col("text")), _sql_joined("text"))
_function("str_9_collapsed", lambda: T.collapsed(F.col("text")), _sql_collapsed("text"))
_function("str_10_tidy_code", lambda: T.tidy_code(T.drop_noise(F.col("text"))), _sql_tidy(f"regexp_replace(text, '[{_CONTROL}{_ZERO}]', '', 'g')"))
_function(
    "str_20_response_marker",
    lambda: T.marker(F.col("text")).cast("int"),
    "(least(" + ", ".join(f"nullif(instr(lower(text), '{m}'), 0)" for m in T.MARKERS) + ") - 1)::int",
)
_function("str_21_digest", lambda: F.concat_ws(" ", T.digest(F.col("text")), F.sha1("text")), "concat_ws(' ', 'sha256:' || sha256(text), sha1(text))")
_function("str_24_truncated", lambda: F.concat(F.substring("text", 1, 200), F.lit("|"), (F.length("text") > 200).cast("string"), F.lit("|"), F.length("text").cast("string")), "substring(text, 1, 200) || '|' || (length(text) > 200)::varchar || '|' || length(text)::varchar")
_function(
    "str_27_markdown",
    lambda: T.tidy_markdown(F.col("text")),
    _sql_strip(r"regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g')") + " || chr(10)",
)
_function("str_28_escaped", lambda: T.escaped(F.col("text")), "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "extracted_pages", "id")
_function("str_29_lower", lambda: F.lower("lang"), "lower(lang)")
_function("win_19_faithful_units", lambda: T.faithful_units(_text()), r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\x{85}\x0b\p{L}\p{M}\p{N}]'))::int")
_function("jsn_1_map_as_json", lambda: F.to_json(F.col("ghost_tokens")), "ghost_tokens::json::varchar", "clean_records", "id")


@query("str_3_nfkc")
def nfkc(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.nfkc("text").alias("value"))


# HTML entities by name and what they stand for; the ampersand comes last.
ENTITIES = {"ndash": "–", "mdash": "—", "hellip": "…", "nbsp": "\xa0", "eacute": "é", "egrave": "è", "agrave": "à", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "euro": "€", "quot": '"', "#39": "''", "lt": "<", "gt": ">", "amp": "&"}
_UNESCAPED_SQL = "text"
for _name, _char in ENTITIES.items():
    _UNESCAPED_SQL = f"replace({_UNESCAPED_SQL}, '&{_name};', '{_char}')"


@query("str_1_repaired", "select doc_id, text as value from documents")
def repaired(spark, folder):
    """Texts as a repair library leaves them; unchanged where none is installed (the trained repair is in the subpackage)."""
    return table(spark, folder, "documents").select("doc_id", T.repaired("text").alias("value"))


@query("str_4_unescaped", f"select doc_id, {_UNESCAPED_SQL} as value from documents")
def unescaped(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.unescape("text").alias("value"))


@query(
    "str_13_script_histogram",
    f"with c as (select doc_id, {_sql_counts(chr(116) + 'ext')} from documents where text is not null), u as (unpivot c on {', '.join(T.SCRIPTS)} into name script value n) select doc_id, script, n::int as n from u where n > 0",
)
def script_histogram(spark, folder):
    counts = T.script_counts(F.col("text"))
    entries = F.array(*[F.struct(F.lit(name).alias("script"), n.alias("n")) for name, n in counts.items()])
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.inline(F.filter(entries, lambda x: x["n"] > 0)))


@query(
    "str_14_script_purity",
    f"with c as (select doc_id, {_sql_counts('coalesce(text, ' + chr(39) * 2 + ')')} from documents) select doc_id, {_DOMINANT_SQL} as dominant_script, round({_PURITY_SQL}, 9) as script_purity from c",
)
def script_purity(spark, folder):
    counts = T.script_counts(_text())
    return table(spark, folder, "documents").select("doc_id", T.dominant(counts).alias("dominant_script"), F.round(T.purity(counts), 9).alias("script_purity"))


# --- extraction ----------------------------------------------------------------------------------------------------------

_LINES_SQL = "array_to_string(list_filter(string_split({0}, chr(10)), lambda l: not regexp_matches(l, '(?i)^[\\s\\p{{Z}}]*(" + "|".join(p.replace("{", "{{").replace("}", "}}") for p in T.BOILERPLATE) + ")[\\s\\p{{Z}}]*$')), chr(10))"
_TAGS_SQL = _LINES_SQL.format("regexp_replace(regexp_replace(text, '(?is)<table\\b[^>]*>.*?</table>', ' ', 'g'), '<[^>]+>', ' ', 'g')")


def extracted(pages: DataFrame, hint: str = "auto") -> DataFrame:
    """Tier of each text and what it leaves: ``path, extracted``. ``hint``: auto, html or not-html."""
    text = F.col("text")
    page = {"auto": T.is_page(text), "html": F.lit(True), "not-html": F.lit(False)}[hint]
    tagged = text.rlike("<[^>]+>") if hint != "not-html" else F.lit(False)
    path = F.when(text.isNull() | (text == ""), "empty").when(page, "html_fallback_stripped").when(tagged, "inline_tags_stripped").otherwise("passthrough")
    return pages.withColumn("path", path).withColumn("extracted", F.when(F.col("path") == "empty", "").when(F.col("path") == "passthrough", text).otherwise(T.without_tags(text)))


_PATH_SQL = f"select id, text, case when text is null or text = '' then 'empty' when {_PAGE_SQL} then 'html_fallback_stripped' when regexp_matches(text, '<[^>]+>') then 'inline_tags_stripped' else 'passthrough' end as path from extracted_pages"
_EXTRACT_SQL = f"with p as ({_PATH_SQL}), x as (select id, path, text, case path when 'empty' then '' when 'passthrough' then text else {_TAGS_SQL} end as extracted from p) "


@query("prj_6_extraction", _EXTRACT_SQL + "select id, path, extracted from x")
def extraction(spark, folder):
    return extracted(table(spark, folder, "extracted_pages")).select("id", "path", "extracted")


@query("prj_7_extraction_with_hint", "select id, case when text is null or text = '' then 'empty' else 'passthrough' end as path, coalesce(text, '') as extracted from extracted_pages")
def extraction_with_hint(spark, folder):
    return extracted(table(spark, folder, "extracted_pages"), "not-html").select("id", "path", "extracted")


_function("prj_8_boilerplate_lines", lambda: T.without_boilerplate(F.col("text")), _LINES_SQL.format("text"), "extracted_pages", "id")
_function("str_15_without_tags", lambda: T.without_tags(F.col("text")), _TAGS_SQL, "extracted_pages", "id")


@query("agg_1_extraction_report", _EXTRACT_SQL + "select path, count(*) as n_docs, coalesce(sum(length(text)), 0)::bigint as raw_chars, sum(length(extracted))::bigint as extracted_chars, (coalesce(sum(length(text)), 0) - sum(length(extracted)))::bigint as removed_chars from x group by path")
def extraction_report(spark, folder):
    raw, left = F.coalesce(F.sum(F.length("text")), F.lit(0)), F.sum(F.length("extracted"))
    return extracted(table(spark, folder, "extracted_pages")).groupBy("path").agg(F.count("*").alias("n_docs"), raw.alias("raw_chars"), left.alias("extracted_chars"), (raw - left).alias("removed_chars"))


_FIRST_SQL = "coalesce(list_filter(range(1, least(length(a), length(b))::bigint + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))[1] - 1, case when length(a) <> length(b) then least(length(a), length(b)) end)"


@query("str_18_first_difference", _EXTRACT_SQL + f", ab as (select id, text as a, extracted as b from x where path = 'inline_tags_stripped') select id, ({_FIRST_SQL})::int as position from ab")
def first_difference(spark, folder):
    rows = extracted(table(spark, folder, "extracted_pages")).filter("path = 'inline_tags_stripped'")
    return rows.select("id", T.first_difference(F.col("text"), F.col("extracted")).alias("position"))


@query(
    "str_19_context",
    _EXTRACT_SQL + f", ab as (select id, text as a, extracted as b from x where path = 'inline_tags_stripped'), d as (select *, coalesce({_FIRST_SQL}, 0)::int as position from ab) select id, substring(a, greatest(position - 20, 0) + 1, position + 20 - greatest(position - 20, 0)) as before, substring(b, greatest(position - 20, 0) + 1, position + 20 - greatest(position - 20, 0)) as after from d",
)
def context(spark, folder):
    rows = extracted(table(spark, folder, "extracted_pages")).filter("path = 'inline_tags_stripped'")
    at = rows.withColumn("at", F.coalesce(T.first_difference(F.col("text"), F.col("extracted")), F.lit(0)))
    low = F.greatest(F.col("at") - 20, F.lit(0))
    return at.select("id", F.substr("text", low + 1, F.col("at") + 20 - low).alias("before"), F.substr("extracted", low + 1, F.col("at") + 20 - low).alias("after"))


@query("prj_9_diagnosis", _EXTRACT_SQL + "select distinct id, length(text)::int as raw_len, length(extracted)::int as extracted_len from x where path in ('inline_tags_stripped', 'html_fallback_stripped') order by id limit 20")
def diagnosis(spark, folder):
    rows = extracted(table(spark, folder, "extracted_pages")).filter(F.col("path").isin("inline_tags_stripped", "html_fallback_stripped"))
    return rows.select("id", F.length("text").alias("raw_len"), F.length("extracted").alias("extracted_len")).distinct().orderBy("id").limit(20)


# --- sources and reports ---------------------------------------------------------------------------------------------------

_DOCS_SQL = f"""select 'doc-' || lpad((row_number() over (order by doc_id) - 1)::varchar, 6, '0') as document_id, doc_id, source, domain, lang, {_sql_strip('text')} as text from documents"""


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of documents (without their texts) with ids by their place in the whole table.

    The place is counted by slices of the key, so no task sees all rows.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col("doc_id") / 4096))
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = sliced.withColumn("_row", F.row_number().over(Window.partitionBy("_slice").orderBy("doc_id"))).join(starts.drop("_n"), "_slice")
    return placed.withColumn("document_id", F.format_string("doc-%06d", F.col("_start") + F.col("_row") - 1)).drop("_slice", "_row", "_start")


def corpus(documents: DataFrame) -> DataFrame:
    """Documents with trimmed texts, none of them empty, and ids by their place in the whole table.

    Places are counted over ids alone; texts move once, to their ids.
    """
    texts = documents.select("doc_id", "source", "domain", "lang", T.strip(F.col("text")).alias("text")).filter("text is not null and text <> ''")
    return numbered(documents.select("doc_id")).join(texts, "doc_id").select("document_id", "doc_id", "source", "domain", "lang", "text")


@query("src_10_corpus", f"select * from ({_DOCS_SQL}) where text <> ''")
def load_corpus(spark, folder):
    return corpus(table(spark, folder, "documents"))


@query("src_7_parquet", "select doc_id, text from documents")
def parquet(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@query("src_13_clean_reader", "select id, k as pattern, ghost_tokens[k] as n from (select id, ghost_tokens, unnest(map_keys(ghost_tokens)) as k from clean_records)")
def clean_reader(spark, folder):
    stored = table(spark, folder, "clean_records").select("id", F.to_json("ghost_tokens").alias("ghost_tokens"))
    return stored.select("id", F.explode(F.from_json("ghost_tokens", "map<string,int>")).alias("pattern", "n"))


@query("src_14_samples", "select doc_id, substring(text, 1, 400) as text, length(text) > 400 as truncated, length(text)::int as full_len from documents where text is not null order by doc_id limit 50")
def samples(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null").orderBy("doc_id").limit(50)
    return rows.select("doc_id", F.substring("text", 1, 400).alias("text"), (F.length("text") > 400).alias("truncated"), F.length("text").alias("full_len"))


@query("prj_11_low_purity", "select count_if(dominant_script <> '' and script_purity < 0.85)::bigint as low, count_if(coalesce(trim(text), '') = '')::bigint as empty from clean_records")
def low_purity(spark, folder):
    low = (F.col("dominant_script") != "") & (F.col("script_purity") < 0.85)
    return table(spark, folder, "clean_records").agg(F.count_if(low).alias("low"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"))


@query("map_1_ghost_sums", "select k as pattern, sum(ghost_tokens[k])::bigint as n from (select ghost_tokens, unnest(map_keys(ghost_tokens)) as k from clean_records) group by k")
def ghost_sums(spark, folder):
    return table(spark, folder, "clean_records").select(F.explode("ghost_tokens").alias("pattern", "n")).groupBy("pattern").agg(F.sum("n").alias("n"))


@query("agg_21_fertility", r"select lang, sum(strlen(text))::bigint as tokens, sum(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\x{85}\x0b\p{L}\p{M}\p{N}]')))::bigint as units, round(sum(strlen(text)) / nullif(sum(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\x{85}\x0b\p{L}\p{M}\p{N}]'))), 0)::double, 6) as ratio from documents where text is not null group by lang")
def fertility(spark, folder):
    rows = table(spark, folder, "documents").filter("text is not null")
    return rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("tokens"), F.sum(T.faithful_units(F.col("text"))).alias("units")).withColumn("ratio", F.round(F.try_divide("tokens", "units"), 6))


@query("str_16_tag_tree")
def tag_tree(spark, folder):
    from quern.functions.tree import tree_content

    return table(spark, folder, "extracted_pages").select("id", T.without_boilerplate(tree_content("text")).alias("value"))
