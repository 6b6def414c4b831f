"""Queries of canonical text and scalar functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import numbers as N
from scriptoria.functions import text as T
from scriptoria.plans.registry import query, table

MESSY = "chr(65279) || chr(10) || replace(replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10)), ', ', chr(13)) || '  ' || chr(10) || chr(10)"
_S = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BREAKS, _CONTROLS = T.BREAKS, T.CONTROLS


def sql_normalized(t: str) -> str:
    t = rf"regexp_replace({t}, '^\x{{FEFF}}', '')"
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[ \t]+(\n|\z)', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({t}, '^\n+', ''), '\n+\z', '')"


def sql_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_S}+'), lambda w: w <> '')"


def _messy():
    return F.concat(F.lit("﻿\n"), F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(". \t\r\n")), F.lit(", "), F.lit("\r")), F.lit("  \n\n"))


@query("ing_normalize", f"WITH n AS (SELECT doc_id, {sql_normalized(MESSY)} AS t FROM documents) SELECT doc_id, sha256(t) AS source_id, CAST(length(t) AS INTEGER) AS n_chars FROM n WHERE t <> ''")
def ing_normalize(spark, sf):
    """ING1, SRC2, HS1: canonical text and its identity; empty texts are rejected."""
    docs = table(spark, sf, "documents").select("doc_id", T.normalized(_messy()).alias("t")).where("t <> ''")
    return docs.select("doc_id", F.sha2("t", 256).alias("source_id"), F.length("t").alias("n_chars"))


_dirty = "replace(replace(replace(text, 'th', 'th' || chr(7)), ' a', chr(8232) || 'a'), 'er', 'e' || chr(173) || 'r')"


@query("ing_clean", f"SELECT doc_id, sha256({sql_normalized(f'''regexp_replace(regexp_replace({_dirty}, '{_BREAKS}', chr(10), 'g'), '{_CONTROLS}', '', 'g')''')}) AS digest, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS has_text FROM documents")
def ing_clean(spark, sf):
    """ING2, ING3: control characters, foreign separators and soft hyphens removed."""
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("th\x07")), F.lit(" a"), F.lit(" a")), F.lit("er"), F.lit("e­r"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.cleaned(t), 256).alias("digest"), T.has_text(F.col("text")).alias("has_text"))


@query("ing_collapse", f"""
SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(replace(text, ' ', '  '), chr(10)), lambda x: array_to_string({sql_words("x")}, ' ')), lambda x: x <> ''), chr(10))) AS digest,
       CAST(len({sql_words("text")}) AS INTEGER) AS n_words, array_to_string({sql_words("text")}, ' ') AS flat FROM documents""")
def ing_collapse(spark, sf):
    """ING4, ING14, STR1, STR6: collapsed lines, word count, one line."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.collapsed(F.replace(F.col("text"), F.lit(" "), F.lit("  "))), 256).alias("digest"), T.word_count(F.col("text")).alias("n_words"), T.one_line(F.col("text")).alias("flat"))


@query("ing_preview", f"""
WITH f AS (SELECT doc_id, array_to_string({sql_words("text")}, ' ') AS t FROM documents),
h AS (SELECT doc_id, t, left(t, 800) AS h, 800 - instr(reverse(left(t, 800)), ' ') AS b FROM f)
SELECT doc_id, CASE WHEN length(t) <= 800 THEN t ELSE rtrim(CASE WHEN contains(h, ' ') AND b > 720 THEN left(h, b) ELSE h END) || '…' END AS preview,
       CASE WHEN length(t) <= 60 THEN t ELSE left(t, 59) || '…' END AS short, t[101:200] AS slice FROM h""")
def ing_preview(spark, sf):
    """ING15, STR7, STR13: preview, shortened text and a slice by code points."""
    flat = table(spark, sf, "documents").select("doc_id", T.one_line(F.col("text")).alias("t"))
    return flat.select("doc_id", T.preview(F.col("t")).alias("preview"), T.shortened(F.col("t"), 60).alias("short"), F.substring("t", 101, 100).alias("slice"))


def _sql_redacted(t: str) -> str:
    for p in T.SECRETS:
        t = f"regexp_replace({t}, '{p}', '[REDACTED]', 'g')"
    return t


@query("str_redact", f"SELECT doc_id, {_sql_redacted('text')} AS redacted, {_sql_redacted('text')} <> text AS changed FROM documents")
def str_redact(spark, sf):
    """STR2: credentials in nine forms, in order."""
    docs = table(spark, sf, "documents").select("doc_id", "text", T.redacted(F.col("text")).alias("redacted"))
    return docs.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


@query("tx_terms", r"""
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS INTEGER) AS n_terms,
       sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), ' ')) AS terms FROM documents""")
def tx_terms(spark, sf):
    """TX1, SET1: distinct terms."""
    return table(spark, sf, "documents").select("doc_id", T.terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("terms"))


_claim = "'Ward 12 and district 7 of ' || upper(left(text, 1)) || 'xx Yyy, 1,234 of 56: ' || text"


@query("tx_literals", rf"""
WITH c AS (SELECT item_id, {_claim} AS t FROM benchmark)
SELECT item_id, array_to_string(regexp_extract_all(t, '(?:[A-Z][a-z]+(?:[''-][A-Za-z]+)?)(?:\s+(?:[A-Z][a-z]+(?:[''-][A-Za-z]+)?))+'), '|') AS names,
       array_to_string(regexp_extract_all(t, '(?i)\b(?:Ward|District)\s+[0-9]+\b'), '|') AS labels,
       array_to_string(regexp_extract_all(t, '\b[0-9]{{2,}}\b|\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b'), '|') AS numbers,
       CAST(len(regexp_split_to_array(t, '[,;:()\x{{2013}}\x{{2014}}]| - ')) AS INTEGER) AS n_clauses FROM c""")
def tx_literals(spark, sf):
    """TX3, TX5: proper names, district labels, numbers and clauses."""
    claims = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("Ward 12 and district 7 of "), F.upper(F.substring("text", 1, 1)), F.lit("xx Yyy, 1,234 of 56: "), F.col("text")).alias("t"))
    t = F.col("t")
    return claims.select("item_id", *[F.array_join(f(t), "|").alias(n) for f, n in ((T.proper_names, "names"), (T.district_labels, "labels"), (T.significant_numbers, "numbers"))], F.size(T.clauses(t)).alias("n_clauses"))


@query("tok_utf8", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS tokens, CAST(length(text) AS INTEGER) AS n_chars FROM documents")
def tok_utf8(spark, sf):
    """TOK1: the default counter."""
    return table(spark, sf, "documents").select("doc_id", T.utf8_tokens(F.col("text")).alias("tokens"), F.length("text").alias("n_chars"))


@query("src_printable", r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'a', chr(1)) ELSE text END AS t FROM documents)
SELECT doc_id, length(t) > 0 AND len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x7F-\x{9F}]')) * 100 <= length(t) AS printable FROM d""")
def src_printable(spark, sf):
    """SRC4: texts with too many control characters."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit("a"), F.lit("\x01"))).otherwise(F.col("text")).alias("t"))
    return docs.select("doc_id", T.mostly_printable(F.col("t")).alias("printable"))


@query("str_quotes", r"""
SELECT doc_id, sha256(regexp_replace(translate(replace(replace(text, '. ', '.” — “'), 'th', '‘th’'), '‘’‚‛“”„‟‐‑‒–—−', repeat(chr(39), 4) || repeat(chr(34), 4) || '------'), '{S}+', ' ', 'g')) AS digest FROM documents""".replace("{S}", _S))
def str_quotes(spark, sf):
    """TX4: quotations in plain form."""
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".” — “")), F.lit("th"), F.lit("‘th’"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.straight_quotes(t), 256).alias("digest"))


@query("str_ids", r"""
SELECT doc_id, printf('S%06d', doc_id + 1) AS segment_id, printf('V%02dC%06d', doc_id % 7, doc_id) AS claim_id, printf('L%dN%04d', doc_id % 5, doc_id + 1) AS node_id,
       CAST(doc_id % 5 AS INTEGER) AS level, CAST(doc_id AS INTEGER) AS ord,
       CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'Segment ' || (doc_id + 1) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' · p. ' || doc_id ELSE ' · pp. ' || doc_id || '–' || (doc_id + 1) END
            WHEN doc_id % 5 = 0 THEN 'Whole document'
            ELSE 'Level ' || (doc_id % 5) || ' · Group ' || (doc_id + 1) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' · p. ' || doc_id ELSE ' · pp. ' || doc_id || '–' || (doc_id + 1) END END AS label
FROM documents""")
def str_ids(spark, sf):
    """STR9, STR10: id codecs and labels."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", T.node_id(d % 5, d + 1).alias("node_id"))
    place = T.node_place(F.col("node_id"))
    first = F.when(d % 3 == 0, None).otherwise(d)
    label = T.node_label(F.when(d % 5 == 0, "leaf").otherwise("merge"), d % 5, d, d % 2 == 1, first, F.when(d % 3 == 1, d).otherwise(d + 1))
    return docs.select("doc_id", T.segment_id(d + 1).alias("segment_id"), F.format_string("V%02dC%06d", d % 7, d).alias("claim_id"), "node_id", place["level"].alias("level"), place["order"].alias("ord"), label.alias("label"))


@query("str_unfinished", r"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' and so' END AS t FROM documents)
SELECT doc_id, NOT regexp_matches(rtrim(t), '[.!?…。！？]["''”’»)\]}*_]*$') AS unfinished FROM c""")
def str_unfinished(spark, sf):
    """STR4: texts that stop within a sentence."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" and so"))).alias("t"))
    return docs.select("doc_id", (~F.rtrim("t").rlike(T.FINISHED)).alias("unfinished"))


@query("str_citations", r"""
SELECT doc_id, regexp_replace('A (S000001, S000002) b [S000003]. ' || text || ' (see S000001)', '[ \t]*[(\[][SD][0-9]{6}(?:[,;][ ]*[SD][0-9]{6})*[)\]]', '', 'g') AS prose FROM documents""")
def str_citations(spark, sf):
    """STR3: bracketed segment ids are dropped from prose."""
    t = F.concat(F.lit("A (S000001, S000002) b [S000003]. "), "text", F.lit(" (see S000001)"))
    return table(spark, sf, "documents").select("doc_id", T.without_citations(t).alias("prose"))


@query("str_names", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '(.)\.[A-Za-z0-9]{1,8}$', '\1'), '[_\s-]+', ' ', 'g')) AS title,
       left(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9 ._-]+', '_', 'g'), '^\.+', '')), 120) AS file FROM pages""")
def str_names(spark, sf):
    """STR8, STR15: titles and safe file names."""
    return table(spark, sf, "pages").select("page_id", T.file_title(F.col("url")).alias("title"), T.safe_filename(F.col("url")).alias("file"))


@query("str_sizes", r"""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size
FROM (SELECT doc_id, CAST(n_chars * n_chars AS BIGINT) AS n FROM documents)""")
def str_sizes(spark, sf):
    """STR11: sizes for people."""
    return table(spark, sf, "documents").select("doc_id", T.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("str_reason", f"""
WITH f AS (SELECT doc_id, array_to_string({sql_words("text")}, ' ') AS t FROM documents),
c AS (SELECT doc_id, t, len(list_filter(range(1, 401), lambda i: i <= length(t) AND strlen(left(t, i)) <= 400)) AS n FROM f)
SELECT doc_id, CASE WHEN strlen(t) <= 400 THEN t ELSE left(t, n) END AS reason FROM c""")
def str_reason(spark, sf):
    """STR5: a bounded reason in whole characters."""
    return table(spark, sf, "documents").select("doc_id", T.bounded_reason(F.col("text")).alias("reason"))


@query("str_latex", r"""
SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('50% & a_b #1 ~x^2 $' || text, '\\', '\\textbackslash{}', 'g'), '([&%$#_])', '\\\1', 'g'), '~', '\\textasciitilde{}', 'g'), '\^', '\\textasciicircum{}', 'g') AS latex FROM benchmark""")
def str_latex(spark, sf):
    """STR14: escaping for LaTeX."""
    return table(spark, sf, "benchmark").select("item_id", T.latex_escaped(F.concat(F.lit("50% & a_b #1 ~x^2 $"), F.col("text"))).alias("latex"))


@query("ma_budget", """
WITH r AS (SELECT doc_id, n_chars AS wanted, 2000 + doc_id % 7 * 1500 AS win, 300 AS overhead FROM documents),
m AS (SELECT *, greatest(256, CAST(floor(win * 0.05) AS BIGINT)) AS margin FROM r),
c AS (SELECT *, win - margin AS usable, win - margin - 800 - overhead - 100 - 200 AS capacity FROM m)
SELECT doc_id, margin, capacity,
  CASE WHEN usable <= 0 THEN 'no_input_capacity' WHEN 800 >= usable THEN 'output_exceeds_context' WHEN capacity <= 0 THEN 'no_input_capacity'
       WHEN wanted > capacity THEN 'input_exceeds_capacity' WHEN 2 * 900 > capacity THEN 'merge_pair_exceeds_capacity' END AS failure,
  greatest(800, 3 * (wanted // 10) + 1024) AS editorial FROM c""")
def ma_budget(spark, sf):
    """MA1, MA2, MA3: margins, capacities and classes of failure."""
    d = F.col("doc_id")
    r = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("wanted"), (F.lit(2000).cast("long") + d % 7 * 1500).alias("win"))
    budget = N.request_budget(F.col("win"), output=F.lit(800), overhead=F.lit(300), evidence=F.lit(100), headroom=F.lit(200), margin_floor=256, margin_share=0.05)
    r = r.withColumn("b", budget)
    failure = N.budget_failure(F.col("b"), F.lit(800), F.col("wanted"), F.lit(900))
    return r.select("doc_id", F.col("b.margin").alias("margin"), F.col("b.capacity").alias("capacity"), failure.alias("failure"), N.editorial_allowance(F.floor(F.col("wanted") / 10).cast("long"), F.lit(800)).alias("editorial"))


_models = "[{'m': 'gpt-4', 'w': 8192}, {'m': 'gpt-4-32k', 'w': 32768}, {'m': 'gpt-4o', 'w': 128000}, {'m': 'o1', 'w': 200000}, {'m': 'o1-mini', 'w': 128000}, {'m': 'gpt-5', 'w': 400000}]"


@query("ma_window", f"""
WITH k AS (SELECT unnest({_models}, recursive := true)), a AS (SELECT doc_id, list_extract(['gpt-4', 'gpt-4o-x', 'o1-mini-2', 'o1-pro', 'other', 'gpt-4-32k-v'], CAST(doc_id % 6 + 1 AS BIGINT)) AS model FROM documents)
SELECT doc_id, model, coalesce((SELECT arg_max(w, length(m)) FROM k WHERE starts_with(a.model, k.m)), 8192) AS win, NOT EXISTS (SELECT 1 FROM k WHERE starts_with(a.model, k.m)) AS assumed FROM a""")
def ma_window(spark, sf):
    """MA4: the context window by the longest known prefix of a model's name."""
    known = spark.createDataFrame([("gpt-4", 8192), ("gpt-4-32k", 32768), ("gpt-4o", 128000), ("o1", 200000), ("o1-mini", 128000), ("gpt-5", 400000)], "prefix string, tokens int")
    asked = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("gpt-4", "gpt-4o-x", "o1-mini-2", "o1-pro", "other", "gpt-4-32k-v"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("model"))
    return N.context_windows(asked, known).select("doc_id", "model", F.col("tokens").alias("win"), "assumed")


@query("ma_estimates", """
SELECT doc_id, CAST(1 + ceil(2.5 * greatest(1, n_chars // 6) / 20.0) AS BIGINT) AS verification, greatest(1, CAST(floor(n_chars * CAST(0.7 AS DOUBLE)) AS BIGINT)) AS keep_words,
       CASE WHEN n_chars // 6 BETWEEN ceil(180) AND floor(220) THEN 'inside' WHEN n_chars // 6 < 180 THEN 'under' ELSE 'above' END AS band FROM documents""")
def ma_estimates(spark, sf):
    """MA8, MA9, FLT10: verification calls, words to keep and the word band."""
    words = F.floor(F.col("n_chars") / 6).cast("long")
    return table(spark, sf, "documents").select("doc_id", N.verification_calls(words).alias("verification"), N.words_to_keep(F.col("n_chars")).alias("keep_words"), N.word_band(words, F.lit(200)).alias("band"))


@query("dt_elapsed", """
SELECT event_id, round_even(greatest(0.0, epoch_us(ts) / 1e6 - epoch_us(ts) // 86400000000 * 86400.0), 1) AS elapsed,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE round_even((epoch_us(ts) % 3600000000) / 1e6, 3) END AS duration FROM events""")
def dt_elapsed(spark, sf):
    """DT1, DT2: elapsed seconds, clamped at 0; durations, null if negative."""
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    events = table(spark, sf, "events")
    until = F.when(F.col("event_id") % 3 == 0, ts - F.expr("INTERVAL 1 SECOND")).otherwise(ts)
    return events.select("event_id", N.elapsed(day, ts).alias("elapsed"), N.duration(F.when(F.col("event_id") % 3 == 0, ts).otherwise(F.date_trunc("hour", ts)), until).alias("duration"))


@query("mp_errors", """
SELECT event_id, CASE WHEN code IN (401, 403) THEN 'authentication' WHEN code = 402 THEN 'quota' WHEN code = 404 THEN 'model_not_found' WHEN code IN (408, 504) THEN 'timeout' WHEN code = 429 THEN 'rate_limited' WHEN code >= 500 THEN 'unavailable' WHEN code >= 400 THEN 'invalid_request' ELSE 'none' END AS category,
       code IN (408, 429, 504) OR code >= 500 AS transient
FROM (SELECT event_id, list_extract([200, 400, 401, 402, 403, 404, 408, 429, 500, 504], CAST(event_id % 10 + 1 AS BIGINT)) AS code FROM events)""")
def mp_errors(spark, sf):
    """MP2, CTL2: response codes to categories, and which are tried again."""
    code = F.element_at(F.array(*map(F.lit, (200, 400, 401, 402, 403, 404, 408, 429, 500, 504))), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", N.error_category(code).alias("category"), N.transient(code).alias("transient"))


@query("js_props", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{"event":"' || event_type || '","user":' || user_id || '}' AS canonical, sha256('{"event":"' || event_type || '","user":' || user_id || '}') AS cache_key FROM events""")
def js_props(spark, sf):
    """JS2, JS3, HS2: JSON columns, canonical JSON and a key over it."""
    canonical = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user")))
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), canonical.alias("canonical"), F.sha2(canonical, 256).alias("cache_key"))


@query("hs_blind", """
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('study|' || doc_id)) AS INTEGER) AS blind FROM documents""")
def hs_blind(spark, sf):
    """HS3: a keyed order within each source that doesn't tell which is which."""
    from pyspark.sql import Window

    return table(spark, sf, "documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("study|"), F.col("doc_id").cast("string")), 256))).alias("blind"))
