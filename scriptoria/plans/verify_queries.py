"""Queries of claims, evidence, verdicts and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import numbers as N
from scriptoria.functions import text as T
from scriptoria.operators import segments, verify
from scriptoria.plans.registry import query, table
from scriptoria.plans.segment_queries import SPANS, _sql_packs

_PACKED = _sql_packs("list_transform(string_split(text, chr(10)), lambda x: strlen(x) + 1)", 1000)


def _segments(spark, sf):
    """Packs of lines as passages, with their text."""
    packed = segments.packed_sentences(table(spark, sf, "documents"), 1000)
    return packed.select("doc_id", F.format_string("S%06d", F.col("ord") + 1).alias("segment_id"), "ord", "text")


def _claims(spark, sf):
    """The benchmark's items as claims about the document that shares most of their rarer words."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("anchor"), F.explode(T.terms(F.col("text"))).alias("term"))
    rare = items.join(items.groupBy("term").count().where("count <= 3"), "term")
    docs = table(spark, sf, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    shared = docs.join(rare, "term").groupBy("item_id", "anchor", "doc_id").agg(F.count("*").alias("n"))
    best = shared.groupBy("item_id", "anchor").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"))
    return best.select("doc_id", F.format_string("V01C%06d", F.col("item_id") + 1).alias("claim_id"), "anchor")


@query("ver_claims", f"""
WITH {SPANS}, w AS (SELECT doc_id, ord + 1 AS ordinal, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS whole, text FROM sp),
a AS (SELECT doc_id, ordinal, whole, list_filter(string_split(trim(text), ', '), lambda x: x <> '' AND contains(text, x)) AS g FROM w WHERE whole <> ''),
d AS (SELECT doc_id, ordinal, whole, list_transform(list_sort(list_transform(list_distinct(g), lambda x: {{'p': list_position(g, x), 'x': x}})), lambda y: y.x) AS g FROM a),
e AS (SELECT doc_id, ordinal, whole, CASE WHEN list_contains(g, whole) THEN g ELSE list_append(g, whole) END AS g FROM d),
r AS (SELECT doc_id, ordinal, whole, generate_subscripts(g, 1) AS k, unnest(g) AS anchor FROM e)
SELECT doc_id, printf('V01C%06d', row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, k)) AS claim_id, printf('V01S%06d', ordinal) AS span_id, CAST(k AS INTEGER) AS ordinal, anchor, anchor = whole AS is_fallback FROM r""")
def ver_claims(spark, sf):
    """VER2: anchors and exactly one fallback claim for each span."""
    spans = segments.draft_spans(table(spark, sf, "documents")).withColumn("anchors", F.split(F.trim("text"), ", "))
    return verify.claims(spans)


@query("ver_evidence")
def ver_evidence(spark, sf):
    """VER3, VER4, JOIN8, SRT4, SRT5: evidence of each claim within 2,000 bytes."""
    return verify.selected(verify.ranked(_claims(spark, sf), _segments(spark, sf)), 2000)


@query("ver_overlap", r"""
WITH i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
l AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM documents),
f AS (SELECT term FROM i GROUP BY term HAVING count(*) <= 3)
SELECT item_id, doc_id, count(*) AS overlap FROM i JOIN f USING (term) JOIN l USING (term) GROUP BY item_id, doc_id HAVING count(*) >= 3""")
def ver_overlap(spark, sf):
    """JOIN8, SET2: items and documents that share at least three terms which are rare among the items."""
    items = table(spark, sf, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))
    rare = items.join(items.groupBy("term").count().where("count <= 3"), "term").select("item_id", "term")
    docs = table(spark, sf, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return docs.join(rare, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap")).where("overlap >= 3")


@query("ver_cost", r"""
SELECT item_id, CAST(27 + 7 + length(t) + len(regexp_extract_all(t, '["\\\x08\t\n\f\r]')) + 5 * len(regexp_extract_all(t, '[\x00-\x07\x0B\x0E-\x1F\x{80}-\x{FFFF}]')) + 11 * len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) AS INTEGER) AS cost
FROM (SELECT item_id, text || '"é\' || chr(1) || chr(10) || chr(128512) AS t FROM benchmark)""")
def ver_cost(spark, sf):
    """JS2, SRT5: bytes of a passage as escaped JSON."""
    t = F.concat("text", F.lit('"é\\\x01\n😀'))
    return table(spark, sf, "benchmark").select("item_id", verify.passage_cost(F.lit("S000001"), t).alias("cost"))


_FINDINGS = "f AS (SELECT user_id AS claim, list_extract(['supported', 'contradicted', 'insufficiently_supported', 'not_meaningfully_verifiable', 'supported'], CAST((event_id * 7 + user_id) % 5 + 1 AS BIGINT)) AS verdict, event_id % 4 <> 0 AS complete, event_id // 3 AS batch FROM events)"


def _findings(spark, sf):
    e = F.element_at(F.array(*map(F.lit, (*verify.VERDICTS, "supported"))), ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("claim"), e.alias("verdict"), (F.col("event_id") % 4 != 0).alias("complete"), F.floor(F.col("event_id") / 3).cast("long").alias("batch"))


_REDUCED = """r AS (SELECT claim, batch, bool_or(verdict = 'supported') AS s, bool_or(verdict = 'contradicted') AS c, bool_or(verdict = 'not_meaningfully_verifiable') AS n, count(DISTINCT verdict) AS k, bool_and(complete) AS a FROM f GROUP BY claim, batch),
v AS (SELECT claim, batch, CASE WHEN s AND c THEN 'insufficiently_supported' WHEN n AND k > 1 THEN 'insufficiently_supported' WHEN n THEN 'not_meaningfully_verifiable' WHEN c AND a AND NOT s THEN 'contradicted' WHEN s THEN 'supported' ELSE 'insufficiently_supported' END AS verdict,
      CASE WHEN s AND c THEN 'conflicting_evidence' WHEN n AND k > 1 THEN 'inconsistent_meaningfulness' END AS reason FROM r)"""


@query("agg_verdicts", f"WITH {_FINDINGS}, {_REDUCED} SELECT claim, batch, verdict, reason FROM v")
def agg_verdicts(spark, sf):
    """AGG12: findings of a claim's batches to one verdict."""
    return verify.reduced(_findings(spark, sf), ["claim", "batch"])


@query("agg_sentences", f"""WITH {_FINDINGS}, {_REDUCED}
SELECT batch % 50 AS span, bool_and(verdict = 'supported') AS supported, arg_max(verdict, list_position(['supported', 'not_meaningfully_verifiable', 'insufficiently_supported', 'contradicted'], verdict)) AS worst, count(*) AS claims FROM v GROUP BY 1""")
def agg_sentences(spark, sf):
    """AGG13: sentences whose claims are all supported, and the worst verdict."""
    found = verify.reduced(_findings(spark, sf), ["claim", "batch"])
    return verify.sentence_verdicts(found.withColumn("span", F.col("batch") % 50), ["span"])


@query("agg_kinds", """
SELECT user_id AS doc_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_id % 97 = 0) THEN 'unchecked' WHEN bool_or(event_id % 31 = 0) THEN 'subset' ELSE 'verified' END AS kind, count(*) AS sections FROM events GROUP BY user_id""")
def agg_kinds(spark, sf):
    """AGG19, VER18: a document's kind is its sections' worst."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 97 == 0, "unchecked").when(F.col("event_id") % 31 == 0, "subset").otherwise("verified")
    return verify.assembled_kind(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), kind.alias("kind")))


@query("ver_published", rf"""
WITH {SPANS}, t AS (SELECT doc_id, ord, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t, ord % 4 <> 1 AS ok FROM sp),
g AS (SELECT *, sum(CASE WHEN regexp_matches(t[1:1], '\p{{Ll}}') AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM t WHERE t <> '')),
k AS (SELECT doc_id, grp, bool_and(ok) AS ok, string_agg(t, ' ' ORDER BY ord) AS piece FROM g GROUP BY doc_id, grp)
SELECT doc_id, sha256(string_agg(piece, ' ' ORDER BY grp)) AS digest, count(*) AS sentences FROM k WHERE ok GROUP BY doc_id""")
def ver_published(spark, sf):
    """VER13, VER14: only whole supported sentences are published; these documents have no paragraph breaks."""
    spans = segments.draft_spans(table(spark, sf, "documents")).withColumn("supported", (F.col("ordinal") - 1) % 4 != 1)
    return verify.published(spans).select("doc_id", F.sha2("text", 256).alias("digest"), "sentences")


_fw = ", ".join(f"'{w}'" for w in verify.FUNCTION_WORDS)
_cw = rf"list_transform(list_filter(regexp_extract_all(lower(%s), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({_fw})), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:ing|edly|ed|ly|es|s)$', '') ELSE w END)"


@query("flt_overlap_floor", rf"""
WITH b AS (SELECT item_id, text AS t, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN left(text, length(text) // 2) WHEN 2 THEN 'nothing of it' ELSE left(text, 30) END AS q FROM benchmark),
p AS (SELECT item_id, {_cw % "q"} AS q, list_prepend(t, regexp_split_to_array(t, '[,;:()\x{{2013}}\x{{2014}}]| - ')) AS parts FROM b),
u AS (SELECT item_id, list_distinct(q) AS q, generate_subscripts(parts, 1) AS i, {_cw % "unnest(parts)"} AS s FROM p),
m AS (SELECT item_id, i, q, s, list_distinct(s) AS d, len(list_intersect(list_distinct(s), q)) AS shared,
      len(list_filter(range(1, len(s) - 1), lambda j: NOT list_contains(q, s[j]) AND NOT list_contains(q, s[j + 1]) AND NOT list_contains(q, s[j + 2]))) > 0 AS run FROM u)
SELECT item_id, bool_or((i = 1 OR len(d) >= 3) AND len(d) > 0 AND (shared < 0.15 * len(d) OR (len(d) >= 6 AND shared < 3) OR (len(q) >= 3 AND run))) AS too_low FROM m GROUP BY item_id""")
def flt_overlap_floor(spark, sf):
    """FLT6, VER11, TX2: claims that their quotes leave unstated."""
    t, n = F.col("text"), F.col("item_id") % 4
    q = F.when(n == 0, t).when(n == 1, F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))).when(n == 2, "nothing of it").otherwise(F.substring(t, 1, 30))
    return table(spark, sf, "benchmark").select("item_id", verify.overlap_too_low(t, q).alias("too_low"))


@query("flt_numbers", r"""
SELECT item_id, item_id % 3 = 0 OR (item_id % 3 = 1 AND abs((100 + item_id) - 100) <= 0.1 * 100) AS close, 2 AS values FROM benchmark""")
def flt_numbers(spark, sf):
    """MA5, MA6, FLT7: numbers that are equal, or near where the claim says so."""
    n = F.col("item_id")
    claim = F.when(n % 3 == 0, "It took 1,234 days and twenty-one hours").when(n % 3 == 1, F.concat(F.lit("About "), (n + 100).cast("string"), F.lit(" people and twenty-one dogs"))).otherwise(F.concat(F.lit("It was "), (n + 5000).cast("string"), F.lit(" and twenty-one")))
    evidence = F.lit("Of 1,234 days, 100 people, twenty-one")
    return table(spark, sf, "benchmark").select("item_id", N.numbers_close(claim, evidence).alias("close"), F.size(N.number_values(claim)).alias("values"))


@query("ver_repairs", rf"""
WITH {SPANS}, r AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 2 THEN '' WHEN ord % 5 = 3 THEN 'Repaired.' || regexp_extract(text, '(\s*)$', 1) ELSE text END AS p, ord % 5 IN (2, 3) AS hit FROM sp)
SELECT doc_id, sha256(string_agg(p, '' ORDER BY ord)) AS digest, count(*) FILTER (hit) AS repairs FROM r GROUP BY doc_id""")
def ver_repairs(spark, sf):
    """VER12: spans replaced or removed where their hash still fits."""
    spans = segments.draft_spans(table(spark, sf, "documents"))
    n = (F.col("ordinal") - 1) % 5
    repairs = spans.where(n.isin(2, 3, 4)).select("doc_id", "span_id", F.when(n == 4, "stale").otherwise(F.col("content_hash")).alias("original_hash"), F.when(n == 2, "remove").otherwise("replace").alias("action"), F.lit("Repaired.").alias("replacement"))
    return verify.repaired(spans, repairs).select("doc_id", F.sha2("text", 256).alias("digest"), "repairs")


@query("ver_ledger", f"""
WITH {_FINDINGS}, l AS (SELECT claim, batch % 20 AS span, batch, verdict, row_number() OVER (PARTITION BY claim, batch % 20 ORDER BY batch DESC, verdict) AS k FROM f WHERE verdict <> 'supported')
SELECT claim, span, verdict FROM l WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.claim = l.claim AND f.batch % 20 = l.span AND f.batch > l.batch AND f.verdict = 'supported')""")
def ver_ledger(spark, sf):
    """VER16, WIN11: sentences that were removed with their latest failing verdict, unless a later pass supports them."""
    f = _findings(spark, sf).withColumn("span", F.col("batch") % 20)
    failed = f.where("verdict <> 'supported'").groupBy("claim", "span").agg(F.max("batch").alias("batch"), F.min_by("verdict", F.struct(-F.col("batch"), "verdict")).alias("verdict"))
    passed = f.where("verdict = 'supported'").groupBy("claim", "span").agg(F.max("batch").alias("good"))
    return failed.join(passed, ["claim", "span"], "left").where("good is null or good <= batch").select("claim", "span", "verdict")


@query("ver_support_hash", f"""
WITH {SPANS} SELECT d.doc_id, CAST(ord + 1 AS INTEGER) AS ordinal, sha256(d.text["end" - CAST(length(sp.text) AS INTEGER) + 1 : "end"]) = sha256(sp.text) AS supported FROM sp JOIN documents d ON d.doc_id = sp.doc_id """)
def ver_support_hash(spark, sf):
    """VER20: a published place is that of a checked span if its text has the same hash."""
    docs = table(spark, sf, "documents")
    spans = segments.draft_spans(docs).select("doc_id", "ordinal", "start", "end", "content_hash")
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "ordinal", (F.sha2(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), 256) == F.col("content_hash")).alias("supported"))


@query("ver_audit", """
SELECT doc_id, 'L0N0001' AS node_id, CASE WHEN doc_id % 3 = 0 THEN 'S999999' ELSE 'S000001' END AS segment_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown_segment' ELSE 'quote_not_found' END AS fault FROM documents WHERE doc_id % 3 < 2""")
def ver_audit(spark, sf):
    """VER21, FLT11, JOIN10, I7, I9: citations that resolve to nothing, and quotes that aren't in their segment."""
    docs = table(spark, sf, "documents")
    passages = docs.select("doc_id", F.lit("S000001").alias("segment_id"), "text")
    n = F.col("doc_id") % 3
    cited = docs.select("doc_id", F.lit("L0N0001").alias("node_id"), F.when(n == 0, "S999999").otherwise("S000001").alias("segment_id"), F.when(n == 1, "never written").otherwise(F.col("text")).alias("quote"))
    return verify.audit_faults(passages, cited)


@query("flt_lost", rf"""
WITH {SPANS}, z AS (SELECT doc_id, ord, text || ' ' || (100 + doc_id % 7 * 10 + ord % 3) AS text FROM sp),
x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(string_agg(text, ' ' ORDER BY ord), '\b[0-9]{{2,}}\b|\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b'))) AS lit FROM z WHERE ord % 4 <> 1 GROUP BY doc_id),
y AS (SELECT doc_id, ord, unnest(list_distinct(regexp_extract_all(text, '\b[0-9]{{2,}}\b|\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b'))) AS lit FROM z)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, array_to_string(list_sort(list(lit)), ',') AS lost FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = y.doc_id AND x.lit = y.lit) GROUP BY doc_id, ord""")
def flt_lost(spark, sf):
    """FLT9: source sentences whose numbers a shorter text has lost."""
    s = segments.sentence_spans(table(spark, sf, "documents"))
    s = s.select("doc_id", "ord", F.concat("text", F.lit(" "), (100 + F.col("doc_id") % 7 * 10 + F.col("ord") % 3).cast("string")).alias("text"))
    short = s.where("ord % 4 <> 1").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    return verify.lost_sentences(s, short).select("doc_id", "ord", F.array_join("lost", ",").alias("lost"))


@query("flt_restored", rf"""
WITH {SPANS}, z AS (SELECT doc_id, ord, text || ' ' || (100 + doc_id % 7 * 10 + ord % 3) AS text FROM sp),
sh AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE trim(coalesce(string_agg(text, ' ' ORDER BY ord) FILTER (ord % 4 <> 1), '')) END AS short, string_agg(text, '' ORDER BY ord) AS whole FROM z GROUP BY doc_id),
y AS (SELECT z.doc_id, ord, trim(z.text) AS t FROM z JOIN sh ON sh.doc_id = z.doc_id
      WHERE NOT contains(lower(short), lower(trim(z.text))) AND len(list_filter(regexp_extract_all(z.text, '\b[0-9]{{2,}}\b|\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b'), lambda l: NOT list_contains(regexp_extract_all(short, '\b[0-9]{{2,}}\b|\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b'), l))) > 0),
t AS (SELECT doc_id, string_agg(t, ' ' ORDER BY ord) AS tail FROM y GROUP BY doc_id)
SELECT sh.doc_id, sha256(CASE WHEN short = '' THEN trim(whole) WHEN tail IS NULL THEN short ELSE short || chr(10) || chr(10) || tail END) AS digest FROM sh LEFT JOIN t ON t.doc_id = sh.doc_id""")
def flt_restored(spark, sf):
    """FLT9, VER15: the sentences whose numbers a shorter text has lost are put back; a text shortened to nothing is its source."""
    s = segments.sentence_spans(table(spark, sf, "documents"))
    s = s.select("doc_id", "ord", F.concat("text", F.lit(" "), (100 + F.col("doc_id") % 7 * 10 + F.col("ord") % 3).cast("string")).alias("text"))
    kept = F.array_sort(F.collect_list(F.when((F.col("ord") % 4 != 1) & (F.col("doc_id") % 5 != 0), F.struct("ord", "text"))))
    short = s.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("text"))
    return verify.restored(s, short).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("ver_provenance", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'no_evidence' END, CASE WHEN doc_id % 3 = 0 THEN 'no_annotation_evidence' END, CASE WHEN doc_id % 5 = 0 AND NOT (doc_id % 7 = 0 AND doc_id % 11 = 0) THEN 'unknown_segment' END, CASE WHEN doc_id % 7 = 0 THEN 'no_provenance' END,
  CASE WHEN doc_id % 11 = 0 AND NOT contains(text, upper(text) || '!') THEN 'quotation' END, CASE WHEN doc_id % 2 = 1 AND NOT contains(text, source) THEN 'unit_quote' END, CASE WHEN doc_id % 3 = 1 AND NOT contains(text, lang) THEN 'annotation_quote' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents""")
def ver_provenance(spark, sf):
    """FLT11: the seven rules of a record's references."""
    from scriptoria.functions import records

    d, s1 = F.col("doc_id"), F.lit("S000001")
    cite = lambda quote, segment=s1: F.array(F.struct(segment.alias("segment_id"), quote.alias("quote")))
    nothing, null = F.array().cast(records.EVIDENCE), F.lit(None).cast("string")
    unit = F.when(d % 2 == 0, nothing).otherwise(cite(F.col("source")))
    note = F.when(d % 3 == 0, nothing).when(d % 3 == 1, cite(F.col("lang"))).otherwise(cite(F.col("text")))
    node = F.struct(
        F.lit("s").alias("summary"), F.array(F.struct(F.lit("u").alias("text"), F.lit("claim").alias("kind"), unit.alias("evidence"))).alias("content_units"), F.array(F.struct(F.lit("q").alias("text"), note.alias("evidence"))).alias("qualifications"),
        F.array(F.struct(F.lit("c").alias("text"), cite(null).alias("evidence"))).alias("contradictions"), F.when(d % 11 == 0, cite(F.concat(F.upper("text"), F.lit("!")))).when(d % 5 == 0, cite(null, F.lit("S000009"))).otherwise(nothing).alias("quotations"),
        F.when(d % 7 == 0, F.array().cast("array<string>")).when(d % 5 == 0, F.array(F.lit("S000009"))).otherwise(F.array(s1)).alias("provenance"),
    )
    rows = table(spark, sf, "documents").select("doc_id", node.alias("node"), F.create_map(s1, F.col("text")).alias("legal"))
    return rows.select("doc_id", F.array_join(verify.provenance_faults(F.col("node"), F.col("legal")), ",").alias("faults"))


@query("cmp_shorten", rf"""
WITH {SPANS}, w AS (SELECT doc_id, ord, trim(text) AS t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS terms FROM sp),
u AS (SELECT *, sum(words) OVER o AS upto, row_number() OVER o AS k FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY terms DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, sha256(string_agg(t, ' ' ORDER BY ord)) AS digest, CAST(sum(words) AS BIGINT) AS words FROM u WHERE upto <= 60 OR k = 1 GROUP BY doc_id""")
def cmp_shorten(spark, sf):
    """CMP1, CMP2: the deterministic shortening to a number of words."""
    return verify.compressed(segments.sentence_spans(table(spark, sf, "documents")), 60).select("doc_id", F.sha2("text", 256).alias("digest"), "words")


@query("cmp_passes", f"""
WITH RECURSIVE {SPANS}, w AS (SELECT doc_id, ord, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM sp),
c AS (SELECT doc_id, ord + 1 AS n, sum(words) OVER (PARTITION BY doc_id ORDER BY ord) AS words, count(*) OVER (PARTITION BY doc_id) AS m FROM w),
r AS (SELECT doc_id, n, words, 0 AS accepted, 0 AS slow, CASE WHEN words <= 40 * 1.1 THEN 'band' END AS why FROM c WHERE n = m
      UNION ALL
      SELECT r.doc_id, CASE WHEN c.words < r.words THEN c.n ELSE r.n END, least(c.words, r.words), r.accepted + CASE WHEN c.words < r.words THEN 1 ELSE 0 END,
             CASE WHEN 1 - c.words / r.words < 0.01 THEN r.slow + 1 ELSE 0 END,
             CASE WHEN c.words >= r.words THEN 'refused' WHEN 1 - c.words / r.words < 0.01 AND r.slow = 2 THEN 'slow' WHEN c.words <= 40 * 1.1 THEN 'band' WHEN r.accepted + 1 >= 99 THEN 'passes' END
      FROM r JOIN c ON c.doc_id = r.doc_id AND c.n = greatest(1, r.n - (r.n + 9) // 10) WHERE r.why IS NULL)
SELECT doc_id, CAST(words AS INTEGER) AS words, accepted, why FROM r WHERE why IS NOT NULL
UNION ALL SELECT doc_id, 0, 0, 'band' FROM documents WHERE text IS NULL OR text = ''""")
def cmp_passes(spark, sf):
    """CMP1: light passes until a text is in the band; what doesn't shorten it is refused, and slow passes end it."""
    from scriptoria.operators import shorten

    return shorten.shortened_texts(table(spark, sf, "documents"), 40).select("doc_id", "words", "accepted", "why")


@query("cmp_begin", """
SELECT doc_id, CASE WHEN k = 0 THEN sha256(text) WHEN k = 1 AND n < 36 THEN sha256(text || chr(10) || chr(10) || source) WHEN k = 1 AND n > 44 THEN sha256(text) END AS digest
FROM (SELECT doc_id, text, source, doc_id % 2 AS k, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents) WHERE NOT (k = 0 AND n <= 44)
UNION ALL SELECT doc_id, CASE WHEN n < 36 AND trim(text) <> '' THEN sha256(text) END FROM (SELECT doc_id, text, doc_id % 2 AS k, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents) WHERE k = 0 AND n <= 44""")
def cmp_begin(spark, sf):
    """CMP2: passes begin with the summary, or with the segments' texts where it holds too little; in the band there is nothing to do."""
    from scriptoria.operators import shorten

    cores = F.when(F.col("doc_id") % 2 == 1, F.array("text", F.lit(" "), "source")).otherwise(F.array("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(shorten.to_shorten(F.col("text"), cores, 40), 256).alias("digest"))


@query("flt_tolerance", r"""
SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'rounded_number' WHEN 1 THEN 'shortened_name' END AS allowed FROM benchmark""")
def flt_tolerance(spark, sf):
    """FLT7: rounded numbers and shortened names, which get a second look."""
    n = F.col("item_id") % 4
    claim = F.when(n == 0, "About 100 people of the town came").when(n == 1, "Lovelace wrote the notes").when(n == 2, "It was 100 people of the town that sang").otherwise("Turing wrote the notes")
    evidence = F.when(n % 2 == 0, "The town: 104 people came").otherwise("Ada Lovelace wrote the notes")
    return table(spark, sf, "benchmark").select("item_id", verify.allowed_difference(claim, evidence).alias("allowed"))


@query("tok_vocabulary")
def tok_vocabulary(spark, sf):
    """TOK2 to TOK4: tokens by a vocabulary file, where one is installed; else the default counter."""
    from scriptoria.functions import counters

    try:
        import public_tokenizers

        name, path = "tokenizer", public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        name, path = "utf8", None
    return counters.counted(table(spark, sf, "benchmark"), "item_id", "text", name, path)


@query("ver_passages", """
SELECT doc_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS fits FROM documents GROUP BY doc_id""")
def ver_passages(spark, sf):
    """VER5: long cores cut into passages; together they are the whole text, and each fits."""
    whole = table(spark, sf, "documents").select("doc_id", F.lit("S000001").alias("segment_id"), F.lit(0).alias("ord"), "text")
    parts = verify.passages(whole, 1200)
    return parts.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.bool_and(F.octet_length("text") <= 1200).alias("fits"))


@query("ver_classified", r"""
WITH p AS (SELECT item_id, text AS anchor, CASE item_id % 3 WHEN 0 THEN text || ' and more' WHEN 1 THEN regexp_replace(text, '^\S+\s*', '') ELSE '' END AS passage FROM benchmark),
t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(anchor), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(passage), '[\p{L}\p{N}]+')) AS b FROM p)
SELECT item_id, CASE WHEN list_has_all(b, a) THEN 'supported' ELSE 'insufficiently_supported' END AS verdict, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a) AS share FROM t""")
def ver_classified(spark, sf):
    """VER6: the deterministic classifier."""
    n, t = F.col("item_id") % 3, F.col("text")
    passage = F.when(n == 0, F.concat(t, F.lit(" and more"))).when(n == 1, F.regexp_replace(t, r"^\S+\s*", "")).otherwise("")
    return verify.classified(table(spark, sf, "benchmark").select("item_id", t.alias("anchor"), passage.alias("text")), ["item_id"])


@query("ver_findings", """
WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'supported' ELSE 'not_meaningfully_verifiable' END AS v, doc_id % 4 < 2 AS good FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'insufficiently_supported' ELSE v END AS verdict, CASE WHEN good THEN 'S000001' END AS segment_id, doc_id % 4 = 2 AS downgraded FROM f""")
def ver_findings(spark, sf):
    """VER7: findings whose evidence doesn't hold are downgraded; curly quotation marks don't matter."""
    docs, n = table(spark, sf, "documents"), F.col("doc_id") % 4
    passages = docs.select("doc_id", F.lit("S000001").alias("segment_id"), F.concat(F.lit("He said “no” — "), F.col("text")).alias("text"))
    quote = F.when(n == 0, 'said "no" -').when(n == 1, F.col("text")).when(n == 2, "never written").otherwise("")
    rows = docs.select("doc_id", F.lit("V01C000001").alias("claim_id"), F.lit(0).alias("batch"), F.when(n == 1, verify.VERDICTS[1]).when(n == 3, verify.VERDICTS[3]).otherwise(verify.VERDICTS[0]).alias("verdict"), F.lit("S000001").alias("segment_id"), quote.alias("quote"), F.array(F.lit("S000001")).alias("chosen"))
    return verify.validated(rows, passages).select("doc_id", "verdict", "segment_id", "downgraded")


@query("ver_pass")
def ver_pass(spark, sf):
    """VER9, VER10, AGG12, FLT5: verdicts of the benchmark's items against their documents, over all evidence, with a second look."""
    return verify.verified(_claims(spark, sf), _segments(spark, sf), 2000)


@query("ver_assembled", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Part ' || turn END AS h, coalesce(text, '') AS t FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN h IS NOT NULL AND t <> '' THEN h || chr(10) || chr(10) || t ELSE coalesce(h, t) END AS piece FROM s)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce(sum(length(piece) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, CAST(length(piece) AS INTEGER) AS length FROM p WHERE piece <> ''""")
def ver_assembled(spark, sf):
    """VER19, AGG20: sections in order, and where each begins."""
    t = table(spark, sf, "conversations")
    sections = t.select("conv_id", F.col("turn").alias("ord"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Part "), F.col("turn").cast("string"))).alias("heading"), F.coalesce("text", F.lit("")).alias("text"))
    return verify.assembled(sections, "conv_id")[1].withColumnRenamed("ord", "turn")
