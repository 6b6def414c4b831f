"""Queries of lines, sentences, packs, segments and the corpus dry run."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import reduce, segments
from scriptoria.plans.registry import query, table

_abbr = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
_KEPT = rf"(?i)(^|[^\p{{L}}\p{{N}}_])((?:{_abbr})\.)(\s)"
_MARKED = rf"regexp_replace(regexp_replace(text, '{_KEPT}', '\1\2﷐\3', 'g'), '{_KEPT}', '\1\2﷐\3', 'g')"
SENTENCES = rf"""list_filter(string_split(replace(regexp_replace({_MARKED}, '([.!?…。！？]+["''”’»)\]}}*_]*)(\s+)', '\1\2﷑', 'g'), '﷐', ''), '﷑'), lambda s: s <> '')"""
SPANS = f"""s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS text FROM (SELECT doc_id, {SENTENCES} AS p FROM documents)),
sp AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) AS "end", text FROM s)"""


@query("seg_lines", """
WITH l AS (SELECT doc_id, length(text) AS n, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS content FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)),
o AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(s AS INTEGER) AS start, CAST(least(s + length(content) + 1, n) AS INTEGER) AS "end", content FROM o WHERE least(s + length(content) + 1, n) > s""")
def seg_lines(spark, sf):
    """SEG1: lines and their offsets."""
    return segments.line_spans(table(spark, sf, "documents"))


@query("seg_sentences", f"""WITH {SPANS} SELECT doc_id, ord, "end" - CAST(length(text) AS INTEGER) AS start, "end", sha256(text) AS content_hash FROM sp""")
def seg_sentences(spark, sf):
    """SEG4, SEG5: sentences that tile each document, by our own rule."""
    return segments.sentence_spans(table(spark, sf, "documents")).select("doc_id", "ord", "start", "end", F.sha2("text", 256).alias("content_hash"))


@query("ver_spans", f"""WITH {SPANS} SELECT doc_id, printf('V01S%06d', ord + 1) AS span_id, CAST(ord + 1 AS INTEGER) AS ordinal, "end" - CAST(length(text) AS INTEGER) AS start, "end", text, sha256(text) AS content_hash FROM sp""")
def ver_spans(spark, sf):
    """VER1: a draft's spans with ids and hashes."""
    return segments.draft_spans(table(spark, sf, "documents"))


def _sql_packs(sizes: str, most: int) -> str:
    """Recursive greedy packing of a list of costs."""
    return f"""u AS (SELECT doc_id, {sizes} AS z FROM documents),
e AS (SELECT doc_id, generate_subscripts(z, 1) AS i, unnest(z) AS c FROM u),
g AS (SELECT doc_id, i, c, CAST(0 AS BIGINT) AS ord, CAST(c AS BIGINT) AS tot FROM e WHERE i = 1
      UNION ALL
      SELECT e.doc_id, e.i, e.c, CASE WHEN g.tot + e.c <= {most} THEN g.ord ELSE g.ord + 1 END, CASE WHEN g.tot + e.c <= {most} THEN g.tot + e.c ELSE e.c END
      FROM g JOIN e ON e.doc_id = g.doc_id AND e.i = g.i + 1)"""


@query("seg_pack_lines", f"""WITH RECURSIVE {_sql_packs("list_transform(string_split(text, chr(10)), lambda x: strlen(x) + 1)", 1000)}
SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(count(*) AS INTEGER) AS units, CAST(sum(c) AS INTEGER) AS tokens FROM g GROUP BY doc_id, ord""")
def seg_pack_lines(spark, sf):
    """SEG8: greedy packs of lines."""
    return segments.packed_lines(table(spark, sf, "documents"), 1000)


@query("seg_pack_sentences", f"""WITH RECURSIVE {_sql_packs(f"list_transform({SENTENCES}, lambda x: strlen(x))", 2000)}
SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(count(*) AS INTEGER) AS units, CAST(sum(c) AS INTEGER) AS tokens FROM g GROUP BY doc_id, ord""")
def seg_pack_sentences(spark, sf):
    """SEG8, SRT7: greedy packs of sentences, in order."""
    return segments.packed_sentences(table(spark, sf, "documents"), 2000).select("doc_id", "ord", "units", "tokens")


@query("seg_blocks", "SELECT doc_id, CAST(0 AS INTEGER) AS block_no, CAST(0 AS INTEGER) AS start, CAST(length(text) AS INTEGER) AS \"end\", 'paragraph' AS kind FROM documents WHERE text <> ''")
def seg_blocks(spark, sf):
    """SEG2: structural blocks; these documents are one paragraph each."""
    return segments.blocks(table(spark, sf, "documents"))


@query("seg_headings")
def seg_headings(spark, sf):
    """SEG3: headings of documents made of a title, sections and a fence."""
    t = F.concat(F.lit("Title "), F.col("doc_id").cast("string"), F.lit("\n=====\n\n```\n# not one\n```\n## Part one ##\n"), F.col("text"), F.lit("\n\n### Part two\nend"))
    return segments.headings(table(spark, sf, "documents").select("doc_id", t.alias("text")))


@query("seg_segments")
def seg_segments(spark, sf):
    """SEG6, SEG7, SEG9, SEG10: segments of at most 2,000 bytes with overlap."""
    return segments.segments(table(spark, sf, "documents"), 2000, 200)


@query("seg_valid", "SELECT doc_id, CAST(0 AS INTEGER) AS ord, CAST(0 AS INTEGER) AS core_start, CAST(0 AS INTEGER) AS core_end FROM documents WHERE false")
def seg_valid(spark, sf):
    """SEG12, I1, I3: segments that break the tiling; there is none."""
    docs = table(spark, sf, "documents")
    return segments.broken(segments.segments(docs, 1500, 150), docs)


@query("seg_spans", """
SELECT doc_id, CAST(min(core_start) AS INTEGER) AS first, CAST(max(core_end) AS INTEGER) AS last, CAST(sum(core_end - core_start) AS BIGINT) AS covered
FROM (SELECT doc_id, 0 AS core_start, CAST(length(text) AS BIGINT) // 3 AS core_end FROM documents UNION ALL SELECT doc_id, CAST(length(text) AS BIGINT) * 2 // 3, length(text) FROM documents) WHERE core_end > core_start GROUP BY doc_id""")
def seg_spans(spark, sf):
    """SEG11: only two thirds of each document are cut, and no segment crosses a span."""
    n = F.length("text")
    spans = F.array(F.struct(F.lit(0).alias("start"), F.floor(n / 3).cast("int").alias("end")), F.struct(F.floor(n * 2 / 3).cast("int").alias("start"), n.alias("end")))
    found = segments.segments(table(spark, sf, "documents").withColumn("spans", spans), 800, 0, "spans")
    return found.groupBy("doc_id").agg(F.min("core_start").alias("first"), F.max("core_end").alias("last"), F.sum(F.col("core_end") - F.col("core_start")).alias("covered"))


@query("seg_whole", "SELECT doc_id, 'D000001' AS segment_id, CAST(0 AS INTEGER) AS core_start, CAST(length(text) AS INTEGER) AS core_end, CAST(strlen(text) AS INTEGER) AS tokens FROM documents")
def seg_whole(spark, sf):
    """SEG13: the one segment of a direct request."""
    return table(spark, sf, "documents").select("doc_id", F.lit("D000001").alias("segment_id"), F.lit(0).alias("core_start"), F.length("text").alias("core_end"), F.octet_length("text").alias("tokens"))


@query("seg_legacy", rf"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda s: trim(regexp_replace(s, '\s+$', ''))), lambda s: s <> '') AS p FROM documents),
g AS (SELECT doc_id, p, 1 AS i, 0 AS ord, ' ' || p[1] AS now FROM s WHERE len(p) > 0
      UNION ALL
      SELECT doc_id, p, i + 1, CASE WHEN length(now) + length(p[i + 1]) > 600 THEN ord + 1 ELSE ord END, CASE WHEN length(now) + length(p[i + 1]) > 600 THEN p[i + 1] ELSE now || ' ' || p[i + 1] END FROM g WHERE i < len(p))
SELECT doc_id, CAST(ord AS INTEGER) AS ord, sha256(arg_max(now, i)) AS digest FROM g GROUP BY doc_id, ord""")
def seg_legacy(spark, sf):
    """SEG14, LEG1: chunks of the flat workflow."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(segments.legacy_chunks(F.col("text"), 600)).alias("ord", "chunk")).select("doc_id", "ord", F.sha2("chunk", 256).alias("digest"))


_dry = _sql_packs(f"list_transform({SENTENCES}, lambda x: strlen(x))", 2000)


@query("corpus_dry_run", f"""
WITH RECURSIVE {_dry},
n AS (SELECT doc_id, max(ord) + 1 AS leaves FROM g GROUP BY doc_id),
r AS (SELECT doc_id, leaves AS c, CAST(0 AS BIGINT) AS calls FROM n
      UNION ALL
      SELECT doc_id, (c + 3) // 4, calls + CASE WHEN c >= 2 * ((c + 3) // 4) THEN (c + 3) // 4 ELSE c - (c + 3) // 4 END FROM r WHERE c > 1),
m AS (SELECT doc_id, max(calls) AS merges FROM r GROUP BY doc_id),
d AS (SELECT documents.doc_id, lang, strlen(text) AS tokens, CASE WHEN strlen(text) <= 8192 - 409 - 4096 - 500 THEN 'direct' ELSE 'hierarchical' END AS strategy, coalesce(leaves, 0) AS leaves, coalesce(merges, 0) AS merges
      FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN m ON m.doc_id = documents.doc_id)
SELECT lang, strategy, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN strategy = 'direct' THEN 1 ELSE leaves END) AS BIGINT) AS leaf_calls, CAST(sum(CASE WHEN strategy = 'direct' THEN 0 ELSE merges END) AS BIGINT) AS merge_calls
FROM d GROUP BY lang, strategy""")
def corpus_dry_run(spark, sf):
    """CTL8, AGG18, AGG21: strategies and estimated calls of each language's documents; no model is needed."""
    docs = table(spark, sf, "documents")
    costs = F.transform(F.filter(segments.sentences(F.col("text")), lambda s: s != ""), lambda s: F.octet_length(s))
    tokens = F.octet_length("text")
    planned = docs.select("lang", tokens.alias("tokens"), F.size(segments.packs(costs, F.lit(2000))).alias("leaves"))
    planned = planned.withColumn("strategy", F.when(F.col("tokens") <= 8192 - 409 - 4096 - 500, "direct").otherwise("hierarchical"))
    planned = planned.withColumn("merges", reduce.merge_calls(F.col("leaves"), 4))
    direct = F.col("strategy") == "direct"
    return planned.groupBy("lang", "strategy").agg(
        F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens"),
        F.sum(F.when(direct, 1).otherwise(F.col("leaves"))).cast("long").alias("leaf_calls"), F.sum(F.when(direct, 0).otherwise(F.col("merges"))).cast("long").alias("merge_calls"),
    )
