"""Queries of the tree reduction, records, model calls, caches and publication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.functions import numbers as N
from scriptoria.functions import records
from scriptoria.operators import model, publish, reduce, segments
from scriptoria.plans.registry import query, table
from scriptoria.plans.segment_queries import SENTENCES, SPANS, _sql_packs


@query("agg_groups", """
WITH n AS (SELECT doc_id, CAST(doc_id % 37 + 1 AS BIGINT) AS n, doc_id % 7 + 2 AS f FROM documents),
m AS (SELECT doc_id, n, (n + f - 1) // f AS g, unnest(range(0, n)) AS i FROM n),
t AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, CASE WHEN i < (n % g) * (n // g + 1) THEN i // (n // g + 1) ELSE n % g + (i - (n % g) * (n // g + 1)) // (n // g) END AS b FROM m) GROUP BY doc_id, b)
SELECT doc_id, array_to_string(list(c ORDER BY b), ',') AS sizes FROM t GROUP BY doc_id""")
def agg_groups(spark, sf):
    """AGG6, WIN6: balanced groups in order."""
    d = F.col("doc_id")
    sizes = reduce.group_sizes(d % 37 + 1, d % 7 + 2)
    return table(spark, sf, "documents").select("doc_id", F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


@query("agg_fanout", "SELECT l_orderkey AS doc_id, CASE WHEN least(60 // CAST(max(l_quantity) AS BIGINT), 6) >= 2 THEN CAST(least(60 // CAST(max(l_quantity) AS BIGINT), 6) AS INTEGER) END AS fanout FROM lineitem GROUP BY l_orderkey")
def agg_fanout(spark, sf):
    """AGG7: how many of the largest children fit."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(reduce.fanout(F.max("l_quantity"), F.lit(60), 6).alias("fanout"))


@query("agg_merge_calls", """
WITH RECURSIVE n AS (SELECT doc_id, CAST(doc_id % 300 AS BIGINT) AS c FROM documents),
r AS (SELECT doc_id, c, CAST(0 AS BIGINT) AS calls FROM n UNION ALL SELECT doc_id, (c + 4) // 5, calls + CASE WHEN c >= 2 * ((c + 4) // 5) THEN (c + 4) // 5 ELSE c - (c + 4) // 5 END FROM r WHERE c > 1)
SELECT doc_id, max(calls) AS calls FROM r GROUP BY doc_id""")
def agg_merge_calls(spark, sf):
    """AGG21: merge calls down to one root."""
    return table(spark, sf, "documents").select("doc_id", reduce.merge_calls(F.col("doc_id") % 300, 5).alias("calls"))


def _packs(spark, sf):
    return segments.packed_sentences(table(spark, sf, "documents"), 1500).withColumn("segment_id", F.format_string("S%06d", F.col("ord") + 1))


def _leaves(spark, sf):
    """Leaf records of packs of sentences: the extractive default."""
    packs = _packs(spark, sf)
    parts = packs.select("doc_id", "segment_id", F.col("ord").alias("leaf"), F.posexplode(F.filter(segments.sentences(F.col("text")), lambda s: s != "")).alias("ord", "text"))
    return reduce.extracted(parts, ["doc_id", "segment_id", "leaf"]).select("doc_id", "segment_id", F.col("leaf").alias("ord"), "units")


_LEVELS = f"""{_sql_packs(f"list_transform({SENTENCES}, lambda x: strlen(x))", 1500)},
l0 AS (SELECT doc_id, max(ord) + 1 AS n FROM g GROUP BY doc_id),
lv AS (SELECT doc_id, 0 AS level, n FROM l0 UNION ALL SELECT doc_id, level + 1, (n + 3) // 4 FROM lv WHERE n > 1)"""


@query("agg_tree_levels", f"WITH RECURSIVE {_LEVELS} SELECT doc_id, CAST(level AS INTEGER) AS level, n AS nodes, (SELECT n FROM l0 WHERE l0.doc_id = lv.doc_id) AS covered FROM lv")
def agg_tree_levels(spark, sf):
    """AGG5, AGG8, AGG9, I8: nodes of each level, which together cover every segment once."""
    none = F.array().cast("array<struct<rank:int>>")  # nodes are counted, so leaves need no units
    tree = reduce.tree(_packs(spark, sf).select("doc_id", "segment_id", "ord", none.alias("units")), 4)
    return tree.groupBy("doc_id", "level").agg(F.count("*").alias("nodes"), F.sum(F.size("covered")).cast("long").alias("covered"))


@query("agg_tree")
def agg_tree(spark, sf):
    """AGG5, AGG9, MRG1, DIR1, I7: the whole tree with its extracted units, each with its quote and segment."""
    return reduce.tree(_leaves(spark, sf), 4).select("doc_id", "node_id", "level", "ord", "children", "covered", F.to_json("units").alias("units"))


@query("agg_section_tree")
def agg_section_tree(spark, sf):
    """AGG10: reductions within each section; no group crosses one. Source stands for the document, the document for its section."""
    leaves = _leaves(spark, sf).withColumn("k", F.format_string("%d/s%d", F.col("doc_id"), F.floor(F.col("ord") / 5)))
    parts = leaves.select("k", "segment_id", (F.col("ord") % 5).alias("ord"), "units")
    return reduce.tree(parts, 3, key="k").select("k", "node_id", "level", "children", "covered")


@query("srt_grounding", """
WITH c AS (SELECT user_id AS node, event_id % 40 AS segment, CASE event_type WHEN 'error' THEN 0 ELSE event_id % 5 END AS kind, event_id AS ord FROM events),
m AS (SELECT node, segment, min(kind) AS priority, min(ord) FILTER (kind = k) AS first FROM (SELECT *, min(kind) OVER (PARTITION BY node, segment) AS k FROM c) GROUP BY node, segment)
SELECT node, segment, priority, priority < 2 AS mandatory, CAST(row_number() OVER (PARTITION BY node ORDER BY priority, first) AS INTEGER) AS rank FROM m""")
def srt_grounding(spark, sf):
    """SRT6, AGG17: candidates of a merge by priority; contradictions and qualifications are mandatory; first seen wins."""
    from pyspark.sql import Window

    c = table(spark, sf, "events").select(F.col("user_id").alias("node"), (F.col("event_id") % 40).alias("segment"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 5).alias("kind"), F.col("event_id").alias("ord"))
    best = c.groupBy("node", "segment").agg(F.min(F.struct("kind", "ord")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("m.kind", "m.ord"))
    return best.select("node", "segment", F.col("m.kind").alias("priority"), (F.col("m.kind") < 2).alias("mandatory"), rank.alias("rank"))


@query("js_objects", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a": {"b": "}' || event_id || '"}}' END AS object, CASE event_id % 3 WHEN 1 THEN 'no JSON object found' WHEN 2 THEN 'expected one JSON object, found 2' END AS reason FROM events""")
def js_objects(spark, sf):
    """JS1: the one object of an answer."""
    e = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"a": {"b": "}'), e, F.lit('"}}'))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure, I use the {summary} field:\n```json\n"), one, F.lit("\n``` }"))).when(F.col("event_id") % 3 == 1, "none {here}").otherwise(F.concat(one, F.lit(" and "), one))
    return records.answers(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id", "text")


@query("js_candidates")
def js_candidates(spark, sf):
    """SEG16: quotation candidates within a byte budget."""
    return records.candidates(table(spark, sf, "documents"), "doc_id", "text", 2000)


@query("js_records", """
SELECT doc_id, text AS summary, 'other' AS kind, 'q' || doc_id AS quote, false AS uncertain FROM documents""")
def js_records(spark, sf):
    """JS5, FLT12, D13: records checked and stripped of their sources."""
    raw = F.to_json(F.struct(F.col("text").alias("summary"), F.array(F.struct(F.lit("t").alias("text"), F.lit("strange").alias("kind"), F.array(F.struct(F.lit("S000001").alias("segment_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("quote"))).alias("evidence"))).alias("content_units")))
    rows = table(spark, sf, "documents").select("doc_id", records.coerced(F.from_json(raw, records.NODE)).alias("node"))
    plain = rows.select("doc_id", records.without_sources(F.col("node")).alias("n"))
    unit = F.element_at("n.content_units", 1)
    return plain.select("doc_id", "n.summary", unit["kind"].alias("kind"), F.element_at(unit["quotes"], 1).alias("quote"), unit["uncertain"].alias("uncertain"))


@query("ctl_model")
def ctl_model(spark, sf):
    """SRC20, CTL1 to CTL3: a record for each document by the default provider."""
    return model.generated(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("agg_narrowed", """
WITH c AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, CAST(l_quantity AS DOUBLE) AS cost, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
g AS (SELECT *, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END AS b FROM (SELECT c.*, f, (n + f - 1) // f AS k FROM c, (VALUES (2), (3), (4), (5)) v(f))),
s AS (SELECT doc_id, f, b, sum(cost) AS total, count(*) AS members FROM g GROUP BY doc_id, f, b),
o AS (SELECT doc_id, f FROM s GROUP BY doc_id, f HAVING max(CASE WHEN members > 1 THEN total ELSE 0 END) <= 90)
SELECT DISTINCT c.doc_id, (SELECT CAST(max(f) AS INTEGER) FROM o WHERE o.doc_id = c.doc_id) AS fanout FROM c""")
def agg_narrowed(spark, sf):
    """AGG11: a level is tried again with one child less until all its groups fit."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("double").alias("cost"))
    costs = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "cost"))), lambda x: x["cost"]).alias("costs"))
    return costs.select("doc_id", reduce.narrowed(F.col("costs"), 5, F.lit(90.0)).alias("fanout"))


@query("ver_reask", """
WITH i AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS item, (l_orderkey + l_linenumber * 3) % 6 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
a AS (SELECT *, least(4, n) AS largest, count(*) OVER (PARTITION BY doc_id, p // 4) AS g1, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS most FROM i),
b AS (SELECT *, greatest(1, (largest + 1) // 2) AS half FROM a),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS q FROM b WHERE g1 > most),
m2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, q // half) AS g2 FROM m),
r AS (SELECT doc_id, item, kind, 1 AS asks, g1 AS group_size, 'accepted' AS how FROM b WHERE g1 <= most
      UNION ALL SELECT doc_id, item, kind, 2, g2, 'accepted' FROM m2 WHERE g2 <= most
      UNION ALL SELECT doc_id, item, kind, CASE WHEN half > 1 THEN 3 ELSE 2 END, 1, CASE WHEN most >= 1 THEN 'accepted' WHEN kind = 4 THEN 'lenient' ELSE 'omitted' END FROM m2 WHERE g2 > most)
SELECT doc_id, item, CASE WHEN how = 'accepted' THEN 'v' || item WHEN how = 'lenient' THEN 'about v' || item END AS value, CAST(asks AS INTEGER) AS asks, CAST(group_size AS INTEGER) AS group_size, how FROM r""")
def ver_reask(spark, sf):
    """VER8: items that an answer leaves out are asked for again in groups of half the size, then alone."""
    work = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("long") + F.col("l_orderkey").cast("long") * 1000)).alias("items"))
    return model.settled_items(work, "doc_id", 4, _answers).withColumn("item", F.col("item") % 1000).withColumn("value", F.regexp_replace("value", "[0-9]+$", F.col("item").cast("string")))


def _answers(group: list, note: str) -> tuple[dict, dict, dict]:
    """A model that answers an item only in groups up to a size of the item's own."""
    most = lambda i: {0: 4, 1: 3, 2: 2, 3: 1}.get((i // 1000 + i % 1000 * 3) % 6, 0)
    return {i: f"v{i}" for i in group if len(group) <= most(i)}, {i: f"about v{i}" for i in group if (i // 1000 + i % 1000 * 3) % 6 == 4}, {}


@query("snk_exports", f"""
WITH d AS (SELECT doc_id, 'Doc/' || doc_id AS title, text FROM documents WHERE text <> ''),
n AS (SELECT doc_id, title, text, 'Doc_' || doc_id AS safe FROM d)
SELECT doc_id, safe || '-summary.txt' AS name, 'text/plain; charset=utf-8' AS media_type, sha256(text) AS digest FROM n
UNION ALL SELECT doc_id, safe || '-summary.md', 'text/markdown; charset=utf-8', sha256('# ' || title || chr(10) || chr(10) || trim(text) || '[^1]' || chr(10) || chr(10) || '[^1]: S000001' || chr(10)) FROM n
UNION ALL SELECT doc_id, safe || '-summary.json', 'application/json', sha256(title || chr(9) || text || chr(9) || 'S000001') FROM n""")
def snk_exports(spark, sf):
    """SNK5: published texts as plain text, as Markdown with footnotes and as JSON, whose parts are read again here."""
    one = F.array(F.struct(F.lit(0).alias("ord"), F.col("text").alias("text"), F.lit("S000001").alias("segment_id")))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Doc/"), F.col("doc_id").cast("string")).alias("title"), "text", one.alias("sentences"))
    out = None
    for form in ("txt", "md", "json"):
        rows = publish.exported(docs, form)
        if form == "json":
            r = F.from_json("content", "title string, text string, sentences array<struct<ord:int,text:string,segment_id:string>>")
            rows = rows.withColumn("content", F.concat_ws("\t", r["title"], r["text"], r["sentences"][0]["segment_id"]))
        out = rows if out is None else out.unionByName(rows)
    return out.select("doc_id", "name", "media_type", F.sha2("content", 256).alias("digest"))


@query("ctl_cache", """
SELECT doc_id, sha256('{"t":"' || sha256(text) || '"}') AS cache_key, CASE WHEN bool_or(lang = 'en') OVER (PARTITION BY text) THEN 'old' ELSE 'new' END AS answer FROM documents""")
def ctl_cache(spark, sf):
    """CTL4, HS2, SNK7, SEG17, JOIN10: known answers are taken, the rest is computed once for each key."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", model.cache_key(F.sha2("text", 256).alias("t")).alias("cache_key"))
    cache = model.first_writer(docs.where("lang = 'en'").select("cache_key", F.lit("old").alias("answer"), "doc_id"), "doc_id").select("cache_key", "answer")
    return model.resolved(docs, cache, "doc_id", lambda missing: missing.withColumn("answer", F.lit("new")))[0].select("doc_id", "cache_key", "answer")


@query("ctl_manifest", """
SELECT o_orderkey AS work_id, o_orderstatus = 'F' AS completed, o_orderstatus <> 'F' AND o_orderkey % 5 = 0 AS non_reusable, o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 AS pending FROM orders""")
def ctl_manifest(spark, sf):
    """CTL5, I12: a plan's completed, non-reusable and pending work."""
    done = F.col("o_orderstatus") == "F"
    stale = ~done & (F.col("o_orderkey") % 5 == 0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), done.alias("completed"), stale.alias("non_reusable"), (~done & ~stale).alias("pending"))


@query("snk_publish", "SELECT c_custkey AS id, c_name AS name, true AS good FROM customer")
def snk_publish(spark, sf):
    """SNK1 to SNK4: published rows are read back and checked against the manifest."""
    path = f"{reduce.shared_root(spark)}/published-{uuid.uuid4().hex}"
    publish.published(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path, "id")
    return publish.read_back(spark, path, "id").select("id", "name", "good")


@query("snk_markdown", f"""
WITH {SPANS}, z AS (SELECT doc_id AS d, ord AS o, trim(text) AS t, 'S' || (ord * 7 % 3) AS seg FROM sp),
n AS (SELECT d, seg, row_number() OVER (PARTITION BY d ORDER BY f) AS k FROM (SELECT d, seg, min(o) AS f FROM z GROUP BY d, seg))
SELECT z.d AS doc_id, sha256(string_agg(t || '[^' || k || ']', ' ' ORDER BY o) || chr(10) || chr(10) || (SELECT string_agg('[^' || k || ']: ' || seg, chr(10) ORDER BY k) FROM n m WHERE m.d = z.d) || chr(10)) AS digest
FROM z JOIN n ON n.d = z.d AND n.seg = z.seg GROUP BY z.d""")
def snk_markdown(spark, sf):
    """SNK5: Markdown with footnotes numbered by first citation."""
    s = segments.sentence_spans(table(spark, sf, "documents")).withColumn("segment_id", F.concat(F.lit("S"), (F.col("ord") * 7 % 3).cast("string")))
    return publish.footnoted(s).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("ma_delays", "SELECT event_id, list_sum(list_transform(range(0, event_id % 5 + 1), lambda i: least(30.0, 0.5 * power(2.0, i)))) AS wait FROM events")
def ma_delays(spark, sf):
    """MA7: waits before further attempts, at most."""
    d = N.retry_delays(5, 0.5, 30.0)
    return table(spark, sf, "events").select("event_id", F.aggregate(F.slice(d, F.lit(1), (F.col("event_id") % 5 + 1).cast("int")), F.lit(0.0), lambda a, b: a + b).alias("wait"))


@query("seg_compression", rf"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda s: trim(regexp_replace(s, '\s+$', ''))), lambda s: s <> '') AS p FROM documents),
g AS (SELECT doc_id, p, 1 AS i, 0 AS ord, ' ' || p[1] AS now FROM s WHERE len(p) > 0
      UNION ALL
      SELECT doc_id, p, i + 1, CASE WHEN length(now) + length(p[i + 1]) > 1000 THEN ord + 1 ELSE ord END, CASE WHEN length(now) + length(p[i + 1]) > 1000 THEN p[i + 1] ELSE now || ' ' || p[i + 1] END FROM g WHERE i < len(p)),
c AS (SELECT doc_id, ord, arg_max(now, i) AS chunk FROM g GROUP BY doc_id, ord)
SELECT doc_id, count(*) FILTER (length(chunk) <= 1000) AS whole, CAST(sum(length(chunk)) FILTER (length(chunk) <= 1000) AS BIGINT) AS whole_chars FROM c GROUP BY doc_id HAVING count(*) > 0""")
def seg_compression(spark, sf):
    """SEG15: chunks for shortening; a chunk that is too long is cut between words."""
    from scriptoria.operators.segments import sentence_starts
    from scriptoria.sources.arrow import flat_mapped

    def rows(doc, text):
        starts = sentence_starts(text) if text else []
        parts = [p for a, b in zip(starts, [*starts[1:], len(text or "")], strict=True) if (p := text[a:b].strip())]
        for i, (gap, chunk, split) in enumerate(records.compression_chunks(text, parts)):
            yield (doc, i, gap, chunk, split)

    chunks = flat_mapped(table(spark, sf, "documents").select("doc_id", "text"), "doc_id long, ord int, gap string, chunk string, split boolean", rows)
    return chunks.groupBy("doc_id").agg(F.count_if(~F.col("split")).alias("whole"), F.sum(F.when(~F.col("split"), F.length("chunk"))).alias("whole_chars"))


@query("win_layout", """
WITH r AS (SELECT doc_id, i, CAST(20 + i * 7 % 5 AS BIGINT) AS height FROM (SELECT doc_id, unnest(range(CAST(0 AS BIGINT), n_chars // 100 + 1)) AS i FROM documents))
SELECT doc_id, i, CAST(coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM r""")
def win_layout(spark, sf):
    """WIN16: where each row of a text begins in a view, from the heights of the rows above."""
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 100))).alias("i")).withColumn("height", 20 + F.col("i") * 7 % 5)
    return rows.select("doc_id", "i", F.coalesce(F.sum("height").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("top"))
