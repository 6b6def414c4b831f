"""Queries of the service's joins, aggregates, windows, sorts and sets.

The star-schema tables play the service's: customer documents, orders runs, lineitem attempts; events is the run log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import reduce, sections, segments, verify
from scriptoria.plans.registry import query, table


@query("join_runs_documents", """
SELECT o_orderkey AS run_id, o_custkey AS document_id, c_name AS title, coalesce(n, 0) AS attempts FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) a ON l_orderkey = o_orderkey""")
def join_runs_documents(spark, sf):
    """JOIN1, JOIN7, AGG1: runs with their document and number of attempts."""
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    runs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return runs.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.col("c_name").alias("title"), F.coalesce("n", F.lit(0)).alias("attempts"))


@query("join_latest_run", """
SELECT c_custkey AS document_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, CAST(count(o_orderkey) AS BIGINT) AS runs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def join_latest_run(spark, sf):
    """JOIN2, SRT2, WIN11: each document's newest run; ties go to the later key."""
    latest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"), F.count("*").alias("runs"))
    return table(spark, sf, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("document_id"), "run_id", F.coalesce("runs", F.lit(0)).alias("runs"))


@query("join_latest_attempt", """
SELECT l_orderkey AS run_id, l_linenumber AS attempt, l_returnflag AS state FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey) USING (l_orderkey, l_linenumber)""")
def join_latest_attempt(spark, sf):
    """JOIN3, AGG2: the attempt of the highest number."""
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    top = a.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return a.join(top, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt"), F.col("l_returnflag").alias("state"))


_PAGES = "pg AS (SELECT doc_id, CAST(unnest(range(CAST(0 AS BIGINT), n_chars, 700)) AS INTEGER) AS start, n_chars FROM documents), pp AS (SELECT doc_id, start, CAST(least(start + 700, n_chars) AS INTEGER) AS \"end\", CAST(start // 700 + 1 AS INTEGER) AS page FROM pg)"
_OFFSETS = "off AS (SELECT doc_id, CAST(unnest(range(CAST(3 AS BIGINT), n_chars, 911)) AS INTEGER) AS \"offset\" FROM documents)"


def _doc_pages(spark, sf):
    docs = table(spark, sf, "documents").where("n_chars > 0")
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_chars").cast("int") - 1, F.lit(700))).alias("start"), "n_chars")
    return docs, pages.select("doc_id", "start", F.least(F.col("start") + 700, F.col("n_chars")).cast("int").alias("end"), (F.floor(F.col("start") / 700) + 1).cast("int").alias("page"))


@query("join_asof_page", f'WITH {_PAGES}, {_OFFSETS} SELECT off.doc_id, off."offset", pp.page FROM off ASOF JOIN pp ON off.doc_id = pp.doc_id AND off."offset" >= pp.start')
def join_asof_page(spark, sf):
    """JOIN4, SEC7, WIN9: the page that holds an offset."""
    docs, pages = _doc_pages(spark, sf)
    offsets = docs.where("n_chars > 3").select("doc_id", F.explode(F.sequence(F.lit(3), F.col("n_chars").cast("int") - 1, F.lit(911))).alias("offset"))
    return sections.page_of(offsets, pages)


@query("join_overlap_pages", f"""
WITH {_PAGES}, {_OFFSETS}, s AS (SELECT doc_id, "offset" AS start, CAST("offset" + doc_id % 3 * 1000 AS INTEGER) AS "end" FROM off)
SELECT s.doc_id, s.start, s."end", min(page) AS first_page, max(page) AS last_page FROM s LEFT JOIN pp ON s.doc_id = pp.doc_id AND pp.start < s."end" AND pp."end" > s.start AND s."end" > s.start GROUP BY s.doc_id, s.start, s."end\"""")
def join_overlap_pages(spark, sf):
    """JOIN5, JOIN6: pages over a range; an empty range has none."""
    docs, pages = _doc_pages(spark, sf)
    ranges = docs.where("n_chars > 3").select("doc_id", F.explode(F.sequence(F.lit(3), F.col("n_chars").cast("int") - 1, F.lit(911))).alias("start"))
    return sections.pages_over(ranges.withColumn("end", (F.col("start") + F.col("doc_id") % 3 * 1000).cast("int")), pages)


@query("join_semi_anti", """
SELECT 'covered' AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'stale', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def join_semi_anti(spark, sf):
    """JOIN10, JOIN11, SET3: rows with and without a match."""
    runs, known = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    total = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return total(runs.join(known, "o_orderkey", "left_semi"), "covered").unionByName(total(runs.join(known, "o_orderkey", "left_anti"), "stale"))


@query("join_children", """
WITH n AS (SELECT doc_id, (doc_id - 1) // 4 AS parent FROM documents WHERE doc_id > 0)
SELECT p.doc_id AS node, count(n.doc_id) AS children, array_to_string(list_sort(list(n.doc_id)), ',') AS child_ids FROM documents p JOIN n ON n.parent = p.doc_id GROUP BY p.doc_id""")
def join_children(spark, sf):
    """JOIN9: children adopt their parent."""
    docs = table(spark, sf, "documents").select("doc_id")
    kids = docs.where("doc_id > 0").select(F.floor((F.col("doc_id") - 1) / 4).cast("long").alias("node"), F.col("doc_id").alias("child"))
    found = kids.join(docs.withColumnRenamed("doc_id", "node"), "node").groupBy("node").agg(F.count("*").alias("children"), F.array_sort(F.collect_list("child")).alias("c"))
    return found.select("node", "children", F.array_join(F.col("c").cast("array<string>"), ",").alias("child_ids"))


@query("join_coalesce", """
SELECT coalesce(a.doc_id, l.doc_id) AS doc_id, CAST(coalesce(l.quality, a.doc_id % 2) AS BIGINT) AS quality, l.doc_id IS NULL AS from_second FROM documents a FULL JOIN labels l ON a.doc_id = l.doc_id""")
def join_coalesce(spark, sf):
    """JOIN12, SET5: the first index, else the second."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("a_id"))
    both = a.join(table(spark, sf, "labels"), F.col("a_id") == F.col("doc_id"), "full")
    return both.select(F.coalesce("a_id", "doc_id").alias("doc_id"), F.coalesce("quality", F.col("a_id") % 2).cast("long").alias("quality"), F.col("doc_id").isNull().alias("from_second"))


@query("join_retry", """
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS status, CAST(l_quantity AS BIGINT) % 4 AS requests FROM lineitem)
SELECT a.k, CASE WHEN a.status = 'R' AND a.requests = 0 AND b.k IS NOT NULL THEN b.status ELSE a.status END AS status, a.status = 'R' AND a.requests = 0 AND b.k IS NOT NULL AS replaced
FROM (SELECT * FROM t WHERE n = 1) a LEFT JOIN (SELECT * FROM t WHERE n = 2) b ON a.k = b.k""")
def join_retry(spark, sf):
    """JOIN13: a retry replaces its trial only where that failed without a request."""
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("status"), (F.col("l_quantity").cast("long") % 4).alias("requests"))
    both = t.where("n = 1").join(t.where("n = 2").select("k", F.col("status").alias("again")), "k", "left")
    use = (F.col("status") == "R") & (F.col("requests") == 0) & F.col("again").isNotNull()
    return both.select("k", F.when(use, F.col("again")).otherwise(F.col("status")).alias("status"), use.alias("replaced"))


@query("join_quote", r"""
WITH p AS (SELECT doc_id, doc_id % 4 AS k, chr(8212) || ' ' || replace(replace(text, '''', chr(8217)), '-', chr(8211)) || chr(10) AS passage, text AS t FROM documents),
q AS (SELECT doc_id, k, passage, CASE k WHEN 0 THEN passage WHEN 1 THEN ' - ' || replace(t, ' ', '  ') WHEN 2 THEN t || ' and never more' ELSE ' ' || chr(10) END AS quote FROM p),
c AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM (SELECT doc_id, regexp_extract_all(passage, '(?s).') AS x FROM q WHERE k = 1)),
w AS (SELECT *, regexp_matches(c, '\s') AS blank, coalesce(lag(regexp_matches(c, '\s')) OVER (PARTITION BY doc_id ORDER BY i), true) AS after FROM c),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, CASE WHEN blank THEN ' ' ELSE translate(c, chr(8217) || chr(8211) || chr(8212), '''--') END AS c FROM w WHERE NOT (blank AND after)),
n AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS plain FROM o GROUP BY doc_id),
f AS (SELECT n.doc_id, strpos(plain, trim(regexp_replace(translate(quote, chr(8217) || chr(8211) || chr(8212), '''--'), '\s+', ' ', 'g'))) AS a, length(trim(regexp_replace(translate(quote, chr(8217) || chr(8211) || chr(8212), '''--'), '\s+', ' ', 'g'))) AS m FROM n JOIN q ON q.doc_id = n.doc_id),
r AS (SELECT f.doc_id, x.i AS i, y.i - x.i + 1 AS n FROM f JOIN o x ON x.doc_id = f.doc_id AND x.place = a JOIN o y ON y.doc_id = f.doc_id AND y.place = a + m - 1 WHERE a > 0)
SELECT q.doc_id, CASE k WHEN 0 THEN true WHEN 1 THEN r.doc_id IS NOT NULL ELSE false END AS found, CAST(CASE k WHEN 0 THEN 100 WHEN 1 THEN r.i + 99 END AS INTEGER) AS document_offset,
       CAST(CASE k WHEN 0 THEN length(passage) WHEN 1 THEN r.n END AS INTEGER) AS length FROM q LEFT JOIN r ON r.doc_id = q.doc_id""")
def join_quote(spark, sf):
    """JOIN14, VER17: where a quotation stands, with the segment's base offset, though blanks, quotation marks and dashes differ; some aren't there."""
    k = F.col("doc_id") % 4
    passage = F.concat(F.lit("\u2014 "), F.replace(F.replace(F.col("text"), F.lit("'"), F.lit("\u2019")), F.lit("-"), F.lit("\u2013")), F.lit("\n"))
    quote = F.when(k == 0, passage).when(k == 1, F.concat(F.lit(" - "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")))).when(k == 2, F.concat("text", F.lit(" and never more"))).otherwise(F.lit(" \n"))
    rows = table(spark, sf, "documents").select("doc_id", passage.alias("passage"), verify.located(quote, passage).alias("own"))
    return rows.select("doc_id", F.col("own").isNotNull().alias("found"), (F.instr(F.col("passage"), F.col("own")) - 1 + 100).alias("document_offset"), F.length("own").alias("length"))


@query("join_matrix", """
SELECT s.seed, r_name AS document, f.fraction, v.version, CAST(round_even(1000 * (r_regionkey + 1) * f.fraction, 0) AS BIGINT) AS target
FROM (VALUES (1), (2), (3)) s(seed), region, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.25)) f(fraction), (VALUES ('modern'), ('legacy')) v(version) WHERE NOT (v.version = 'legacy' AND f.fraction > 0.1)""")
def join_matrix(spark, sf):
    """JOIN15: the study's matrix, three small parameter lists and a handful of documents."""
    docs = table(spark, sf, "region")
    parameters = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(f).alias("fraction"), F.lit(v).alias("version")) for s in (1, 2, 3) for f in (0.05, 0.1, 0.25) for v in ("modern", "legacy")]))
    rows = docs.select("r_name", "r_regionkey", parameters.alias("p")).where("not (p.version = 'legacy' and p.fraction > 0.1)")
    return rows.select("p.seed", F.col("r_name").alias("document"), "p.fraction", "p.version", F.bround(1000 * (F.col("r_regionkey") + 1) * F.col("p.fraction"), 0).cast("long").alias("target"))


@query("join_upload_dedupe", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def join_upload_dedupe(spark, sf):
    """JOIN16: the earliest document with the same content; a group is combined before it is joined."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("kept"))
    return docs.join(first, "h").select("doc_id", "kept", (F.col("doc_id") != F.col("kept")).alias("duplicate"))


@query("join_priority", """
WITH m(id, slug) AS (VALUES ('a/x:free', 'a/x-1'), ('a/x', 'a/x-0'), ('b/y', 'b/y-2'), ('c', 'a/x-1')),
q AS (SELECT doc_id, list_extract(['a/x:free', 'a/x:paid', 'b/y-2', 'b/y-2:z', 'a/x-1', 'none'], CAST(doc_id % 6 + 1 AS BIGINT)) AS asked FROM documents),
h AS (SELECT doc_id, asked, id, CASE WHEN id = asked THEN 1 WHEN id = split_part(asked, ':', 1) THEN 2 WHEN slug = asked THEN 3 WHEN slug = split_part(asked, ':', 1) THEN 4 END AS p FROM q JOIN m ON id = asked OR id = split_part(asked, ':', 1) OR slug = asked OR slug = split_part(asked, ':', 1))
SELECT q.doc_id, q.asked, (SELECT id FROM h WHERE h.doc_id = q.doc_id ORDER BY p, id LIMIT 1) AS model FROM q""")
def join_priority(spark, sf):
    """JOIN17: the best of four keys: exact id, id without variant, slug, slug of the base."""
    models = spark.createDataFrame([("a/x:free", "a/x-1"), ("a/x", "a/x-0"), ("b/y", "b/y-2"), ("c", "a/x-1")], "id string, slug string")
    keys = models.select(F.col("id").alias("k"), F.lit("id").alias("kind"), "id").unionByName(models.select(F.col("slug").alias("k"), F.lit("slug").alias("kind"), "id"))
    asked = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("a/x:free", "a/x:paid", "b/y-2", "b/y-2:z", "a/x-1", "none"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("asked"))
    base = F.split_part(F.col("asked"), F.lit(":"), F.lit(1))
    tries = F.array(*[F.struct(F.lit(p).alias("p"), k.alias("k"), F.lit(kind).alias("kind")) for p, k, kind in ((1, F.col("asked"), "id"), (2, base, "id"), (3, F.col("asked"), "slug"), (4, base, "slug"))])
    names = asked.select("asked").distinct().withColumn("t", F.explode(tries)).select("asked", "t.*")
    best = names.join(keys, ["k", "kind"]).groupBy("asked").agg(F.min_by("id", F.struct("p", "id")).alias("model"))
    return asked.join(best, "asked", "left").select("doc_id", "asked", "model")


@query("join_sweep", """
WITH b AS (SELECT doc_id, unnest([0, CAST(n_chars // 3 AS INTEGER), CAST(n_chars // 2 AS INTEGER), CAST(n_chars AS INTEGER)]) AS place, unnest([0, 1, 2, 3]) AS kind, text FROM documents WHERE n_chars > 6),
l AS (SELECT doc_id, place, kind, lead(place) OVER (PARTITION BY doc_id ORDER BY place, kind) AS nxt, text FROM b)
SELECT doc_id, place, CAST(kind AS INTEGER) AS kind, sha256(text[place + 1 : nxt]) AS piece FROM l WHERE nxt > place""")
def join_sweep(spark, sf):
    """JOIN18, WIN2: a text cut at page starts and highlights, in order of place and kind."""
    n = F.col("n_chars")
    marks = F.array(*[F.struct(at.cast("int").alias("place"), F.lit(k).alias("kind")) for k, at in enumerate((F.lit(0), F.floor(n / 3), F.floor(n / 2), n))])
    rows = table(spark, sf, "documents").where("n_chars > 6").select("doc_id", "text", F.explode(marks).alias("m")).select("doc_id", "text", "m.*")
    rows = rows.withColumn("next", F.lead("place").over(Window.partitionBy("doc_id").orderBy("place", "kind"))).where("next > place")
    return rows.select("doc_id", "place", "kind", F.sha2(F.substring(F.col("text"), F.col("place") + 1, F.col("next") - F.col("place")), 256).alias("piece"))


@query("agg_first_events", "SELECT user_id AS run_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS events, coalesce(max(event_id) FILTER (event_type = 'none'), 0) AS seen FROM events GROUP BY user_id")
def agg_first_events(spark, sf):
    """AGG2, AGG3: first and last event of each run."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("events"), F.coalesce(F.max(F.when(F.col("event_type") == "none", F.col("event_id"))), F.lit(0)).alias("seen"))


_STATE = "list_extract(['planned', 'active', 'completed', 'reused', 'failed'], CAST(event_id % 5 + 1 AS BIGINT))"


@query("agg_progress", f"""
WITH e AS (SELECT user_id, user_id % 3 AS level, {_STATE} AS state FROM events)
SELECT level, count(*) FILTER (state IN ('completed', 'reused')) AS done, count(*) FILTER (state = 'reused') AS reused, count(*) FILTER (state = 'failed') AS failed, count(*) AS total FROM e GROUP BY level""")
def agg_progress(spark, sf):
    """AGG4, FLT2: progress by level."""
    state = F.element_at(F.array(*map(F.lit, ("planned", "active", "completed", "reused", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("level")).agg(F.count_if(state.isin("completed", "reused")).alias("done"), F.count_if(state == "reused").alias("reused"), F.count_if(state == "failed").alias("failed"), F.count("*").alias("total"))


@query("agg_mode_median", """
WITH f AS (SELECT l_suppkey AS doc, CAST(l_quantity AS BIGINT) AS size, length(l_returnflag) + l_linenumber AS chars FROM lineitem),
m AS (SELECT doc, size, sum(chars) AS c FROM f GROUP BY doc, size)
SELECT doc, (SELECT size FROM m WHERE m.doc = f.doc ORDER BY c DESC, size LIMIT 1) AS body_size, list_extract(list_sort(list(size)), count(*) // 2 + 1) AS upper_median FROM f GROUP BY doc""")
def agg_mode_median(spark, sf):
    """AGG14, ING9: the size that most characters have, and the upper median."""
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_quantity").cast("long").alias("size"), (F.length("l_returnflag") + F.col("l_linenumber")).alias("chars"))
    sizes = f.groupBy("doc", "size").agg(F.sum("chars").alias("c"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc").orderBy("size"))
    total = F.sum("n").over(Window.partitionBy("doc"))
    # the element after half of all, from the counts of each size
    median = sizes.withColumn("upto", before).withColumn("total", total).where(F.col("upto") >= F.floor(F.col("total") / 2) + 1).groupBy("doc").agg(F.min("size").alias("upper_median"))
    return sizes.groupBy("doc").agg(F.max_by("size", F.struct("c", -F.col("size"))).alias("body_size")).join(median, "doc")


@query("agg_seeds", """
SELECT l_shipdate IS NOT NULL AS shipped, l_returnflag AS condition, CAST(avg(l_quantity) AS DOUBLE) AS mean, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, count(DISTINCT l_linenumber) AS seeds, count(*) FILTER (l_discount > 0.05) AS failed, CAST(100.0 * count(*) / sum(count(*)) OVER () AS DOUBLE) AS share FROM lineitem GROUP BY 1, 2""")
def agg_seeds(spark, sf):
    """AGG15, SNK9, WIN8: means over seeds, status counts and shares."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").isNotNull().alias("shipped"), F.col("l_returnflag").alias("condition")).agg(F.avg("l_quantity").alias("mean"), F.min("l_quantity").cast("double").alias("low"), F.max("l_quantity").cast("double").alias("high"), F.countDistinct("l_linenumber").alias("seeds"), F.count_if(F.col("l_discount") > 0.05).alias("failed"), F.count("*").alias("n"))
    return g.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")


@query("agg_usage", "SELECT l_orderkey AS work_id, count(*) AS attempts, CAST(sum(l_quantity) AS DOUBLE) AS tokens, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS states FROM lineitem GROUP BY l_orderkey")
def agg_usage(spark, sf):
    """AGG16: usage by work item."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("work_id")).agg(F.count("*").alias("attempts"), F.sum("l_quantity").cast("double").alias("tokens"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("states"))


@query("agg_constant", """
WITH d AS (SELECT l_linestatus AS probe, CAST(l_quantity + 18 - l_quantity + CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN -1 ELSE 0 END AS BIGINT) AS diff FROM lineitem)
SELECT probe, count(DISTINCT diff) = 1 AND count(*) >= 3 AS constant, CASE WHEN count(DISTINCT diff) = 1 THEN min(diff) END AS overhead, max(diff) AS most FROM d GROUP BY probe""")
def agg_constant(spark, sf):
    """AGG23: probes whose overhead is one constant."""
    d = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("probe"), (F.lit(18) + F.when((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O"), -1).otherwise(0)).cast("long").alias("diff"))
    same = F.countDistinct("diff") == 1
    return d.groupBy("probe").agg((same & (F.count("*") >= 3)).alias("constant"), F.when(same, F.min("diff")).alias("overhead"), F.max("diff").alias("most"))


@query("agg_resolve", """
SELECT o_orderkey AS run_id, CASE WHEN sha256('' || o_totalprice) = sha256('' || (o_totalprice + o_orderkey % 2)) THEN 'completed' WHEN o_orderstatus = 'F' THEN 'stopped' ELSE 'interrupted' END AS state FROM orders""")
def agg_resolve(spark, sf):
    """AGG24, SNK3, CTL7: what a run is after a restart: digests agree, it was stopping, or it was interrupted."""
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.sha2(p.cast("string"), 256) == F.sha2((p + F.col("o_orderkey") % 2).cast("string"), 256), "completed").when(F.col("o_orderstatus") == "F", "stopped").otherwise("interrupted").alias("state"))


@query("agg_assemble", """
SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS parts, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def agg_assemble(spark, sf):
    """AGG20, SNK8: ordered text aggregation."""
    t = table(spark, sf, "conversations").where("text is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return t.groupBy("conv_id").agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("parts"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n_chars"))


@query("win_order", """
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INTEGER) AS ord, lead(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS nxt, n_chars - lag(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS gap,
       CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, CAST(ntile(4) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INTEGER) AS bucket, CAST(dense_rank() OVER (PARTITION BY source ORDER BY lang) AS INTEGER) AS style FROM documents""")
def win_order(spark, sf):
    """WIN1 to WIN7: order numbers, neighbours, running offsets, balanced buckets and style ranks."""
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.row_number().over(w).alias("ord"), F.lead("n_chars").over(w).alias("nxt"), (n - F.lag("n_chars").over(w)).alias("gap"),
        F.coalesce(F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.ntile(4).over(w).alias("bucket"), F.dense_rank().over(Window.partitionBy("source").orderBy("lang")).alias("style"),
    )


@query("win_repeats", "SELECT event_id, nullif(first_value(event_id) OVER (PARTITION BY sha256(props || event_type) ORDER BY event_id), event_id) AS repeats FROM events")
def win_repeats(spark, sf):
    """WIN15: the first request that is the same; the first of a group is combined, then joined."""
    e = table(spark, sf, "events").select("event_id", F.sha2(F.concat("props", "event_type"), 256).alias("h"))
    return e.join(e.groupBy("h").agg(F.min("event_id").alias("first")), "h").select("event_id", F.nullif("first", "event_id").alias("repeats"))


@query("win_clusters", """
WITH s AS (SELECT DISTINCT l_suppkey AS doc, l_quantity AS size FROM lineitem),
g AS (SELECT doc, size, CASE WHEN size > 1.05 * lag(size) OVER (PARTITION BY doc ORDER BY size) THEN 1 ELSE 0 END AS brk FROM s),
c AS (SELECT doc, size, sum(brk) OVER (PARTITION BY doc ORDER BY size) AS cluster FROM g)
SELECT doc, CAST(cluster AS BIGINT) AS cluster, CAST(min(size) AS DOUBLE) AS low, CAST(max(size) AS DOUBLE) AS high, count(*) AS sizes FROM c GROUP BY doc, cluster""")
def win_clusters(spark, sf):
    """ING10: sizes chained within five in a hundred, gaps and islands."""
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_quantity").alias("size")).distinct()
    w = Window.partitionBy("doc").orderBy("size")
    c = s.withColumn("brk", F.when(F.col("size") > 1.05 * F.lag("size").over(w), 1).otherwise(0)).withColumn("cluster", F.sum("brk").over(w))
    return c.groupBy("doc", "cluster").agg(F.min("size").cast("double").alias("low"), F.max("size").cast("double").alias("high"), F.count("*").alias("sizes"))


@query("win_headings_before", """
WITH b AS (SELECT doc_id, CAST(unnest(range(CAST(0 AS BIGINT), n_chars, 400)) AS INTEGER) AS start, n_chars FROM documents)
SELECT doc_id, start, CAST(count(*) FILTER (start % 1200 = 0) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS headings FROM b""")
def win_headings_before(spark, sf):
    """WIN14, WIN9: headings before each sentence."""
    b = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_chars").cast("int") - 1, F.lit(400))).alias("start"))
    return b.withColumn("headings", F.count_if(F.col("start") % 1200 == 0).over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))


@query("srt_newest", "SELECT o_orderkey AS run_id, o_custkey AS document_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def srt_newest(spark, sf):
    """SRT1, SRT8: the twenty newest runs, a report of fixed size."""
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"))


@query("srt_window", "SELECT doc_id, CAST(k AS INTEGER) AS k FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k BETWEEN 6 AND 15")
def srt_window(spark, sf):
    """SRT9: a page of rows of each list."""
    return table(spark, sf, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("k")).where("k between 6 and 15")


@query("srt_tree", """
WITH RECURSIVE t AS (SELECT doc_id, printf('%06d', doc_id) AS path, 0 AS depth FROM documents WHERE doc_id = 0
UNION ALL SELECT d.doc_id, t.path || '/' || printf('%06d', d.doc_id), depth + 1 FROM t JOIN documents d ON d.doc_id > 0 AND (d.doc_id - 1) // 4 = t.doc_id)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, path FROM t""")
def srt_tree(spark, sf):
    """SRT3, SRT10, SEC5, JOIN9: a tree in depth-first order by a path; a node's path is made of its ancestors' ids."""
    docs = table(spark, sf, "documents").select("doc_id")
    level = docs.where("doc_id = 0").select("doc_id", F.format_string("%06d", "doc_id").alias("path"), F.lit(0).alias("depth"))
    done, below = level, docs.where("doc_id > 0").withColumn("parent", F.floor((F.col("doc_id") - 1) / 4).cast("long"))
    depth = 0
    while not level.isEmpty():
        depth += 1
        level = reduce.stored(below.join(level.withColumnRenamed("doc_id", "parent"), "parent").select("doc_id", F.concat_ws("/", "path", F.format_string("%06d", "doc_id")).alias("path"), F.lit(depth).alias("depth")), "tree-level")
        done = done.unionByName(level)
    return done


@query("srt_plan_order", """
SELECT p.o_orderkey AS work_id, p.o_custkey AS plan, CAST(row_number() OVER (PARTITION BY p.o_custkey ORDER BY p.o_orderdate, p.o_orderkey) AS INTEGER) AS position, coalesce(a.n, 0) AS n FROM orders p LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_orderkey = p.o_orderkey""")
def srt_plan_order(spark, sf):
    """SRT11: results in the order of their plan, whatever the order they came in."""
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    plan = table(spark, sf, "orders").withColumn("position", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    got = plan.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return got.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("plan"), "position", F.coalesce("n", F.lit(0)).alias("n"))


@query("set_operations", r"""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text[1 : length(text) // 2]), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(text[length(text) // 3 :]), '[\p{L}\p{N}]+')) AS b FROM documents)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either, CAST(len(a) - len(list_intersect(a, b)) AS INTEGER) AS only_a, list_has_all(a, b) AS subset FROM t""")
def set_operations(spark, sf):
    """SET1 to SET4: unions, intersections, differences and subsets of term sets."""
    t = table(spark, sf, "documents").select("doc_id", T.terms(F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))).alias("a"), T.terms(F.substring(F.col("text"), F.greatest(F.floor(F.length("text") / 3).cast("int"), F.lit(1)), F.length("text"))).alias("b"))
    return t.select("doc_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_a"), (F.size(F.array_except("b", "a")) == 0).alias("subset"))


@query("flt_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.net') AND NOT contains(lower(html), 'zzzz')")
def flt_search(spark, sf):
    """FLT1: a search that ignores case."""
    return table(spark, sf, "pages").where(F.contains(F.lower("url"), F.lit("example.net")) & ~F.contains(F.lower("html"), F.lit("zzzz"))).select("page_id", "url")


@query("flt_range", "SELECT event_id, event_type FROM events WHERE event_id > 100 AND event_id <= 700 AND event_type IN ('click', 'view', 'purchase') AND (value IS NULL OR value <> 0)")
def flt_range(spark, sf):
    """FLT2 to FLT4: a cursor range, membership, null or unequal."""
    return table(spark, sf, "events").where("event_id > 100 and event_id <= 700 and event_type in ('click', 'view', 'purchase') and (value is null or value <> 0)").select("event_id", "event_type")


@query("flt_literal_kept", r"""
WITH n AS (SELECT doc_id, text, CAST(doc_id % 90 + 10 AS VARCHAR) AS lit FROM documents)
SELECT doc_id, regexp_matches('x' || doc_id || ' ' || text, '(?:^|[^0-9])' || lit || '(?:[^0-9]|$)') AS kept FROM n""")
def flt_literal_kept(spark, sf):
    """FLT8: a number is kept only as a whole number."""
    t = F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    lit = (F.col("doc_id") % 90 + 10).cast("string")
    return table(spark, sf, "documents").select("doc_id", F.regexp_like(t, F.concat(F.lit("(?:^|[^0-9])"), lit, F.lit("(?:[^0-9]|$)"))).alias("kept"))


@query("sec_spans", """
WITH h AS (SELECT doc_id, CAST(unnest(range(CAST(0 AS BIGINT), n_chars, 300)) AS INTEGER) AS start, n_chars FROM documents),
o AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS ord, start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n_chars) AS INTEGER) AS "end", CAST(start // 300 * 7 % 4 + 1 AS INTEGER) AS level FROM h)
SELECT doc_id, ord, 'h' || start AS title, level, start, "end", (SELECT max(p.ord) FROM o p WHERE p.doc_id = o.doc_id AND p.ord < o.ord AND p.level < o.level AND NOT EXISTS (SELECT 1 FROM o q WHERE q.doc_id = o.doc_id AND q.ord > p.ord AND q.ord < o.ord AND q.level <= p.level)) AS parent_ord FROM o""")
def sec_spans(spark, sf):
    """SEC1, WIN13: own spans and parents of an outline."""
    docs = table(spark, sf, "documents").where("n_chars > 0")
    outline = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_chars").cast("int") - 1, F.lit(300))).alias("start"))
    outline = outline.select("doc_id", "start", F.concat(F.lit("h"), F.col("start").cast("string")).alias("title"), (F.floor(F.col("start") / 300) * 7 % 4 + 1).cast("int").alias("level"))
    return sections.own_spans(outline, docs.select("doc_id", F.col("n_chars").cast("int").alias("n")))


def _sectioned(spark, sf):
    """Documents with an outline of every fifth line."""
    docs = table(spark, sf, "documents")
    lines = F.split("text", "\n", -1)
    fives = segments.runs(F.transform(lines, lambda x: F.lit(1)), F.transform(lines, lambda x: F.length(x) + 1), F.lit(5))
    outline = F.transform(fives, lambda r: F.struct(r["start"].cast("int").alias("start"), F.substring(F.element_at(lines, r["first"] + 1), 1, 40).alias("title"), (F.pmod(r["first"], F.lit(15)) / 5 + 1).cast("int").alias("level")))
    return docs.select("doc_id", "text", outline.alias("outline"))


@query("sec_tree")
def sec_tree(spark, sf):
    """SEC1, SEC2, SEC3, I5: section trees with small sections folded."""
    return sections.section_trees(_sectioned(spark, sf), 300)


@query("sec_shares", """
SELECT l_orderkey AS doc_id, l_linenumber AS section, CAST(round_even(500 * CAST(l_quantity AS DOUBLE) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 0) AS BIGINT) AS own_share,
       greatest(20, CAST(round_even(500 * CAST(l_quantity AS DOUBLE) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 0) AS BIGINT)) AS target FROM lineitem""")
def sec_shares(spark, sf):
    """SEC4: shares of a target, at least a sentence; half to even."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section"), F.col("l_quantity").cast("double").alias("own_words"))
    return sections.shares(s, F.lit(500)).select("doc_id", "section", "own_share", "target")


@query("sec_own_text")
def sec_own_text(spark, sf):
    """SEC6: sections with text of their own."""
    return sections.own_text_spans(sections.section_trees(_sectioned(spark, sf), 300)).select("doc_id", "section_id", "start", "end")


@query("sec_subtree")
def sec_subtree(spark, sf):
    """SEC5: pages of each section with all below it."""
    found = sections.section_trees(_sectioned(spark, sf), 300).withColumn("page_start", (F.floor(F.col("start") / 700) + 1).cast("int")).withColumn("page_end", (F.floor(F.greatest(F.col("end") - 1, F.col("start")) / 700) + 1).cast("int"))
    return sections.subtree_pages(found)
