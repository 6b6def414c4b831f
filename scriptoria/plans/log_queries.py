"""Queries of the run log: projection, polling, progress, suppression; in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.functions import numbers as N
from scriptoria.operators import reduce
from scriptoria.plans.registry import query, table
from scriptoria.streaming import projection

_STATES = ("planned", "active", "completed", "retrying", "reused", "failed", "planned")
_LOG = f"""log AS (SELECT user_id AS run_id, 'L' || (event_id % 3) || 'N' || lpad('' || (event_id % 5 + 1), 4, '0') AS node_id, event_id, ts,
  list_extract([{", ".join(f"'{s}'" for s in _STATES)}], CAST((event_id // 5 + user_id) % 7 + 1 AS BIGINT)) AS state,
  CASE WHEN event_id % 4 = 0 THEN 's' || event_id END AS summary, CASE WHEN event_id % 6 = 0 THEN 'm' || event_id END AS message FROM events)"""


def log(events):
    """The events as a run log."""
    e = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, _STATES)), ((F.floor(e / 5) + F.col("user_id")) % 7 + 1).cast("int"))
    return events.select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("L"), (e % 3).cast("string"), F.lit("N"), F.lpad((e % 5 + 1).cast("string"), 4, "0")).alias("node_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), state.alias("state"),
        F.when(e % 4 == 0, F.concat(F.lit("s"), e.cast("string"))).alias("summary"), F.when(e % 6 == 0, F.concat(F.lit("m"), e.cast("string"))).alias("message"),
    )


_FOLD = f"""{_LOG},
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, node_id ORDER BY event_id) AS n FROM log),
p AS (SELECT run_id, node_id, 1 AS n, CASE WHEN state = 'planned' THEN 'pending' WHEN state IN ('active', 'retrying') THEN 'active' WHEN state IN ('completed', 'reused') THEN 'completed' ELSE 'failed' END AS state,
   CASE WHEN state IN ('active', 'retrying') THEN ts END AS started_at, CASE WHEN state IN ('completed', 'reused') THEN ts END AS completed_at, CASE WHEN state IN ('completed', 'reused') THEN summary END AS summary,
   CASE WHEN state = 'failed' THEN coalesce(message, 'Failed') END AS error, state NOT IN ('completed', 'reused') AS provisional, event_id AS updated_event_id FROM o WHERE n = 1
 UNION ALL
 SELECT p.run_id, p.node_id, o.n,
   CASE WHEN o.state = 'planned' THEN CASE WHEN p.state = 'completed' THEN 'completed' ELSE 'pending' END WHEN o.state IN ('active', 'retrying') THEN 'active' WHEN o.state IN ('completed', 'reused') THEN 'completed' ELSE 'failed' END,
   CASE WHEN o.state = 'planned' THEN CASE WHEN p.state = 'completed' THEN p.started_at END WHEN o.state IN ('active', 'retrying') THEN CASE WHEN p.state = 'active' THEN coalesce(p.started_at, o.ts) ELSE o.ts END
        WHEN o.state = 'reused' THEN CASE WHEN p.state = 'completed' THEN p.started_at END ELSE p.started_at END,
   CASE WHEN o.state = 'planned' THEN CASE WHEN p.state = 'completed' THEN p.completed_at END WHEN o.state = 'completed' THEN o.ts WHEN o.state = 'reused' THEN CASE WHEN p.state = 'completed' THEN coalesce(p.completed_at, o.ts) ELSE o.ts END END,
   CASE WHEN o.state IN ('completed', 'reused') THEN coalesce(o.summary, p.summary) ELSE p.summary END,
   CASE WHEN o.state = 'failed' THEN coalesce(o.message, 'Failed') WHEN o.state = 'planned' AND p.state = 'completed' THEN p.error END,
   CASE WHEN o.state IN ('completed', 'reused') THEN false ELSE p.provisional END,
   CASE WHEN o.state = 'planned' AND p.state = 'completed' THEN p.updated_event_id ELSE o.event_id END
 FROM p JOIN o ON o.run_id = p.run_id AND o.node_id = p.node_id AND o.n = p.n + 1)"""
_LAST = "(SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY run_id, node_id ORDER BY n DESC) = 1)"
_SHOWN = "run_id, node_id, state, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us, summary, error, provisional, updated_event_id"


def _shown(rows):
    return rows.select("run_id", "node_id", "state", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"), "summary", "error", "provisional", "updated_event_id")


@query("stm_projection", f"WITH RECURSIVE {_FOLD} SELECT {_SHOWN} FROM {_LAST}")
def stm_projection(spark, sf):
    """STM1, STM4, SNK6: the state of every node."""
    return _shown(projection.projected(log(table(spark, sf, "events"))))


@query("stm_stream", f"WITH RECURSIVE {_FOLD} SELECT {_SHOWN} FROM {_LAST}")
def stm_stream(spark, sf):
    """STM1 to STM4: the same rows by a stream with keyed state, to which events come out of order in several files; the last row of each node is its state."""
    events = log(table(spark, sf, "events"))
    root = f"{reduce.shared_root(spark)}/stream-{uuid.uuid4().hex}"
    for part in (1, 2, 0):  # one micro-batch each, in the order of writing
        events.where(F.floor(F.col("event_id") / 3) % 3 == part).write.mode("append").parquet(f"{root}/in/part={(part - 1) % 3}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in/part=*")
    projection.run_stream(projection.streamed(source), f"{root}/rows", f"{root}/checkpoint")
    rows = spark.read.parquet(f"{root}/rows")
    return _shown(projection.latest(rows.withColumnRenamed("batch", "version"), projection.KEYS, "version"))


@query("stm_progress", f"""
WITH RECURSIVE {_FOLD}, l AS (SELECT run_id, CAST(node_id[2:2] AS INTEGER) AS level, state FROM {_LAST})
SELECT run_id, level, count(*) FILTER (state = 'completed') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'active') AS active, count(*) AS total FROM l GROUP BY run_id, level""")
def stm_progress(spark, sf):
    """STM6, AGG4: progress of every run and level."""
    rows = projection.projected(log(table(spark, sf, "events"))).withColumn("level", F.substring("node_id", 2, 1).cast("int"))
    is_ = lambda s: F.count_if(F.col("state") == s)
    return rows.groupBy("run_id", "level").agg(is_("completed").alias("done"), is_("failed").alias("failed"), is_("active").alias("active"), F.count("*").alias("total"))


@query("stm_poll", f"WITH {_LOG} SELECT run_id, count(*) AS events, max(event_id) AS cursor, arg_max(state, event_id) AS state FROM log WHERE event_id > 500 GROUP BY run_id")
def stm_poll(spark, sf):
    """STM2, STM3, FLT3: what changed after a cursor, one row per run."""
    return projection.polled(log(table(spark, sf, "events")), 500)


@query("stm_suppress", """
WITH s AS (SELECT user_id, event_id, event_type, event_id % 2 AS parity FROM events), l AS (SELECT *, lag(event_type) OVER w AS t, lag(parity) OVER w AS q FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, event_type FROM l WHERE t IS NULL OR t <> event_type OR q <> parity""")
def stm_suppress(spark, sf):
    """STM8, STM9: a snapshot is sent only if it differs from the one before."""
    s = table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 2).alias("parity"))
    return projection.changed(s, "user_id", "event_id", ["event_type", "parity"]).select("user_id", "event_id", "event_type")


@query("stm_throttled", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, s AS written, true AS due FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.s - w.written >= 86400 THEN e.s ELSE w.written END, e.s - w.written >= 86400 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, NOT due AS flushed FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM w) WHERE due OR n = m""")
def stm_throttled(spark, sf):
    """STM7: snapshots are written a day apart at least, and the last one at the end."""
    s = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return projection.throttled(s, "user_id", "at", "event_id", 86400.0)


@query("stm_merge", "SELECT user_id, event_type, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stm_merge(spark, sf):
    """STM10: two deliveries of events are merged, the newest wins."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("version"), "value")
    return projection.latest(e.unionByName(e), ["user_id", "event_type"], "version")


@query("stm_adopt", f"""
WITH RECURSIVE {_FOLD}, l AS (SELECT run_id, node_id, CAST(node_id[2:2] AS INTEGER) AS level FROM {_LAST}),
t AS (SELECT run_id, max(level) AS top, count(*) FILTER (level = m) AS tops FROM (SELECT *, max(level) OVER (PARTITION BY run_id) AS m FROM l) GROUP BY run_id)
SELECT l.run_id, l.node_id, c.node_id AS parent_id, CASE WHEN l.level = top AND tops = 1 THEN 'Root · Level ' || top END AS root_label
FROM l JOIN t USING (run_id) LEFT JOIN l c ON c.run_id = l.run_id AND c.level = l.level + 1 AND CAST(c.node_id[4:] AS INTEGER) = (CAST(l.node_id[4:] AS INTEGER) + 1) // 2""")
def stm_adopt(spark, sf):
    """STM5, JOIN9, STR9: parents adopt their children; a single node of the top level is the root."""
    n = projection.projected(log(table(spark, sf, "events"))).select("run_id", "node_id", F.substring("node_id", 2, 1).cast("int").alias("level"), F.substring("node_id", 4, 9).cast("int").alias("number"))
    n = reduce.stored(n, "nodes")
    parents = n.select("run_id", (F.col("level") - 1).alias("level"), F.explode(F.array(2 * F.col("number") - 1, 2 * F.col("number"))).alias("number"), F.col("node_id").alias("parent_id"))
    tops = n.groupBy("run_id", "level").agg(F.count("*").alias("tops")).groupBy("run_id").agg(F.max_by(F.struct("level", "tops"), "level").alias("t")).select("run_id", F.col("t.level").alias("top"), F.col("t.tops").alias("tops"))
    rows = n.join(parents, ["run_id", "level", "number"], "left").join(tops, "run_id")
    return rows.select("run_id", "node_id", "parent_id", F.when((F.col("level") == F.col("top")) & (F.col("tops") == 1), F.concat(F.lit("Root · Level "), F.col("top").cast("string"))).alias("root_label"))


@query("agg_eta", """
SELECT event_id, CASE WHEN c >= 3 AND s > 0 THEN CASE WHEN r = 0 THEN 0.0 ELSE round_even(r * s / c, 1) END END AS eta FROM (SELECT event_id, event_id % 11 AS r, event_id % 7 AS c, CAST(event_id % 50 AS DOUBLE) AS s FROM events)""")
def agg_eta(spark, sf):
    """AGG22: seconds left at the pace of the calls so far."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", N.eta(e % 11, e % 7, (e % 50).cast("double")).alias("eta"))


@query("ext_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_windows(spark, sf):
    """An extension: event-time windows, which the log itself doesn't need."""
    return table(spark, sf, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("w.start").alias("hour_us"), "n", "total")
