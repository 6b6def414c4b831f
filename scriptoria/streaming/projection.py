"""The run log and the state of its nodes, in batch and as a stream.

Events: run_id, node_id, event_id (monotone), ts, state (planned, active, retrying, completed, reused, failed), summary,
message. A node's row: a completed node isn't planned anew; a re-ask keeps the start of the first call; a reused node
keeps the times of an earlier attempt that completed it, else it has none; summaries are kept where an event has none."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "run_id long, node_id string, event_id long, ts timestamp, state string, summary string, message string"
ROW = "state string, started_at timestamp, completed_at timestamp, summary string, error string, provisional boolean, updated_event_id long"
#: A node's latest events that the stream holds back, so that one which arrives late is folded in its own place.
HELD = 64
KEYS = ["run_id", "node_id"]


def folded(row: Column, e: Column) -> Column:
    """The row after one event; row is null before the first."""
    new, done = row.isNull(), row["state"] == "completed"
    kind, null_ts = e["state"], F.lit(None).cast("timestamp")
    finished = kind.isin("completed", "reused")
    calling = kind.isin("active", "retrying")
    old = lambda c: F.when(~new, row[c])
    state = F.when(kind == "planned", "pending").when(calling, "active").when(finished, "completed").otherwise("failed")
    started = (
        F.when(calling, F.when(row["state"] == "active", F.coalesce(row["started_at"], e["ts"])).otherwise(e["ts"]))
        .when(kind == "reused", F.when(done, row["started_at"])).when(kind == "planned", null_ts).otherwise(old("started_at"))
    )
    completed = F.when(kind == "reused", F.when(done, F.coalesce(row["completed_at"], e["ts"])).otherwise(e["ts"])).when(kind == "completed", e["ts"]).otherwise(null_ts)
    next_row = F.struct(
        state.alias("state"), started.alias("started_at"), completed.alias("completed_at"), F.when(finished, F.coalesce(e["summary"], old("summary"))).otherwise(old("summary")).alias("summary"),
        F.when(kind == "failed", F.coalesce(e["message"], F.lit("Failed"))).alias("error"), F.when(finished, False).otherwise(F.coalesce(old("provisional"), F.lit(True))).alias("provisional"), e["event_id"].alias("updated_event_id"),
    )
    return F.when(F.coalesce((kind == "planned") & done, F.lit(False)), row).otherwise(next_row)


def projected(events: DataFrame) -> DataFrame:
    """One row per node, folded in the order of event ids; a node has few events, a run may have many nodes."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "ts", "state", "summary", "message")))
    rows = events.groupBy(*KEYS).agg(ordered.alias("e"))
    start = F.lit(None).cast(f"struct<{ROW.replace(' ', ':').replace(',:', ',')}>")
    return rows.select(*KEYS, F.aggregate("e", start, folded).alias("r")).select(*KEYS, "r.*")


class Event(NamedTuple):
    event_id: int
    ts: object
    state: str
    summary: str | None
    message: str | None


def apply(row: tuple | None, e) -> tuple:
    """The same rules in Python, for the stream's state; row and result are in ROW's order."""
    state, started, completed, summary, _, provisional, _ = row or (None, None, None, None, None, True, None)
    kind, ts = e.state, e.ts
    if kind == "planned":
        return row if state == "completed" else ("pending", None, None, summary, None, provisional, e.event_id)
    if kind in ("active", "retrying"):
        return ("active", started if state == "active" and started is not None else ts, None, summary, None, provisional, e.event_id)
    if kind in ("completed", "reused"):
        if kind == "reused":
            started, completed = (started, completed or ts) if state == "completed" else (None, ts)
        else:
            completed = ts
        return ("completed", started, completed, e.summary if e.summary is not None else summary, None, False, e.event_id)
    return ("failed", started, None, summary, e.message if e.message is not None else "Failed", provisional, e.event_id)


def streamed(events: DataFrame, held: int = HELD) -> DataFrame:
    """The projection as a stream: each micro-batch emits the rows of the nodes that it touched.

    A node's state is the row of all but its `held` latest events, the id of the last event in that row, and those events. An
    event that arrives late is put in its place among them and the row is folded anew; one older than all of them is dropped,
    and so is one that is delivered again. The state doesn't grow beyond that."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from scriptoria.sources.arrow import importable

    importable(events.sparkSession)

    def clean(v):
        return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v

    def update(key, parts, state) -> Iterator[pd.DataFrame]:
        *base, last, recent = map(clean, state.get) if state.exists else (*[None] * 7, -1, "[]")
        base = tuple(base) if base[0] is not None else None
        kept = {e[0]: Event(e[0], pd.Timestamp(e[1]) if e[1] else None, *e[2:]) for e in json.loads(recent)}
        for e in pd.concat(list(parts)).itertuples(index=False):
            if e.event_id > last and e.event_id not in kept:
                kept[e.event_id] = Event(int(e.event_id), clean(e.ts), e.state, clean(e.summary), clean(e.message))
        row, order = base, sorted(kept)
        for i, n in enumerate(order):
            row = apply(row, kept[n])
            if i == len(order) - held - 1:
                base, last = row, n
        state.update((*(base or [None] * 7), last, json.dumps([(*e[:1], e.ts.isoformat() if e.ts is not None else None, *e[2:]) for e in (kept[n] for n in order if n > last)])))
        if row is not None:
            yield pd.DataFrame([(*key, *row)], columns=[*KEYS, *(c.split()[0] for c in ROW.split(", "))])

    return events.groupBy(*KEYS).applyInPandasWithState(update, f"run_id long, node_id string, {ROW}", f"{ROW}, last_event_id long, recent string", "update", GroupStateTimeout.NoTimeout)


def throttled(snapshots: DataFrame, key: str, at: str, order: str, interval: float) -> DataFrame:
    """The snapshots that are written (key, at in seconds, order): the first of a key, then each that comes `interval` seconds or more after the
    one written before it, and the last, which is flushed at the end if it was held back (flushed)."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(at).cast("double").alias("at"))))
    start = F.struct(F.array().cast(f"array<{dict(snapshots.dtypes)[order]}>").alias("written"), F.lit(None).cast("double").alias("last"))

    def step(s, e):
        due = s["last"].isNull() | (e["at"] - s["last"] >= interval)
        return F.when(due, F.struct(F.concat(s["written"], F.array(e["order"])).alias("written"), e["at"].alias("last"))).otherwise(s)

    found = snapshots.groupBy(key).agg(steps.alias("e")).select(key, F.aggregate("e", start, step, lambda s: s["written"]).alias("w"), F.element_at("e", -1)["order"].alias("end"))
    every = F.when(F.array_contains("w", F.col("end")), F.col("w")).otherwise(F.concat("w", F.array("end")))
    rows = found.select(key, "w", F.explode(every).alias(order))
    return rows.select(key, order, (~F.array_contains("w", F.col(order))).alias("flushed"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def polled(events: DataFrame, after: int) -> DataFrame:
    """Runs that changed after a cursor, and the cursor up to which this is so: one snapshot."""
    new = events.where(F.col("event_id") > after)
    return new.groupBy("run_id").agg(F.count("*").alias("events"), F.max("event_id").alias("cursor"), F.max_by("state", "event_id").alias("state"))


def changed(snapshots: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Snapshots that differ from the one before in these columns."""
    from pyspark.sql import Window

    mark = F.sha2(F.to_json(F.struct(*columns)), 256)
    before = F.lag("mark").over(Window.partitionBy(key).orderBy(order))
    return snapshots.withColumn("mark", mark).withColumn("before", before).where(~F.col("mark").eqNullSafe(F.col("before"))).drop("mark", "before")


def run_stream(source: DataFrame, path: str, checkpoint: str) -> None:
    """Writes every micro-batch's changed rows under path; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    source.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
