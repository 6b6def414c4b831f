"""The ordered tree reduction: balanced groups, levels, merge calls, and a deterministic merge of extractive summaries.

Levels run one after the other; within a level every group of every document is merged at once. A level reads the one
before it from a table in the shared folder, so that lineage stays short and a lost executor costs one level."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; an own one in local runs where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='scriptoria-')}")
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no more."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_sizes(count: Column, fanout: Column | int) -> Column:
    """array<int>: sizes of balanced groups in order, the first ones one larger."""
    groups = F.ceil(count / fanout).cast("int")
    base, more = F.floor(count / groups).cast("int"), F.pmod(count.cast("int"), groups)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), groups - 1), lambda i: base + F.when(i < more, 1).otherwise(0))).otherwise(F.array().cast("array<int>"))


def merge_calls(leaves: Column, fanout: int, levels: int = 40) -> Column:
    """Calls that reduce so many nodes to one; groups of one pass through."""
    start = F.struct(leaves.cast("long").alias("n"), F.lit(0).cast("long").alias("calls"))

    def step(s, _):
        groups = F.ceil(s["n"] / fanout).cast("long")
        # balanced groups are all of two or more, or only n - groups of them are
        calls = F.when(s["n"] >= 2 * groups, groups).otherwise(s["n"] - groups)
        return F.when(s["n"] > 1, F.struct(groups.alias("n"), (s["calls"] + calls).alias("calls"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step, lambda s: s["calls"])


def fanout(largest: Column, capacity: Column, ceiling: int | None = None) -> Column:
    """How many children of the largest size fit one request; null if not even two do."""
    n = F.floor(capacity / largest).cast("int")
    n = F.least(n, F.lit(ceiling)) if ceiling else n
    return F.when(n >= 2, n)


def narrowed(costs: Column, ceiling: int, capacity: Column) -> Column:
    """The largest fanout up to `ceiling` with which every group of a level fits: a level whose groups don't fit is tried again with one child less;
    null if not even two fit. costs: of the level's nodes in order. A group of one is passed through and always fits."""
    n = F.size(costs)

    def fits(f):
        sizes = group_sizes(n, f)
        begins = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b))
        sums = F.zip_with(sizes, begins, lambda size, at: F.when(size > 1, F.aggregate(F.slice(costs, at + 1, size), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0))
        return F.forall(sums, lambda x: x <= capacity)

    return F.try_element_at(F.filter(F.sequence(F.lit(ceiling), F.lit(2), F.lit(-1)), fits), F.lit(1))


def tree(leaves: DataFrame, width: int, key: str = "doc_id", keep: int = 3) -> DataFrame:
    """All nodes of each document's tree: key, level, ord, node_id, children, covered, units.

    leaves: key, ord, segment_id, units (array of structs whose first field ranks them, best last). A merge keeps the
    `keep` best units of its children in their order; a group of one is passed through, stamped one level up."""
    none = F.array().cast("array<string>")
    level = stored(leaves.select(key, F.lit(0).alias("level"), F.col("ord").cast("int").alias("ord"), F.array("segment_id").alias("covered"), "units", none.alias("children")), "tree-0")
    done, number = level, 0
    # a document's nodes are counted once, over its keys alone; from then on each level's number follows from the one before
    rows = level.join(level.groupBy(key).agg(F.count("*").cast("int").alias("n")).where("n > 1"), key)
    while not rows.isEmpty():
        groups = F.ceil(F.col("n") / width).cast("int")
        base, more = F.floor(F.col("n") / groups).cast("int"), F.pmod(F.col("n"), groups)
        # the first `more` groups have base + 1 members
        own = F.when(F.col("ord") < more * (base + 1), F.floor(F.col("ord") / (base + 1))).otherwise(more + F.floor((F.col("ord") - more * (base + 1)) / base)).cast("int")
        number += 1
        members = F.array_sort(F.collect_list(F.struct("ord", "covered", "units", F.format_string("L%dN%04d", F.lit(number - 1), F.col("ord") + 1).alias("id"))))
        level = stored(
            rows.withColumn("group", own).groupBy(key, "group").agg(members.alias("m"), F.first(groups).alias("n")).select(
                key, F.lit(number).alias("level"), F.col("group").alias("ord"), F.array_distinct(F.flatten("m.covered")).alias("covered"), best(F.flatten("m.units"), keep).alias("units"), F.col("m.id").alias("children"), "n"
            ), f"tree-{number}",
        )
        done, rows = done.unionByName(level.drop("n")), level.where("n > 1")
    return done.withColumn("node_id", F.format_string("L%dN%04d", "level", F.col("ord") + 1))


def best(units: Column, keep: int) -> Column:
    """The `keep` units of highest rank, in their own order; of equal ones the earlier."""
    placed = F.transform(units, lambda u, i: F.struct((-u["rank"]).alias("r"), i.alias("i"), u.alias("u")))
    chosen = F.slice(F.array_sort(placed), 1, keep)
    return F.transform(F.array_sort(F.transform(chosen, lambda c: F.struct(c["i"].alias("i"), c["u"].alias("u")))), lambda c: c["u"])


def extracted(sentences: DataFrame, key: list[str], keep: int = 3) -> DataFrame:
    """The deterministic leaf record: the `keep` sentences of a segment with most distinct terms, each its own quote."""
    from scriptoria.functions import text as T

    ranked = sentences.withColumn("u", F.struct(F.col("ord"), F.struct(F.size(T.terms(F.col("text"))).alias("rank"), F.col("segment_id"), F.col("text").alias("quote")).alias("u")))
    units = F.transform(F.array_sort(F.collect_list("u")), lambda x: x["u"])
    return ranked.groupBy(*key).agg(best(units, keep).alias("units"))
