"""Where each piece of a packing goes, without moving texts or gathering pieces.

A packing is planned on the driver over the histogram of lengths, which has at most `capacity` entries however
large the corpus is. A plan is a table of placements: pieces of one length with ranks from `rank` on, `count` of
them, `each` in every sequence, go to sequences from `sequence` on at `offset`. Ranks within a length are dealt
by salt, so that a length that a third of all pieces have isn't one task's work."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS, BLOCK = 256, 1024


class Placement(NamedTuple):
    length: int
    rank: int  # of the first piece
    count: int
    each: int  # of these pieces in a sequence
    sequence: int  # the first
    offset: int  # of the first of them in each sequence


SCHEMA = "p_length long, p_rank long, p_count long, p_each long, p_sequence long, p_offset long"


def histogram(pieces: DataFrame) -> dict[int, int]:
    """At most `capacity` entries."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def placed(pieces: DataFrame, plan: list[Placement], key: list[str]) -> DataFrame:
    """pieces (length and more) get sequence_id and offset. key: columns that order pieces."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)))
    counted = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # at most SALTS rows a length
    own = Window.partitionBy("length", "salt").orderBy(*key)
    ranked = pieces.withColumn("own_rank", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own_rank"))
    rows = spark.createDataFrame(pd.DataFrame([tuple(p) for p in plan], columns=list(Placement._fields)).astype("int64") if plan else [], SCHEMA)
    wide = F.lit(BLOCK)  # an equi-join on (length, block of ranks): a placement is listed in each block that it touches
    slots = rows.withColumnRenamed("p_length", "length").withColumn("block", F.explode(F.sequence(F.floor(F.col("p_rank") / wide), F.floor((F.col("p_rank") + F.col("p_count") - 1) / wide))))
    hit = ranked.withColumn("block", F.floor(F.col("rank") / wide)).join(slots, ["length", "block"]).where("rank >= p_rank and rank < p_rank + p_count")
    within = F.col("rank") - F.col("p_rank")
    return hit.withColumn("sequence_id", F.col("p_sequence") + F.floor(within / F.col("p_each"))).withColumn("offset", F.col("p_offset") + F.pmod(within, F.col("p_each")) * F.col("length")).drop(
        "salt", "own_rank", "base", "rank", "block", "p_rank", "p_count", "p_each", "p_sequence", "p_offset"
    )
