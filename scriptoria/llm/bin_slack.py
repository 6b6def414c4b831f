"""Packing documents into as few sequences as it can by minimum bin slack.

For each sequence a bitset subset-sum over the lengths that are left finds the fullest feasible combination
that holds the longest one; it is removed, as many times as the counts allow (the next search would find the
same). The search runs over the histogram of lengths, so its size doesn't depend on the number of documents.

Edge cases: null text is empty and gives the end token alone; documents longer than a sequence, and only those,
are cut losslessly; repeated rows are packed each; an empty table gives no rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common
from scriptoria.llm.placing import Placement, histogram, placed
from scriptoria.llm.tokens import encoder, tokenizer_path

CAPACITY, END = 4096, 1


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """The plan for pieces of these lengths, each at most capacity."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}  # longest first
    used = dict.fromkeys(left, 0)
    plan, sequence = [], 0
    while left:
        longest = next(iter(left))
        combination = fullest(left, longest, capacity)
        times = min(left[n] // k for n, k in combination.items())
        offset = 0
        for n, k in combination.items():
            plan.append(Placement(n, used[n], times * k, k, sequence, offset))
            offset += n * k
            used[n] += times * k
            left[n] -= times * k
            if not left[n]:
                del left[n]
        sequence += times
    return plan


def fullest(left: dict[int, int], longest: int, capacity: int) -> dict[int, int]:
    """Length to number of the combination with `longest` whose sum is nearest to capacity from below."""
    room = capacity - longest
    mask, goal, reach, steps = (1 << (room + 1)) - 1, 1 << room, 1, []
    for n, c in left.items():
        most = min(c - (n == longest), room // n)
        k = 1
        while most > 0:  # 1, 2, 4 ... of this length
            k = min(k, most)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            most -= k
            k *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    out = {longest: 1}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + k
            total -= n * k
    return out


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""

    def work(batch):
        code = encoder(path)
        last = np.array([end], code.kind).tobytes()
        ids, out = batch.column("doc_id").to_pylist(), []
        for doc, got in zip(ids, code.encode(batch.column("text").cast("binary").to_pylist()), strict=True):
            got += last
            n = len(got) // 4
            out += [(doc, i // capacity, i, min(capacity, n - i), zlib.crc32(got[4 * i : 4 * (i + capacity)])) for i in range(0, n, capacity)]
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*out, strict=True), strict=True)) if out else None

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(docs, "doc_id long, piece int, start long, length long, ids_crc32 long", work)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = common.stored(cut(docs, path or tokenizer_path(), capacity, end), "pieces")
    plan = minimum_bin_slack(histogram(pieces), capacity)
    return placed(pieces, plan, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)
