"""Token ids as binary matrices, packed by best-fit decreasing.

Each task tokenizes its texts once and packs them shard by shard, a shard being SHARD_TOKENS ids: pieces go, longest
first, to the sequence with the least room that still holds them; a segment tree over the capacities finds it.
Sequences of equal room are interchangeable, so the search works on runs of them and on the histogram of lengths.
Nothing is shuffled; small partitions are first put together to about a shard for each task, as a task's last shard ends
with it, and a full shard wastes about one sequence in a thousand. Each row of the result is one sequence: its ids
(little-endian unsigned 16-bit, filled up with PAD), cumulative segment lengths, and where positions restart from 0.

Edge cases: null text is empty and gives the end token alone; overlong documents are cut losslessly; repeated rows
are packed each; an empty table gives no rows; ids above 65,535 are an error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common
from scriptoria.llm.placing import Placement
from scriptoria.llm.tokens import encoder, tokenizer_path

CAPACITY, END, PAD = 4096, 1, 0
SHARD_TOKENS = 4_000_000
#: Bytes of text an id stands for, roughly; only decides how many tasks there are at most.
ID_BYTES = 2


class Rooms:
    """A segment tree over room left: which rooms some sequence has, and the runs of sequences with each."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, n: int) -> None:
        runs = self.runs.setdefault(room, [])
        runs.append((first, n))
        if len(runs) == 1:
            self._count(room, 1)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """A run of at most `most` sequences with this room."""
        runs = self.runs[room]
        first, n = runs.pop()
        if n > most:
            runs.append((first + most, n - most))
            n = most
        if not runs:
            self._count(room, -1)
        return first, n

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def least_from(self, room: int) -> int | None:
        """The least room that is no less."""
        at = room + self.size
        if self.tree[at]:
            return room
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    plan, rooms, sequences = [], Rooms(capacity), 0
    for n in sorted(counts, reverse=True):
        left, rank = counts[n], 0
        while left:
            room = rooms.least_from(n)
            if room is None:
                room, per = capacity, capacity // n
                first, got = sequences, max(1, left // per)
                sequences += got
            else:
                per = room // n  # a sequence that got one has the least room again, so it is filled
                first, got = rooms.take(room, max(1, left // per))
            each = min(per, left)
            plan.append(Placement(n, rank, got * each, each, first, capacity - room))
            rooms.add(room - each * n, first, got)
            left -= got * each
            rank += got * each
    return plan


def shard(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """pieces (length, ...) by sequence, in place order."""
    pieces = sorted(pieces, key=lambda p: -p[0])  # those of one length stay in order
    counts: dict[int, int] = {}
    for p in pieces:
        counts[p[0]] = counts.get(p[0], 0) + 1
    begin, at = {}, 0
    for n, c in counts.items():
        begin[n] = at
        at += c
    rows: dict[int, list] = {}
    for place in best_fit_decreasing(counts, capacity):
        for i in range(place.count):
            rows.setdefault(place.sequence + i // place.each, []).append(pieces[begin[place.length] + place.rank + i])
    return [rows[k] for k in sorted(rows)]


def packed_ids(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per sequence: sequence_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids, pieces."""
    path = path or tokenizer_path()
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    docs = docs.coalesce(max(1, size // (ID_BYTES * shard_tokens)))

    def batch_of(pieces: list) -> pa.RecordBatch:
        out = []
        for row in shard(pieces, capacity):
            ids = b"".join(p[3] for p in row)
            ends = np.cumsum([p[0] for p in row])
            fill = np.full(capacity - int(ends[-1]), PAD, "<u2").tobytes()
            out.append((int(ends[-1]), ids + fill, [0, *ends.tolist()], [0, *ends[:-1].tolist()], [p[1] for p in row], [p[2] for p in row]))
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        names = ["n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches):
        last, held, tokens = np.array([end], "<u2").tobytes(), [], 0
        for whole in batches:
            for batch in common.slices(whole):
                for doc, got in zip(batch.column("doc_id").to_pylist(), encoder(path, 2).encode(batch.column("text").cast("binary").to_pylist()), strict=True):
                    got += last
                    n = len(got) // 2
                    for k, a in enumerate(range(0, n, capacity)):
                        held.append((min(capacity, n - a), doc, k, got[2 * a : 2 * (a + capacity)]))
                        tokens += held[-1][0]
                        if tokens >= shard_tokens:
                            yield batch_of(held)
                            held, tokens = [], 0
        if held:
            yield batch_of(held)

    schema = "n_tokens long, ids binary, cu_seqlens array<long>, position_resets array<long>, doc_ids array<long>, pieces array<int>"
    return docs.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("sequence_id"), "*")


def write(rows: DataFrame, path: str) -> None:
    """The matrices as Parquet files, one row a sequence, committed as a whole."""
    rows.write.parquet(path)


def matrix(row, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """ids and position ids of a row that was read back."""
    ids = np.frombuffer(row["ids"], "<u2")
    positions = np.arange(capacity)
    for a in row["cu_seqlens"]:
        positions[a:] = np.arange(capacity - a)
    return ids, positions


def query(spark, sf_dir: str) -> DataFrame:
    return packed_ids(common.table(spark, sf_dir, "documents"))
