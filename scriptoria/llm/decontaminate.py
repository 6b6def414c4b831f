"""Benchmark decontamination by winnowing.

Training and test texts keep the minimum of the K-gram hashes of every W consecutive ones; with
K + W - 1 = SPAN words every shared span of SPAN words keeps a common fingerprint in the same place. Shared
fingerprints are joined and each hit is extended to the longest run of equal words, checked by its bytes; runs
of at least SPAN words are contamination. An item of fewer words is one window of its own length and is found
by the hashes of all grams of that length, as winnowing guarantees nothing below SPAN.

The test set's fingerprints travel to the executors only while their number is within a checked bound; beyond
it they are joined by a shuffle in which hot fingerprints and hot items are dealt out by salt.

Edge cases: null text has no words; an item without words has no window; repeated items each count by their
item_id; an empty benchmark leaves all documents clean; rows that share a doc_id, or have none, are judged each by its
text, whichever way the benchmark travels."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common
from scriptoria.llm.words import U, Words, grams, join_hash, mix

K, W = 5, 6
SPAN = K + W - 1
#: Words of the benchmark up to which its index is sent to every task (8 bytes a word and its bytes).
SENT_WORDS = 2_000_000
SALTS = 32


def winnowed(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which grams are the least of some W consecutive ones (all of equal least ones); rows with fewer keep their least."""
    keep = np.zeros(len(h), bool)
    if not len(h):
        return keep
    n = np.diff(first)
    if len(h) >= W:
        least = h[: len(h) - W + 1].copy()
        for i in range(1, W):
            np.minimum(least, h[i : len(h) - W + 1 + i], out=least)
        place = np.arange(len(least))
        whole = place + W <= np.repeat(first[1:], n)[: len(least)]
        for i in range(W):
            keep[i : len(least) + i] |= (h[i : len(least) + i] == least) & whole
    for r in np.flatnonzero((n > 0) & (n < W)):
        own = slice(first[r], first[r + 1])
        keep[own] |= h[own] == h[own].min()
    return keep


class Index:
    """The test set: its words, fingerprints of items of SPAN words and more, and whole grams of shorter ones."""

    def __init__(self, ids: list, texts: list):
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), texts[i] or ""))
        self.ids = [ids[i] for i in order]
        words = Words(pa.array([texts[i] for i in order], pa.string()))
        self.hashes, self.first = words.hashes, words.first
        self.bytes = [words.text(words.first[i], words.first[i + 1]) for i in range(len(order))]
        n = np.diff(words.first)
        h, first = grams(words.hashes, words.first, K)
        keep = np.flatnonzero(winnowed(h, first))
        item = np.searchsorted(first, keep, "right") - 1
        long = n[item] >= SPAN
        self.print, place = _sorted(h[keep][long], np.c_[item, keep - first[item]][long])
        self.item, self.place = place[:, 0], place[:, 1]
        self.short = {}  # words of an item: (hashes, items)
        for m in sorted(set(n[(n > 0) & (n < SPAN)].tolist())):
            own = np.flatnonzero(n == m)
            self.short[m] = _sorted(join_hash(np.stack([words.hashes[words.first[i] : words.first[i + 1]] for i in own])), own[:, None])


def _sorted(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    return h[order], rows[order]


def _matches(h: np.ndarray, known: np.ndarray):
    """Pairs (place in h, place in known) of equal hashes."""
    lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
    some = np.flatnonzero(hi > lo)
    n = hi[some] - lo[some]
    return np.repeat(some, n), np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _extended(words: Words, a: int, b: int, p: int, item: np.ndarray, q: int) -> tuple[int, int]:
    """Longest run of equal words around document word p and item word q, as document words."""
    own = words.hashes
    back = min(p - a, q)
    differ = np.flatnonzero(own[p - back : p][::-1] != item[q - back : q][::-1])
    back = int(differ[0]) if len(differ) else back
    on = min(b - p, len(item) - q)
    differ = np.flatnonzero(own[p : p + on] != item[q : q + on])
    on = int(differ[0]) if len(differ) else on
    return p - back, p + on


def hits(words: Words, index: Index):
    """For each row: (merged spans of hit words, items)."""
    h, first = grams(words.hashes, words.first, K)
    keep = np.flatnonzero(winnowed(h, first))
    found: dict[int, tuple[list, set]] = {}
    done: dict[tuple, int] = {}  # (row, item, diagonal): end of the run that was extended
    at, known = _matches(h[keep], index.print)
    for g, k in zip(keep[at].tolist(), known.tolist(), strict=True):
        row = int(np.searchsorted(first, g, "right") - 1)
        p, item, q = words.first[row] + g - first[row], int(index.item[k]), int(index.place[k])
        if done.get((row, item, p - q), -1) > p:
            continue
        lo, hi = index.first[item], index.first[item + 1]
        s, e = _extended(words, words.first[row], words.first[row + 1], p, index.hashes[lo:hi], q)
        done[row, item, p - q] = e
        if e - s >= SPAN and words.text(s, e) == _piece(index, item, q - (p - s), e - s):
            spans, items = found.setdefault(row, ([], set()))
            spans.append((int(s), int(e)))
            items.add(index.ids[item])
    for m, (hashes, items_of) in index.short.items():
        n = len(words.hashes) - m + 1
        if n <= 0:
            continue
        window = np.zeros(n, U)
        for i in range(m):
            window = mix(window * U(0xD6E8FEB86659FD93) + words.hashes[i : i + n])
        at, known = _matches(window, hashes)
        for p, k in zip(at.tolist(), known.tolist(), strict=True):
            row, item = int(np.searchsorted(words.first, p, "right") - 1), int(items_of[k, 0])
            if p + m <= words.first[row + 1] and words.text(p, p + m) == index.bytes[item]:
                spans, items = found.setdefault(row, ([], set()))
                spans.append((p, p + m))
                items.add(index.ids[item])
    return found


def _piece(index: Index, item: int, q: int, n: int) -> bytes:
    return b" ".join(index.bytes[item].split(b" ")[q : q + n])


def covered(spans: list) -> list:
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<array<long>>"


def _report(batch, words: Words, found: dict) -> dict:
    n = np.diff(words.first)
    out = {k: [] for k in ("n_hit", "n_items", "items_sha256", "items", "spans")}
    for i in range(len(n)):
        spans, items = found.get(i, ([], set()))
        spans, items = covered(spans), sorted(map(str, items))
        out["n_hit"].append(sum(e - s for s, e in spans))
        out["n_items"].append(len(items))
        out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
        out["items"].append(items)
        out["spans"].append([[s - int(words.first[i]), e - int(words.first[i])] for s, e in spans])
    return out | {"doc_id": batch.column("doc_id"), "n_words": n, "contaminated": [x > 0 for x in out["n_hit"]]}


def _own(docs: DataFrame) -> DataFrame:
    """docs with what tells its texts apart: doc_id, which may be null, and a hash of the text."""
    return docs.withColumn("own", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")))


def _sent(spark, items: DataFrame, sent_words: int):
    """A broadcast index of the items (item_id, text), or None beyond sent_words."""
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) // 2 + size[1] > sent_words:  # a word has at least a byte and a separator
        return None
    rows = items.collect()
    return spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows]))


def contamination(docs: DataFrame, benchmark: DataFrame, sent_words: int = SENT_WORDS) -> DataFrame:
    """A row per document: words, hit words, item_ids and the hit spans (from, to) in words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    index = _sent(docs.sparkSession, items, sent_words)
    if index is None:
        return _summed(docs, _shared(docs, items))

    def work(batch):
        words = Words(batch.column("text"))
        return _report(batch, words, hits(words, index.value))

    return common.arrow_map(docs, SCHEMA, work)


def _prints(df: DataFrame, key: str, lengths: list | None) -> DataFrame:
    """(key, print) of winnowed grams, and of all grams of the lengths of short items; lengths None: df holds the items."""

    def work(batch):
        words = Words(batch.column("text"))
        h, first = grams(words.hashes, words.first, K)
        keep = np.flatnonzero(winnowed(h, first))
        row = np.searchsorted(first, keep, "right") - 1
        n = np.diff(words.first)
        rows, prints = [row], [h[keep]]
        if lengths is None:
            rows, prints = [row[n[row] >= SPAN]], [h[keep][n[row] >= SPAN]]
        for m in sorted(set(n[(n > 0) & (n < SPAN)].tolist())) if lengths is None else lengths:
            every, begins = grams(words.hashes, words.first, m)
            owner = np.repeat(np.arange(len(n)), np.diff(begins))
            own = n[owner] == m if lengths is None else np.ones(len(owner), bool)
            rows.append(owner[own])
            prints.append(mix(every[own] + U(m)))
        row, got = np.concatenate(rows), np.concatenate(prints)
        pair = np.unique(np.stack([row.astype(U), got]), axis=1) if len(row) else np.zeros((2, 0), U)
        return {"key": batch.column(key).take(pa.array(pair[0].astype(np.int64))), "print": pair[1].view(np.int64)}

    kind = dict(df.dtypes)[key]
    return common.arrow_map(df.select(key, "text"), f"key {kind}, print long", work).withColumnRenamed("key", key)


def _shared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """own, item_id, spans, n of documents and items that share a window, for a benchmark of any size: fingerprints are
    joined, then items come to the documents that share one."""
    n_words = common.arrow_map(items.select("text"), "n long", lambda batch: {"n": np.diff(Words(batch.column("text")).first)})
    lengths = [r[0] for r in n_words.where(f"n > 0 and n < {SPAN}").distinct().collect()]  # SPAN - 1 at most
    docs = _own(docs)
    items = items.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("item_hash")))
    salt, every = F.pmod(F.xxhash64("own"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    asked = _prints(docs, "own", lengths).withColumn("salt", salt)
    known = _prints(items, "item", None).distinct().withColumn("salt", every)
    pairs = common.stored(asked.join(known, ["print", "salt"]).select("own", "item").distinct(), "shared-prints")
    dealt = items.select("item", F.col("text").alias("item_text")).dropDuplicates(["item"]).withColumn("salt", every)
    judged = pairs.withColumn("salt", salt).join(dealt, ["item", "salt"]).drop("salt").join(docs.select("own", "text").dropDuplicates(["own"]), "own")

    def check(batch):
        words, n = Words(batch.column("text")), batch.num_rows
        item_ids, item_texts = batch.column("item_id").to_pylist(), batch.column("item_text").to_pylist()
        spans = []
        for i in range(n):
            one = Words(batch.column("text").slice(i, 1))
            spans.append([list(x) for x in covered(hits(one, Index([item_ids[i]], [item_texts[i]])).get(0, ([], set()))[0])])
        return {"own": batch.column("own"), "item_id": [str(x) for x in item_ids], "spans": spans, "n": np.diff(words.first)}

    own_kind = dict(docs.dtypes)["own"]
    return common.arrow_map(judged.select("own", F.col("item.item_id").alias("item_id"), "item_text", "text"), f"own {own_kind}, item_id string, spans array<array<long>>, n long", check).where("size(spans) > 0")


def _summed(docs: DataFrame, found: DataFrame) -> DataFrame:
    docs = _own(docs)
    grouped = found.groupBy("own").agg(F.collect_set("item_id").alias("items"), F.collect_set("spans").alias("all_spans"))

    def sum_up(batch):
        words = Words(batch.column("text"))
        found = {}
        for i, (names, spans) in enumerate(zip(batch.column("items").to_pylist(), batch.column("all_spans").to_pylist(), strict=True)):
            if names:
                a = int(words.first[i])
                found[i] = ([(s + a, e + a) for each in spans for s, e in each], set(names))
        return _report(batch, words, found)

    return common.arrow_map(docs.join(grouped, "own", "left").select("doc_id", "text", "items", "all_spans"), SCHEMA, sum_up)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str, sent_words: int = SENT_WORDS) -> DataFrame:
    """Drops documents in which a benchmark window occurs, each row by its own text."""
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("text", F.col("text").cast("string"))
    items = common.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("string").alias("text"))
    index = _sent(spark, items, sent_words)
    if index is None:
        hit = _shared(keyed.select("doc_id", "text"), items).select("own").distinct()
        return _own(keyed).join(hit, "own", "left_anti").select(*keyed.columns)

    def work(batch):
        hit = hits(Words(batch.column("text")), index.value)
        keep = pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64())
        return {name: batch.column(name).take(keep) for name in batch.schema.names}

    return common.arrow_map(keyed, ", ".join(f"{c} {t}" for c, t in keyed.dtypes), work)


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS n,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i)
  WHERE len(w) > 0),
dg AS (
  SELECT n, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM dw, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) AS t(i)
  WHERE len(w) >= size),
m AS (SELECT dg.n, dg.i, dg.size, win.item_id FROM dg JOIN win ON dg.gram = win.gram AND dg.size = win.size),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT n, i, size FROM m) x, unnest(range(i, i + size)) AS t(p) GROUP BY n),
it AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM m) x GROUP BY n)
SELECT dw.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.n = hit.n LEFT JOIN it ON dw.n = it.n
"""
