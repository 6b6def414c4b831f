"""Near duplicates by Order MinHash over five-word shingles, checked by banded alignment.

Each sketch keeps the ELEMS smallest of a text's different shingles under one hash, in the order of their first
occurrences, so that it is sensitive to edits and moves, and to repeated lines as little as the rule is. ROWS sketches make a band; documents that share a band are candidates.
Similarity: with L the longest common subsequence of two texts' different shingles, in the order of their first
occurrences, by a banded bit-parallel alignment, and n, m their numbers, L / (n + m - L) >= 0.8; for texts in one order
this is the shingles' Jaccard similarity, and repeated lines weigh once.

No group is expanded into pairs: in each bucket all members are compared with one leader. In buckets whose members still
lie in several components (a common passage brings texts together that aren't alike) rounds go on with the next members as
leaders until no two members of different components are left uncompared. Documents of equal words are one node.

Bounds spare comparisons that can't succeed, and lose no link. If `own` of a text's n shingles are, of the mixed buckets'
texts, only in its own component, L with a text of another component is n - own at most, while 0.8 asks for 9 L >= 4 (n + m)
>= 7.2 n; texts that fail this alone leave at once. Each other text marks its shingles in BITS bits; a bit that x has marked
and y hasn't stands for a shingle at least that y hasn't, and so bounds L for a pair within the join. Thus many copies of one
text, each too far from all others, aren't compared with each other.

Edge cases: null text is empty; documents without words are equal only if their bytes are; documents of fewer
than five words have one shingle of all words; rows that share a doc_id are judged each by its text; a null doc_id is
a row like any other, and a class has a null class_id only if no row of it has a doc_id."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm import common
from scriptoria.llm.components import components
from scriptoria.llm.words import U, Words, grams, join_hash, mix

K, ELEMS, SIMILAR = 5, 2, 0.8
#: Rows of a band, and bands. At shingle similarity s a band agrees with about s ** (ELEMS * ROWS): a miss at 0.8 of less than 1e-9.
ROWS, BANDS = 2, 40
#: Bits in which a text marks its shingles, for the bound of a pair.
BITS = 2048
#: How the number of leaders a bucket grows from round to round where texts stay apart; cuts rounds only.
GROW = 16


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingles in order; a row with fewer words, but some, has one of all."""
    h, first = grams(words.hashes, words.first, K)
    n = np.diff(words.first)
    if ((n == 0) | (n >= K)).all():
        return h, first
    parts = [h[first[i] : first[i + 1]] if n[i] >= K or not n[i] else mix(join_hash(words.hashes[None, words.first[i] : words.first[i + 1]])) for i in range(len(n))]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return np.concatenate(parts), out


def different(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different shingles in the order of their first occurrences, and the rows' offsets into them."""
    if not len(h):
        return h, first
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, rows))  # stable: a shingle's first occurrence comes first
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])]
    keep = np.sort(order[new])
    return h[keep], np.searchsorted(keep, first)


def sketches(h: np.ndarray, first: np.ndarray, rows: int, bands: int, seed: int) -> np.ndarray:
    """(documents, bands) of band hashes of different shingles in order; documents without shingles must not be given."""
    x, starts, n = mix(h), first[:-1], np.diff(first)
    bits = U(max(1, int(n.max()).bit_length()))
    place = (np.arange(len(h)) - np.repeat(starts, n)).astype(U)
    rng, full = np.random.default_rng(seed), ~U(0)
    scale = rng.integers(0, 1 << 63, rows * bands, dtype=U) * U(2) + U(1)
    shift = rng.integers(0, 1 << 63, rows * bands, dtype=U)
    out, mask = np.empty((len(n), bands), U), (U(1) << bits) - U(1)
    for b in range(bands):
        parts = np.empty((len(n), rows * ELEMS), U)
        for r in range(rows):
            v = x * scale[b * rows + r]
            v += shift[b * rows + r]
            v >>= bits
            v <<= bits
            v |= place
            at = np.empty((len(n), ELEMS), np.int64)
            for e in range(ELEMS):
                at[:, e] = np.where(n > e, (np.minimum.reduceat(v, starts) & mask).astype(np.int64), 0)
                v[starts + at[:, e]] = full
            at.sort(axis=1)  # text order
            parts[:, r * ELEMS : (r + 1) * ELEMS] = x[starts[:, None] + at]
        out[:, b] = mix(join_hash(parts) + U((b + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
    return out


def sketch_table(df: DataFrame, rows: int, bands: int, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, node and twin (16 bytes of the words' digest), different shingles, bands of a table of doc_id and text."""

    def work(batch):
        words = Words(batch.column("text"))
        raw, off = common.bytes_of(batch.column("text"))
        h, first = different(*shingles(words))
        n = np.diff(first)
        some = np.flatnonzero(n)
        got = np.zeros((len(n), 0), U)
        if len(some):
            got = np.zeros((len(n), bands), U)
            got[some] = sketches(h, np.r_[first[some], first[-1]], rows, bands, seed)
        node = []
        for i in range(len(n)):
            own = words.hashes[words.first[i] : words.first[i + 1]]
            node.append(hashlib.blake2b(own.tobytes() if len(own) else b"\0" + raw[off[i] : off[i + 1]].tobytes(), digest_size=16).digest())
        node = np.frombuffer(b"".join(node), "<i8").reshape(-1, 2)
        flat = got[some].astype(np.int64, casting="unsafe") if len(some) else np.zeros((0, bands), np.int64)
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum((n > 0) * bands, out=ends[1:])
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "node": node[:, 0], "twin": node[:, 1], "shingles": n, "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))}

    return common.arrow_map(df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "doc_id long, text_hash long, node long, twin long, shingles long, bands array<long>", work)


def common_length(a: list, b: list, half: int) -> int:
    """Longest common subsequence among alignments at most half cells off the diagonals, bit-parallel over a."""
    places: dict = {}
    for i, s in enumerate(a):
        places.setdefault(s, []).append(i)
    n, lo, hi, gap = len(a), 0, 0, len(a) - len(b)
    down, up = half + max(0, -gap), half + max(0, gap)
    left = v = 0
    for j, s in enumerate(b):
        new_lo, new_hi = min(n, max(0, j - down)), min(n, j + up + 1)
        if new_hi > hi:
            v |= ((1 << (new_hi - hi)) - 1) << (hi - lo)
            hi = new_hi
        if new_lo > lo:
            out = v & ((1 << (new_lo - lo)) - 1)
            left += (new_lo - lo) - out.bit_count()
            v >>= new_lo - lo
            lo = new_lo
        m = 0
        for p in places.get(s, ()):
            if lo <= p < hi:
                m |= 1 << (p - lo)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ((1 << (hi - lo)) - 1)
    return left + (hi - lo) - v.bit_count()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both, by number: no alignment has more."""
    (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether the longest common subsequence is of `need` elements at least; the band grows until that is certain."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < need or _shared(a, b) < need:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[::-1][:rest] != b[::-1][:rest])
    tail = int(differ[0]) if len(differ) else rest
    need -= head + tail
    a, b = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    edits = len(a) + len(b) - 2 * need  # more insertions and deletions are too many
    most = max(0, (edits - abs(len(a) - len(b)) + 1) // 2)
    half = min(32, most)
    while True:
        got = common_length(a, b, half)
        if got >= need:
            return True
        if half >= most or len(a) + len(b) - 2 * got <= abs(len(a) - len(b)) + 2 * half:
            return False
        half = min(most, half * 4)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts are alike by their different shingles in order: L / (n + m - L) >= 0.8, that is 9 L >= 4 (n + m)."""
    return aligned(a, b, -(-4 * (len(a) + len(b)) // 9))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of two nodes whose texts are alike."""

    def work(batch):
        (x, fx), (y, fy) = (different(*shingles(Words(batch.column(c)))) for c in ("text_a", "text_b"))
        good = [similar(x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]) for i in range(batch.num_rows)]
        keep = np.flatnonzero(good)
        return {"a": batch.column("a").take(pa.array(keep)), "b": batch.column("b").take(pa.array(keep))}

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return common.arrow_map(both.select("a", "b", "text_a", "text_b"), "a long, b long", work)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, class_id, copies): class_id is the smallest doc_id of the class, copies the rows in it."""
    return classified(docs).select("doc_id", "class_id", "copies")


def classified(docs: DataFrame) -> DataFrame:
    """near_duplicates() with text_hash, which tells rows that share a doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = common.stored(sketch_table(docs, ROWS, BANDS), "omh")
    clash = sketched.groupBy("node").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi")).where("lo <> hi").select("node", F.lit(True).alias("clash"))
    if not clash.isEmpty():  # different words of one 64-bit node
        own = F.when(F.col("clash"), F.xxhash64("node", "twin")).otherwise(F.col("node"))
        sketched = common.stored(sketched.join(clash, "node", "left").withColumn("node", own).drop("clash"), "omh")
    nodes = sketched.groupBy("node").agg(F.first("bands").alias("bands"))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    held = common.stored(members.join(leaders, "bucket"), "buckets", BANDS * sketched.count())
    texts = _texts(docs, sketched, held)
    # most are like the smallest leader of all their buckets
    nearest = held.where("node <> leader").groupBy("node").agg(F.min("leader").alias("leader"))
    merged = components(common.stored(_compared(nearest, texts), "links"))
    mixed = common.stored(_mixed(held.select("bucket", "node"), merged), "mixed", held.count())
    if not mixed.isEmpty():
        merged = _resolved(mixed.join(_bounds(mixed, sketched.select("node", "shingles"), texts), "node"), merged, texts, nearest)
    classes = sketched.select("doc_id", "text_hash", "node").join(merged, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))
    # stored, so that a large class's rows can be split over several tasks of the join
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    smallest = common.stored(classes.groupBy("component").agg(least.alias("first"), F.count("*").alias("copies")), "classes", sketched.count())
    return classes.join(smallest, "component").select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("class_hash"), "copies")


def shingle_table(texts: DataFrame) -> DataFrame:
    """node, component, shingle: the different shingles of each text."""

    def work(batch):
        h, first = different(*shingles(Words(batch.column("text"))))
        owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
        return {"node": batch.column("node").take(owner), "component": batch.column("component").take(owner), "shingle": h.view(np.int64)}

    return common.arrow_map(texts.select("node", "component", "text"), "node long, component long, shingle long", work)


def marks_table(texts: DataFrame) -> DataFrame:
    """node, marks, bits: BITS bits as longs, of which a text's different shingles set some, and how many are set."""

    def work(batch):
        h, first = different(*shingles(Words(batch.column("text"))))
        marked = np.zeros((batch.num_rows, BITS), bool)
        marked[np.repeat(np.arange(batch.num_rows), np.diff(first)), (h % U(BITS)).astype(np.int64)] = True
        longs = np.packbits(marked, axis=1, bitorder="little").view("<i8")
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (BITS // 64)
        return {"node": batch.column("node"), "marks": pa.ListArray.from_arrays(pa.array(ends), pa.array(longs.ravel())), "bits": marked.sum(axis=1)}

    return common.arrow_map(texts.select("node", "text"), "node long, marks array<long>, bits long", work)


def _bounds(mixed: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n, own, marks, bits) of the nodes of mixed (bucket, node, component) that may be like one of another component:
    own counts a node's shingles that only its own component has, and L <= n - own must reach 0.8 n."""
    nodes, rows = mixed.select("node", "component").distinct(), mixed.count()
    has = common.stored(shingle_table(texts.join(nodes, "node")), "shingles")
    alone = has.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo = hi").select("shingle")
    own = has.join(alone, "shingle").groupBy("node").agg(F.count("*").alias("own"))
    size = sizes.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("n"))
    bounds = size.join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))
    bounds = common.stored(bounds.where("5 * own <= n"), "bounds", rows)
    return common.stored(bounds.join(marks_table(texts.join(bounds, "node", "left_semi")), "node"), "bounds", rows)


def _mixed(held: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows (bucket, node and more) of the buckets whose nodes are in several components, with their component."""
    named = held.drop("component").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return named.join(spans, "bucket")


LEAD = ("node", "rank", "n", "own", "marks", "bits", "component")


def _pairs(mixed: DataFrame, leads: DataFrame, which: str) -> DataFrame:
    """(node, leader) of mixed (bucket and LEAD) and the leads (bucket, lead) of other components that can be alike by their bounds."""
    both = " + ".join(f"bit_count(marks[{i}] & lead.marks[{i}])" for i in range(BITS // 64))
    far = "9 * least(n - greatest(own, {0}), lead.n - greatest(lead.own, {1})) >= 4 * (n + lead.n)".format
    shared = f"({both})"
    near = f"component <> lead.component and {far(0, 0)} and {far(f'bits - {shared}', f'lead.bits - {shared}')}"
    return mixed.join(leads, "bucket").where(f"{which} and {near}").select("node", F.col("lead.node").alias("leader")).distinct()


def _linked(pairs: DataFrame, merged: DataFrame, texts: DataFrame) -> DataFrame:
    """The components after those of the pairs that are alike are linked: the links between components make a graph of its
    own, whose components are theirs."""
    found = common.stored(_compared(pairs, texts), "links")
    if found.isEmpty():
        return merged
    for c in ("a", "b"):
        found = found.join(merged.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    joined = components(common.stored(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "contracted", found.count()))
    # a component that had no row was a node alone
    rows = merged.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    single = joined.join(merged, "node", "left_anti")
    return common.stored(rows.unionByName(single.select("node", "component")), "merged", merged.count() + joined.count())


def _resolved(mixed: DataFrame, merged: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """Components once any two members of a bucket are compared, in one component or too far apart by their bounds. Each
    round compares the next members, at first one and then GROW times as many as before, with all that follow them."""
    order, rows = F.row_number().over(Window.partitionBy("bucket").orderBy("node")), mixed.count()
    left, done, many = common.stored(_mixed(mixed, merged).withColumn("rank", order), "ranked", rows), 0, 1
    while not left.isEmpty():
        leads = left.where(F.col("rank") <= done + many).select("bucket", F.struct(*LEAD).alias("lead"))
        pairs = common.stored(_pairs(left, leads, "rank > lead.rank").join(tried, ["node", "leader"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        merged = _linked(pairs, merged, texts)
        done, many = done + many, many * GROW
        left = common.stored(_mixed(left.where(F.col("rank") > done), merged), "mixed", rows)
    return merged


def _texts(docs: DataFrame, sketched: DataFrame, held: DataFrame) -> DataFrame:
    """node, text of the nodes in buckets, from one document of each."""
    first = sketched.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"), F.count("*").alias("rows"))
    wanted = held.select("node").distinct().join(first, "node").select("node", F.col("own.doc_id").alias("of_doc"), F.col("own.text_hash").alias("of_hash"), "rows")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_hash"))).select("node", "text")
    if not wanted.where("rows > 1").isEmpty():  # rows may be alike in doc_id and text
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    return common.stored(texts, "texts")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return verified(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")), texts)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id (a null one only where there is no other), of each class; rows alike
    in doc_id and text are one."""
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    kept = classified(docs).where(first).groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows"))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    own = docs.join(kept, same)
    once = own.where("__rows = 1").unionByName(own.where("__rows > 1").dropDuplicates(["__doc", "__hash"]))
    return once.select(*docs.columns)
