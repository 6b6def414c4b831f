"""Line dedup by content-defined chunks.

A rolling hash over the last ROLL line hashes chooses chunk boundaries, so that they depend on near lines only and
come back after an insertion. Chunks of at least MIN_LINES lines and MIN_WORDS words that occur more than once in
the whole table are compared byte by byte; where all bytes agree every occurrence but the first (by doc_id, then
place) is removed.

So are runs of whole lines of RUN_WORDS words or more, wherever they begin. From each line the shortest such run
onward and the one backward are taken; a repeated run is the union of those within it, so no run is missed, and their
number is at most two a line. An occurrence that overlaps the first one in its own text stays.

Edge cases: null text stays null; texts of one line are removed only as repeated runs; rows alike in doc_id and
text are one document; a document may lose all its lines and is then the empty text; an empty table gives none."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common

ROLL, EVERY, MIN_LINES, MIN_WORDS, RUN_WORDS = 2, 2, 2, 8, 50
#: A chunk's number is its first line << LINE_BITS | the line after its last.
LINE_BITS = 32


def chunk_ends(lines: list[str]) -> list[int]:
    """Line numbers after which a chunk ends; the last is len(lines)."""
    ends, begin, before = [], 0, 0
    n = len(lines)
    for i, line in enumerate(lines):
        own = zlib.crc32(line.encode("utf-8", "surrogatepass"))
        roll = (before * 0x9E3779B1 + own * 0x85EBCA6B) & 0xFFFFFFFF
        before = own
        if i + 1 - begin >= MIN_LINES and i + 1 < n - 1 and (roll ^ roll >> 15) * 0x2C1B3C6D >> 12 & 0xFFFF < 0x10000 // EVERY:
            ends.append(i + 1)
            begin = i + 1
    ends.append(n)
    return ends


def runs(words: list[int]) -> set[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs of RUN_WORDS words or more from each line with words, on and back."""
    out, n, total, end = set(), len(words), 0, 0
    for i in range(n):  # onward
        while end < n and total < RUN_WORDS:
            total += words[end]
            end += 1
        if total < RUN_WORDS:
            break
        if words[i]:
            out.add((i, end))
        total -= words[i]
    total, begin = 0, n
    for j in range(n, 0, -1):  # backward
        while begin and total < RUN_WORDS:
            begin -= 1
            total += words[begin]
        if total < RUN_WORDS:
            break
        if words[j - 1]:
            out.add((begin, j))
        total -= words[j - 1]
    return out


def places(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of all that may be removed, in order."""
    words, begin = [len(x.split()) for x in lines], 0
    out = runs(words)
    for end in chunk_ends(lines):
        if end - begin >= MIN_LINES and sum(words[begin:end]) >= MIN_WORDS:
            out.add((begin, end))
        begin = end
    return sorted(out)


def chunks(text: str):
    """(number, chunk) of each chunk or run that may be removed."""
    lines = text.split("\n")
    for begin, end in places(lines):
        yield begin << LINE_BITS | end, "\n".join(lines[begin:end])


def without(text: str, gone: set[int]) -> tuple[str, int]:
    """The text without these chunks, and the number of lines that went."""
    lines = text.split("\n")
    out = {i for k in gone for i in range(k >> LINE_BITS, k & ((1 << LINE_BITS) - 1))}
    return "\n".join(x for i, x in enumerate(lines) if i not in out), len(out)


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, chunk, digest of all chunks and runs that may be removed."""

    def work(batch):
        out = []
        for doc, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            own = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
            for begin, end in places(lines):
                out.append((doc, text_hash, begin << LINE_BITS | end, hashlib.blake2b(b"".join(own[begin:end]), digest_size=16).digest()))
        return dict(zip(("doc_id", "text_hash", "chunk", "digest"), zip(*out, strict=True), strict=True)) if out else None

    return common.arrow_map(docs, "doc_id long, text_hash long, chunk long, digest binary", work)


def byte_table(docs: DataFrame) -> DataFrame:
    """digest, bytes of the chunks in `__held` (numbers and digests) of docs; once for the equal ones of a slice."""

    def work(batch):
        out = set()
        for held, text in zip(batch.column("__held").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            for c in held:
                k = c["chunk"]
                out.add((c["digest"], "\n".join(lines[k >> LINE_BITS : k & ((1 << LINE_BITS) - 1)]).encode("utf-8", "surrogatepass")))
        return dict(zip(("digest", "bytes"), zip(*out, strict=True), strict=True)) if out else None

    return common.arrow_map(docs, "digest binary, bytes binary", work)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text (others stay) with repeated chunks removed; n_lines and n_removed are added (or replaced)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    keyed = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64("text"))
    slim = keyed.select(F.col("__doc").alias("doc_id"), F.col("__hash").alias("text_hash"), "text")
    found = common.stored(chunk_table(slim), "chunks")
    place = F.struct("doc_id", "text_hash", "chunk")
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    candidates = common.stored(found.join(groups, "digest"), "candidates")
    # the bytes of all occurrences: the least and the greatest are equal only if all are
    held = candidates.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("chunk", "digest")).alias("__held"))
    # all columns, as below, so that the texts are shuffled once for both joins
    owners = keyed.join(_of_doc(held), F.col("__doc").eqNullSafe(F.col("__own_doc")) & (F.col("__hash") == F.col("__own_hash"))).select(*names, "__held")
    differing = byte_table(owners).groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least <> most").select("digest")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    apart = F.shiftright("chunk", LINE_BITS) >= F.col("first.chunk").bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    gone = candidates.join(differing, "digest", "left_anti").where((place != F.col("first")) & (~own | apart)).groupBy("doc_id", "text_hash").agg(F.collect_set("chunk").alias("chunk"))
    gone = gone.withColumnRenamed("chunk", "__gone")
    both = keyed.join(_of_doc(gone), F.col("__doc").eqNullSafe(F.col("__own_doc")) & (F.col("__hash") == F.col("__own_hash")), "left").select(*names, "__gone")

    def work(batch):
        texts, n_lines, n_removed = [], [], []
        for text, out in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
            n_lines.append(0 if text is None else text.count("\n") + 1)
            text, n = without(text, set(out)) if out else (text, 0)
            texts.append(text)
            n_removed.append(n)
        return {c: batch.column(c) for c in names} | {"text": texts, "n_lines": n_lines, "n_removed": n_removed}

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes) + ", n_lines long, n_removed long"
    return common.arrow_map(both, schema, work)


def _of_doc(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "__own_doc", "text_hash": "__own_hash"})


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without repeated chunks; n_chars is counted anew where lines went."""
    done = deduplicated(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select("doc_id", "text", "lang", "source", "n_chars")
