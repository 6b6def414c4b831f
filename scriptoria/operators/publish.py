"""Publication with a witness: each publication is a folder of its own, data first, then a manifest of digests; a pointer written last
tells readers which one holds, so that they see the old publication or the new one, whole, and nothing in between."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages of a publication, each complete before the next begins; the last makes it visible.
STAGES = ("data", "manifest", "current")


def digest(df: DataFrame) -> Column:
    """Of a row: its canonical JSON, columns in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def published(df: DataFrame, path: str, key: str) -> str:
    """Writes data, then the manifest, then the pointer; the name of the publication. Older ones stay, for readers at work."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/{name}/data")
    data = spark.read.parquet(f"{path}/{name}/data")
    data.select(key, digest(data).alias("digest")).write.parquet(f"{path}/{name}/manifest")
    sequence = max((n for n, _ in _pointers(spark, path)), default=0) + 1
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.parquet(f"{path}/current/{sequence:012d}")
    return name


def _pointers(spark, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the pointers that were written to their end."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(f"{path}/current")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    folders = [x.getPath() for x in system.listStatus(root)]
    return [(int(p.getName()), p.toString()) for p in folders if p.getName().isdigit() and system.exists(jvm.Path(p, "_SUCCESS"))]


def read_back(spark, path: str, key: str) -> DataFrame:
    """Rows of the current publication with `good`: whether the manifest has their digest."""
    _, pointer = max(_pointers(spark, path))
    name = spark.read.parquet(pointer).first()["name"]
    data = spark.read.parquet(f"{path}/{name}/data")
    manifest = spark.read.parquet(f"{path}/{name}/manifest").withColumnRenamed("digest", "expected")
    return data.withColumn("digest", digest(data)).join(manifest, key, "full").withColumn("good", F.coalesce(F.col("digest") == F.col("expected"), F.lit(False))).drop("digest", "expected")


def exported(summaries: DataFrame, form: str, key: str = "doc_id") -> DataFrame:
    """key, name, media_type, content of published summaries (key, title, text, sentences array<struct<ord,text,segment_id>>): "txt" the text as
    it is, "md" under its title with footnotes, "json" all of it as one record. One without a text has no export."""
    have = summaries.where(F.col("text").isNotNull() & (F.col("text") != ""))
    safe = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"[^\p{L}\p{N} ._-]+", "_")), F.lit("")), F.lit("summary"))
    name = F.concat(safe, F.lit(f"-summary.{form}"))
    if form == "txt":
        return have.select(key, name.alias("name"), F.lit("text/plain; charset=utf-8").alias("media_type"), F.col("text").alias("content"))
    if form == "json":
        record = F.to_json(F.struct(F.col("title"), F.col("text"), F.col("sentences")), {"ignoreNullFields": "false"})
        return have.select(key, name.alias("name"), F.lit("application/json").alias("media_type"), record.alias("content"))
    if form != "md":
        raise ValueError(f"no export as {form}")
    notes = footnoted(have.select(key, F.explode("sentences").alias("s")).select(key, "s.*"), key).withColumnRenamed("text", "body")
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("Summary")), F.lit("\n\n"), F.coalesce("body", F.concat("text", F.lit("\n"))))
    return have.join(notes, key, "left").select(key, name.alias("name"), F.lit("text/markdown; charset=utf-8").alias("media_type"), body.alias("content"))


def footnoted(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: sentences (key, ord, text, segment_id) as Markdown; footnotes are numbered where their segment is first cited."""
    firsts = sentences.groupBy(key, "segment_id").agg(F.min("ord").alias("first"))
    notes = firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "segment_id"))), lambda n: n["segment_id"]).alias("notes"))
    own = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("text"), "segment_id"))).alias("s"))
    body = F.transform("s", lambda s: F.concat(s["text"], F.lit("[^"), F.array_position("notes", s["segment_id"]).cast("string"), F.lit("]")))
    foot = F.transform("notes", lambda n, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), n))
    return own.join(notes, key).select(key, F.concat(F.array_join(body, " "), F.lit("\n\n"), F.array_join(foot, "\n"), F.lit("\n")).alias("text"))
