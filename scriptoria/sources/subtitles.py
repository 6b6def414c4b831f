"""Subtitles to text, as DataFrame operations over numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SRT_TIME = r"^[0-9]{1,3}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}[ \t]*-->[ \t]*[0-9]{1,3}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}"
VTT_TIME = r"^(?:[0-9]+:)?[0-9]{2}:[0-9]{2}\.[0-9]{3}[ \t]+-->[ \t]+(?:[0-9]+:)?[0-9]{2}:[0-9]{2}\.[0-9]{3}"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def lines_of(df: DataFrame, key: str) -> DataFrame:
    """key, line_no, line (stripped), block: runs of lines that aren't blank, and place in the run from 0."""
    text = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\t ]+$|^[\t ]+", "")))
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("block", F.count_if(F.col("line") == "").over(order)).where("line <> ''")
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(key, "block").orderBy("line_no")) - 1)


def cue_line(line: Column) -> Column:
    """Without tags and overrides, entities as characters, a voice as "name: "."""
    voice = F.trim(F.regexp_extract(line, r"^\s*<v(?:\.[^\s>]*)?[ \t]+([^>]+)>", 1))
    clean = F.regexp_replace(F.regexp_replace(line, r"\{\\[^}]*\}", ""), r"<[^>\n]*>", "")
    for name, char in ENTITIES.items():
        clean = F.replace(clean, F.lit(name), F.lit(char))
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    return F.when((voice != "") & (clean != ""), F.concat(voice, F.lit(": "), clean)).otherwise(clean)


def _joined(lines: DataFrame, key: str) -> DataFrame:
    """One line per cue; a line equal to the one kept before it is a rolling repeat and goes."""
    order = Window.partitionBy(key).orderBy("line_no")
    spoken = lines.withColumn("cue", cue_line(F.col("line"))).where("cue <> ''")
    kept = spoken.withColumn("before", F.lag("cue").over(order)).where("before is null or cue <> before")
    sort = lambda a: F.transform(F.array_sort(a), lambda x: x["t"])
    cues = kept.groupBy(key, "block").agg(F.array_join(sort(F.collect_list(F.struct(F.col("line_no").alias("n"), F.col("cue").alias("t")))), " ").alias("t"))
    return cues.groupBy(key).agg(F.array_join(sort(F.collect_list(F.struct(F.col("block").alias("n"), "t"))), "\n").alias("text"), F.count("*").alias("cues"))


def srt_text(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, cues of rows (key, text) of SRT files."""
    lines = lines_of(df, key)
    own = Window.partitionBy(key, "block")
    timing = F.min(F.when((F.col("place") < 3) & F.col("line").rlike(SRT_TIME), F.col("place"))).over(own)
    lines = lines.withColumn("timing", timing)
    return _joined(lines.where("timing is not null and place > timing or timing is null and not line rlike '^[0-9]+$'"), key)


def vtt_text(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, cues of rows (key, text) of WebVTT files: no header, NOTE, STYLE and REGION blocks, settings or ids."""
    lines = lines_of(df, key)
    own = Window.partitionBy(key, "block")
    timing = F.min(F.when((F.col("place") < 2) & F.col("line").rlike(VTT_TIME), F.col("place"))).over(own)
    first = F.min_by("line", "place").over(own)
    opening = F.col("block") == F.min("block").over(Window.partitionBy(key))
    skipped = first.rlike(r"^(?:NOTE|STYLE|REGION)(?:[ \t]|$)") | (opening & first.startswith("WEBVTT"))
    lines = lines.withColumn("timing", timing).withColumn("skipped", skipped)
    return _joined(lines.where("not skipped and place > timing"), key)


def legacy_srt_text(text: Column) -> Column:
    """All lines that neither begin with a digit nor hold an arrow, as one line."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike("^[0-9]+") & ~F.contains(x, F.lit("-->")) & (F.trim(x) != ""))
    return F.array_join(F.transform(kept, F.trim), " ")
