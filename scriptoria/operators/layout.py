"""Headings of laid-out pages, from rows (doc_id, page, line_no, text, size, bold, y): windows within a document.

A heading is set larger than body text, or bold on a line of its own; it is set off from what is above; running heads,
repeated lines and runs of same-style lines without body text between (bylines, lists of contents) are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T

# What sets a heading apart.
LARGER, NEAR_BODY, SET_OFF, MERGED, SAME_PLACE, RUNNING_PAGES, RUN, SIZE_STEP, BODY_GAP, PAGE_GAPS = 1.1, 1.25, 1.3, 1.8, 6, 3, 3, 0.05, 3.0, 3
MOST_CHARS, MOST_WORDS, MOST_WORDS_NEAR, SENTENCE_WORDS = 120, 20, 12, 5


def repeat_key(text: Column, page: Column) -> Column:
    """A line for comparison across pages: a number at its begin or end becomes its distance from the page."""
    low = T.one_line(F.lower(text))
    for side in (r"^([0-9]{1,9})(?= |$)", r"(?<= )([0-9]{1,9})$"):
        number = F.regexp_extract(low, side, 1)
        low = F.when(number != "", F.regexp_replace(low, F.lit(side), F.concat(F.lit("<off:"), (number.cast("int") - page).cast("string"), F.lit(">")))).otherwise(low)
    return low


def looks_like_heading(title: Column, most_words: Column, near_body: Column) -> Column:
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    first = F.regexp_extract(title, r"(\p{L})", 1)
    words = T.word_count(title)
    return (
        (F.length(title) <= MOST_CHARS) & ~(near_body & title.rlike("[=<>≤≥≠]")) & (words <= most_words) & (letters >= 3) & (letters >= 0.5 * F.length(F.replace(title, F.lit(" "), F.lit(""))))
        & ~first.rlike(r"\p{Ll}") & ~title.rlike("[,;:]$") & ~(title.rlike("[.!?]$") & (words > SENTENCE_WORDS))
    )


def upper_median(values: Column) -> Column:
    """The element after half of all; null for none."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1))


def headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, line_no, title, level."""
    sizes = lines.groupBy(key, "size").agg(F.sum(F.length("text")).alias("chars"))
    body = sizes.groupBy(key).agg(F.max_by("size", "chars").alias("body"))
    rows = lines.join(body, key).withColumn("key", repeat_key(F.col("text"), F.col("page")))
    places = rows.select(key, "key", "page", "y").distinct()
    near = places.withColumn("n", F.count("*").over(Window.partitionBy(key, "key").orderBy("y").rangeBetween(-SAME_PLACE, SAME_PLACE)))
    rows = rows.join(near.select(key, "key", "page", "y", (F.col("n") >= RUNNING_PAGES).alias("running")), [key, "key", "page", "y"])
    order = Window.partitionBy(key, "page").orderBy("line_no")
    gap = F.lag("y").over(order) - F.col("y")
    rows = rows.withColumn("above", gap).withColumn("times", F.count_if(~F.col("running")).over(Window.partitionBy(key, "page", "text")))
    is_body = F.abs(F.col("size") / F.col("body") - 1) < LARGER - 1
    rows = rows.withColumn("body_gap", F.when(is_body & (F.lag("size").over(order) == F.col("size")) & (F.col("above") > 0) & (F.col("above") <= BODY_GAP * F.col("body")), F.col("above")))
    page_gaps = rows.groupBy(key, "page").agg(F.collect_list("body_gap").alias("gaps"))
    whole = rows.where("body_gap is not null").groupBy(key, F.col("body_gap").alias("g")).agg(F.count("*").alias("c"))
    whole = whole.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy("g"))).withColumn("all", F.sum("c").over(Window.partitionBy(key)))
    typical_all = whole.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).groupBy(key).agg(F.min("g").alias("document_gap"))
    typical = page_gaps.join(typical_all, key, "left").select(key, "page", F.when(F.size("gaps") >= PAGE_GAPS, upper_median(F.col("gaps"))).otherwise(F.coalesce("document_gap", F.lit(0.0))).alias("typical"))
    large = F.col("size") >= LARGER * F.col("body")
    candidate = (large | (F.col("bold") & (F.col("size") >= F.col("body")))) & F.col("text").rlike(r"\p{L}") & ~F.col("running") & (F.col("times") < 2)
    rows = rows.join(typical, [key, "page"]).withColumn("candidate", candidate).withColumn("large", large).withColumn("plain", is_body & ~F.col("bold"))
    joined = F.col("candidate") & F.lag("candidate").over(order) & (F.lag("size").over(order) == F.col("size")) & (F.lag("bold").over(order) == F.col("bold")) & (F.col("above") > 0) & (F.col("above") <= MERGED * F.col("size"))
    rows = rows.withColumn("begins", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("begins").over(order)).withColumn("body_before", F.sum(F.col("plain").cast("int")).over(order))
    first = lambda c: F.min_by(c, "line_no")
    runs = rows.where("candidate").groupBy(key, "page", "run").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("title"), first("size").alias("size"), first("bold").alias("bold"), first("large").alias("large"),
        first("above").alias("above"), first("typical").alias("typical"), first("body").alias("body"), first("body_before").alias("body_before"),
    )
    near_body = F.col("large") & ~F.col("bold") & (F.col("size") < NEAR_BODY * F.col("body"))
    limit = F.when(near_body, MOST_WORDS_NEAR).when(F.col("large"), MOST_WORDS).otherwise(MOST_WORDS_NEAR)
    set_off = F.col("above").isNull() | (F.col("above") <= 0) | (F.col("above") > SET_OFF * F.col("typical"))
    found = runs.where(set_off & looks_like_heading(F.col("title"), limit, near_body))
    # runs of one style on a page with no body text between
    by_place = Window.partitionBy(key, "page").orderBy("line_no")
    same = (F.lag("size").over(by_place) == F.col("size")) & (F.lag("bold").over(by_place) == F.col("bold")) & (F.lag("body_before").over(by_place) == F.col("body_before"))
    found = found.withColumn("fresh", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("fresh").over(by_place))
    found = found.withColumn("members", F.count("*").over(Window.partitionBy(key, "page", "chain"))).where(F.col("members") < RUN)
    letters = F.regexp_replace("title", r"[^\p{L}]", "")
    found = found.withColumn("caps", (F.length(letters) >= 2) & (F.upper(letters) == letters))
    by_size = Window.partitionBy(key).orderBy(F.desc("size"))
    styles = found.select(key, "size").distinct().withColumn("fresh", F.when(F.col("size") >= F.lag("size").over(by_size) * (1 - SIZE_STEP), 0).otherwise(1)).withColumn("cluster", F.sum("fresh").over(by_size)).select(key, "size", "cluster")
    level = F.dense_rank().over(Window.partitionBy(key).orderBy("cluster", F.desc("bold"), F.desc("caps")))
    return found.join(styles, [key, "size"]).withColumn("level", level).select(key, "page", "line_no", "title", "level")
