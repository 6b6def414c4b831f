"""Lines, structural blocks, sentences, budgeted packs and segments. Offsets are code points; ranges are half open.

Lines, sentences and packs stay in the JVM and put no marks into texts; blocks, hard splits and overlap windows depend
on what was cut before, so a document's segments come from one pass over its text in an Arrow function, linear in its
length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import counters
from scriptoria.functions import text as T
from scriptoria.sources.arrow import flat_mapped

ENDS, CLOSERS = ".!?…。！？", r"""["'”’»)\]}*_]*"""
SENTENCE_END = rf"([{ENDS}]+{CLOSERS})(\s+)"
#: A full stop that ends an abbreviation with white space right after it ends no sentence.
_ABBREVIATED = r"(?<=(?:^|[^\p{L}\p{N}_])(?i:" + "|".join(re.escape(a) for a in T.ABBREVIATIONS) + r"))\.\s"
SENTENCE = rf"(?s).*?(?=[{ENDS}])(?<![{ENDS}])(?!{_ABBREVIATED})[{ENDS}]+{CLOSERS}\s+|.+\z"


def line_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, start, end (with the line end), content."""
    lines = docs.select(key, F.length("text").alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("int"))
    lines = lines.withColumn("end", F.least(F.col("start") + F.length("content") + 1, F.col("n")))
    return lines.where("end > start").select(key, "line_no", "start", "end", "content")


def sentences(text: Column) -> Column:
    """Pieces of a text that tile it: each ends with its sentence's closing marks and the white space after it. All
    characters stay: the pieces are matched one after the other, and nothing is put into the text to mark them."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def sentence_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, start, end, text: tiles the document; draft spans are these with ids and hashes."""
    parts = docs.select(key, F.posexplode(F.filter(sentences(F.col("text")), lambda s: s != "")).alias("ord", "text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("ord")).cast("int")
    return parts.withColumn("end", upto).select(key, "ord", (F.col("end") - F.length("text")).alias("start"), "end", "text")


def draft_spans(docs: DataFrame, stage: int = 1, key: str = "doc_id") -> DataFrame:
    """Sentence spans with ids and content hashes."""
    spans = sentence_spans(docs, key)
    return spans.select(key, F.format_string(f"V{stage:02d}S%06d", F.col("ord") + 1).alias("span_id"), (F.col("ord") + 1).alias("ordinal"), "start", "end", "text", F.sha2("text", 256).alias("content_hash"))


RUN = "struct<first:int,n:int,start:bigint,width:bigint,cost:bigint>"


def runs(costs: Column, widths: Column, most: Column) -> Column:
    """array<RUN>: packs of consecutive units, greedily in order; a unit over the budget is alone. first and n are units,
    start and width sum up `widths` before and in the pack, cost its costs. One pass; units aren't copied."""
    long = lambda c: c.cast("long")
    start = F.struct(F.array().cast(f"array<{RUN}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), long(F.lit(0)).alias("start"), long(F.lit(0)).alias("width"), long(F.lit(0)).alias("cost"))
    now = lambda s: F.struct(*(s[c].alias(c) for c in ("first", "n", "start", "width", "cost")))

    def step(s, unit):
        cost, width = long(unit["cost"]), long(unit["width"])
        more = F.struct(s["done"].alias("done"), s["first"].alias("first"), (s["n"] + 1).alias("n"), s["start"].alias("start"), (s["width"] + width).alias("width"), (s["cost"] + cost).alias("cost"))
        new = F.struct(F.concat(s["done"], F.array(now(s))).alias("done"), (s["first"] + s["n"]).alias("first"), F.lit(1).alias("n"), (s["start"] + s["width"]).alias("start"), width.alias("width"), cost.alias("cost"))
        return F.when((s["n"] == 0) | (s["cost"] + cost <= most), more).otherwise(new)

    units = F.zip_with(costs, widths, lambda c, w: F.struct(c.alias("cost"), w.alias("width")))
    return F.aggregate(units, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(now(s)))).otherwise(s["done"]))


def packs(costs: Column, most: Column) -> Column:
    """array<int>: how many units each pack takes, greedily in order; a unit over the budget is alone."""
    return F.transform(runs(costs, costs, most), lambda r: r["n"])


def packed_sentences(docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """key, ord, units, tokens, start, end: sentences packed to `most` UTF-8 bytes.

    Packs are cut within the document's own row, and each row that leaves has its own pack's text alone: no shuffle, and
    work in proportion to the text."""
    own = docs.select(key, F.filter(sentences(F.col("text")), lambda s: s != "").alias("s"))
    own = own.withColumn("p", runs(F.transform("s", F.octet_length), F.transform("s", F.length), F.lit(most)))

    def pack(r):
        end = (r["start"] + r["width"]).cast("int")
        return F.struct(r["n"].alias("units"), r["cost"].cast("int").alias("tokens"), r["start"].cast("int").alias("start"), end.alias("end"), F.array_join(F.slice("s", r["first"] + 1, r["n"]), "").alias("text"))

    return own.select(key, F.posexplode(F.transform("p", pack)).alias("ord", "r")).select(key, "ord", "r.units", "r.tokens", "r.start", "r.end", "r.text")


def packed_lines(docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """key, ord, units, tokens: whole lines packed to `most` bytes."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.octet_length(x) + 1)
    own = docs.select(key, sizes.alias("sizes")).select(key, F.posexplode(runs(F.col("sizes"), F.col("sizes"), F.lit(most))).alias("ord", "r"))
    return own.select(key, "ord", F.col("r.n").alias("units"), F.col("r.cost").cast("int").alias("tokens"))


def legacy_chunks(text: Column, most: int) -> Column:
    """Sentence chunks by characters as the flat workflow makes them: the first begins with a blank, and the size check leaves blanks out."""
    own = F.filter(F.transform(sentences(text), lambda s: F.trim(F.regexp_replace(s, r"\s+$", ""))), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, x):
        full = (F.length(s["now"]) + F.length(x) > most) & (s["now"] != "")
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(" "), x).alias("now")))

    return F.aggregate(own, start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


# Structural blocks

ATX, SETEXT = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)"), re.compile(r" {0,3}(=+|-+)[ \t]*$")
ITEM, FENCE = re.compile(r" {0,3}(?:[-+*][ \t]+|\d+[.)][ \t]+)"), re.compile(r" {0,3}(`{3,}|~{3,})")


def structural_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) that tile the text: fences, headings, lists and paragraphs, each with the empty lines after it."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    starts[-1] = len(text)
    kinds, n = [], len(lines)

    def underlined(i: int) -> bool:
        return bool(lines[i]) and i + 1 < n and SETEXT.fullmatch(lines[i + 1]) is not None

    def opening(i: int) -> str:
        """What a block that begins here is."""
        if FENCE.match(lines[i]):
            return "code_fence"
        if ATX.match(lines[i]) or underlined(i):
            return "heading"
        return "list" if ITEM.match(lines[i]) else "paragraph"

    i = 0
    while i < n:
        begin, kind = i, opening(i)
        i += 1
        if kind == "code_fence":
            mark = FENCE.match(lines[begin])[1]
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            while i < n and not close.match(lines[i]):
                i += 1
            i = min(n, i + 1)
        elif kind == "heading":
            i += not ATX.match(lines[begin])
        else:
            ends = ("code_fence", "heading") if kind == "list" else ("code_fence", "heading", "list")
            while i < n and lines[i] and opening(i) not in ends:
                i += 1
        while i < n and not lines[i]:
            i += 1
        kinds.append((starts[begin], starts[i], kind))
    return kinds


def markdown_headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, start, end) of headings outside fences; a paragraph right above a setext line is part of its title."""
    out, before = [], None
    for start, end, kind in structural_blocks(text):
        above, before = before, (start, end, kind)
        if kind != "heading":
            continue
        lines = text[start:end].split("\n")
        if found := ATX.match(lines[0]):
            title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", lines[0].strip()[len(found[1]) :].strip())
            level, stop = len(found[1]), start + len(lines[0])
        else:
            level, stop, parts = 1 if "=" in lines[1] else 2, start + len(lines[0]) + 1 + len(lines[1].rstrip()), [lines[0]]
            if above and above[2] == "paragraph" and not text[above[0] : above[1]].endswith("\n\n"):
                parts = text[above[0] : above[1]].splitlines() + parts
                start = above[0]
            title = " ".join(p.strip() for p in parts)
        if title.strip():
            out.append((level, title.strip(), start, stop))
    return out


# Segments under a budget

_CUT = re.compile(SENTENCE_END)
_KEPT = re.compile(r"(?i)\b(?:" + "|".join(re.escape(a) for a in T.ABBREVIATIONS) + r")\.$")


def sentence_starts(text: str) -> list[int]:
    """Where sentences begin, by the rule of sentences()."""
    out = [0]
    for m in _CUT.finditer(text):
        if m[1] == "." and _KEPT.search(text, max(0, m.end(1) - 8), m.end(1)):
            continue
        if m.end() < len(text):
            out.append(m.end())
    return out


def utf8_size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


class Budget:
    """A counter over one text: prefix sums where it adds up, else a search, which is counted again where the counter isn't monotone.

    count: a function of a text, or one of functions.counters."""

    def __init__(self, text: str, count=utf8_size):
        self.text, self.counter = text, count if hasattr(count, "count") else None
        self.count = self.counter.count if self.counter else count
        self.sums = None
        if count is utf8_size:
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            begins = np.flatnonzero((raw & 0xC0) != 0x80)  # a character's first byte
            self.sums = [*begins.tolist(), len(raw)]

    def cost(self, a: int, b: int) -> int:
        return self.sums[b] - self.sums[a] if self.sums else self.count(self.text[a:b])

    def furthest(self, a: int, end: int, most: int) -> int:
        """The largest b <= end with cost(a, b) <= most."""
        if self.counter:
            return counters.fitting_prefix(self.counter, self.text, a, end, most)
        lo, hi = a, end
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.cost(a, mid) <= most else (lo, mid - 1)
        return lo

    def earliest(self, begin: int, b: int, most: int) -> int:
        """The least a >= begin with cost(a, b) <= most."""
        if self.counter:
            return counters.fitting_suffix(self.counter, self.text, begin, b, most)
        lo, hi = begin, b
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cost(mid, b) <= most else (mid + 1, hi)
        return lo

    def hard(self, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
        """Pieces of at most `most`, cut after white space where there is some."""
        while a < b:
            end = self.furthest(a, b, most)
            if end <= a:
                raise ValueError("the budget holds no character")
            if end < b:
                blank = next((i for i in range(end, a, -1) if self.text[i - 1].isspace()), end)
                end = blank if self.cost(a, blank) <= most else end
            yield a, end
            a = end


def cores(budget: Budget, spans: list[tuple[int, int]], most: int) -> list[tuple[int, int, str]]:
    """Contiguous cores within each span: whole blocks, else sentences, else hard pieces, packed greedily; a heading begins a pack."""
    out = []
    for lo, hi in spans:
        units = []
        for s, e, kind in structural_blocks(budget.text[lo:hi]):
            s, e = s + lo, e + lo
            if budget.cost(s, e) <= most:
                units.append((s, e, kind))
                continue
            starts = [s + x for x in sentence_starts(budget.text[s:e])]
            for a, b in zip(starts, [*starts[1:], e], strict=True):
                if len(starts) > 1 and budget.cost(a, b) <= most:
                    units.append((a, b, "sentence"))
                else:
                    units += [(x, y, "hard") for x, y in budget.hard(a, b, most)]
        first = len(out)
        for s, e, kind in units:
            if len(out) > first and kind != "heading" and budget.cost(out[-1][0], e) <= most:
                out[-1] = (out[-1][0], e, kind)
            else:
                out.append((s, e, kind))
    return out


def segment(text: str, most: int, overlap: int = 0, spans: list[tuple[int, int]] | None = None, count: Callable[[str], int] = utf8_size) -> list[tuple]:
    """(order, core_start, core_end, context_start, context_end, core_tokens, tokens, lead_tokens, trail_tokens, kind).

    Context reaches into the neighbouring cores by `overlap` at most and never makes a segment larger than `most`;
    what leads comes first, what trails gets the rest; a sentence begin or end is preferred."""
    budget, out = Budget(text, count), []
    own = cores(budget, spans or [(0, len(text))], most)
    for i, (s, e, kind) in enumerate(own):
        core = budget.cost(s, e)
        lead = trail = 0
        a, b = s, e
        if overlap and i and own[i - 1][1] == s:
            a = budget.earliest(own[i - 1][0], s, min(overlap, most - core))
            better = [own[i - 1][0] + x for x in sentence_starts(text[own[i - 1][0] : s])]
            a = next((x for x in better if x >= a), a)
            lead = budget.cost(a, s)
        if overlap and i + 1 < len(own) and own[i + 1][0] == e:
            b = budget.furthest(e, own[i + 1][1], min(overlap, most - core - lead))
            better = [e + x for x in sentence_starts(text[e : own[i + 1][1]])[1:]] + [own[i + 1][1]]
            b = max((x for x in better if x <= b), default=b)
            trail = budget.cost(e, b)
        out.append((i, s, e, a, b, core, budget.cost(a, b), lead, trail, kind))
    return out


SEGMENT = "ord int, core_start int, core_end int, context_start int, context_end int, core_tokens int, tokens int, lead_tokens int, trail_tokens int, kind string"


def segments(docs: DataFrame, most: int, overlap: int = 0, spans: str | None = None, key: str = "doc_id", count: Callable[[str], int] = utf8_size) -> DataFrame:
    """key, segment_id and SEGMENT; spans: a column of array<struct<start,end>> that limits and bounds segments."""

    def rows(k, text, own=None) -> Iterator[tuple]:
        for r in segment(text or "", most, overlap, [(s["start"], s["end"]) for s in own] if own is not None else None, count) if text else ():
            yield (k, f"S{r[0] + 1:06d}", *r)

    chosen = docs.select(key, "text", *([spans] if spans else []))
    return flat_mapped(chosen, f"{key} {dict(docs.dtypes)[key]}, segment_id string, {SEGMENT}", rows)


def blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_no, start, end, kind."""

    def rows(k, text) -> Iterator[tuple]:
        for i, b in enumerate(structural_blocks(text or "")):
            yield (k, i, *b)

    return flat_mapped(docs.select(key, "text"), f"{key} {dict(docs.dtypes)[key]}, block_no int, start int, end int, kind string", rows)


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, heading_no, level, title, start, end."""

    def rows(k, text) -> Iterator[tuple]:
        for i, h in enumerate(markdown_headings(text or "")):
            yield (k, i, *h)

    return flat_mapped(docs.select(key, "text"), f"{key} {dict(docs.dtypes)[key]}, heading_no int, level int, title string, start int, end int", rows)


def broken(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that break the tiling: cores contiguous from 0 to the end, dense order. None is right."""
    order = Window.partitionBy(key).orderBy("ord")
    checked = found.join(docs.select(key, F.length("text").alias("n")), key)
    before, after = F.coalesce(F.lag("core_end").over(order), F.lit(0)), F.lead("core_start").over(order)
    checked = checked.withColumn("bad", (F.col("core_start") != before) | (F.col("ord") != F.row_number().over(order) - 1) | (after.isNull() & (F.col("core_end") != F.col("n"))) | (F.col("context_start") > F.col("core_start")) | (F.col("context_end") < F.col("core_end")))
    return checked.where("bad").select(key, "ord", "core_start", "core_end")
