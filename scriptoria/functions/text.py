"""Canonical text and scalar string functions, all as Catalyst expressions. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words, by Unicode (Java's and RE2's \s are ASCII only).
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAKS = r"[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
CONTROLS = r"[\x00-\x08\x0E-\x1B\x1F\x7F-\x{84}\x{86}-\x{9F}\x{FEFF}\x{AD}]"
#: Forms of credentials, in the order in which they are replaced.
SECRETS = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[opsu]_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{12,}",
    r"(?i)\bauthorization\s*:\s*basic\s+[^\s,;]+",
    r"(?i)(?:api[_-]?key|secret|password|token)\s*[:=]\s*[^\s,;]+",
    r"://[^\s/@:]+:[^\s/@]+@",
)
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("co", "dept", "dr", "e.g", "etc", "fig", "i.e", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "prof", "sr", "st", "u.k", "u.s", "vs")
FINISHED = r"""[.!?…。！？]["'”’»)\]}*_]*$"""


def normalized(text: Column) -> Column:
    """Without a leading byte-order mark, \\n line ends, no blanks at line ends, no empty first and last lines."""
    text = F.regexp_replace(text, r"^\x{FEFF}", "")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+(\n|\z)", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"\n+\z", "")


def cleaned(text: Column) -> Column:
    """Separators of other conventions to \\n, without control characters and soft hyphens, then normalized()."""
    return normalized(F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), CONTROLS, ""))


def has_text(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapsed(text: Column) -> Column:
    """Single blanks within lines, without empty lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.array_join(words(x), " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def one_line(text: Column) -> Column:
    return F.array_join(words(text), " ")


def redacted(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def preview(text: Column, limit: int = 800, slack: int = 80) -> Column:
    """The first `limit` characters of one line, cut at the last blank if that is near, with an ellipsis."""
    flat = one_line(text)
    head = F.substring(flat, 1, limit)
    blank = limit - F.instr(F.reverse(head), " ")  # characters before the last blank
    cut = F.when((F.instr(head, " ") > 0) & (blank > limit - slack), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def mostly_printable(text: Column) -> Column:
    """Not empty, with at most one control character in a hundred."""
    odd = F.regexp_count(text, F.lit(r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}]"))
    return (F.length(text) > 0) & (odd * 100 <= F.length(text))


def utf8_tokens(text: Column) -> Column:
    """The default token counter: UTF-8 bytes."""
    return F.octet_length(text)


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def proper_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?:[A-Z][a-z]+(?:['-][A-Za-z]+)?)(?:\s+(?:[A-Z][a-z]+(?:['-][A-Za-z]+)?))+)"), F.lit(1))


def district_labels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)(\b(?:Ward|District)\s+[0-9]+\b)"), F.lit(1))


def significant_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\b[0-9]{2,}\b|\b[0-9]{1,3}(?:,[0-9]{3})+\b)"), F.lit(1))


def clauses(text: Column) -> Column:
    return F.split(text, r"[,;:()\x{2013}\x{2014}]| - ", -1)


def straight_quotes(text: Column) -> Column:
    """Curly quotes, dashes and blanks in their plain forms, for comparing quotations."""
    text = F.translate(text, "‘’‚‛“”„‟‐‑‒–—−", "''''\"\"\"\"------")
    return F.regexp_replace(text, SPACE + "+", " ")


def segment_id(number: Column, letter: str = "S") -> Column:
    return F.format_string(letter + "%06d", number)


def node_id(level: Column, number: Column) -> Column:
    return F.format_string("L%dN%04d", level, number)


def node_place(name: Column) -> Column:
    """level and zero-based order of a node id; null if it is none."""
    level, order = F.regexp_extract(name, r"^L([0-9]+)N([0-9]+)$", 1), F.regexp_extract(name, r"^L([0-9]+)N([0-9]+)$", 2)
    good = name.rlike(r"^L[0-9]+N[0-9]+$") & (F.try_to_number(F.lpad(order, 9, "0"), F.lit("999999999")) >= 1)
    return F.when(good, F.struct(level.cast("int").alias("level"), (order.cast("int") - 1).alias("order")))


def pages_suffix(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "").when(first == last, F.concat(F.lit(" · p. "), first.cast("string"))).otherwise(F.concat(F.lit(" · pp. "), first.cast("string"), F.lit("–"), last.cast("string")))


def node_label(kind: Column, level: Column, order: Column, direct: Column, first: Column, last: Column) -> Column:
    number = (order + 1).cast("string")
    return (
        F.when((kind == "leaf") & direct, F.lit("Whole document"))
        .when(kind == "leaf", F.concat(F.lit("Segment "), number, pages_suffix(first, last)))
        .otherwise(F.concat(F.lit("Level "), level.cast("string"), F.lit(" · Group "), number, pages_suffix(first, last)))
    )


def human_bytes(n: Column) -> Column:
    unit = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, name in ((1, "KB"), (2, "MB"), (3, "GB")):
        size = F.format_string("%.1f " + name, F.bround(n / float(1024**power), 1))
        unit = unit.when(n < 1024 ** (power + 1), size) if power < 3 else unit.otherwise(size)
    return unit


def without_citations(text: Column) -> Column:
    """Drops bracketed lists that consist of segment ids, and the blank before them."""
    return F.regexp_replace(text, r"[ \t]*[(\[][SD][0-9]{6}(?:[,;][ ]*[SD][0-9]{6})*[)\]]", "")


def bounded_reason(text: Column, most: int = 400) -> Column:
    """One line of at most `most` UTF-8 bytes, cut at a whole character."""
    flat = one_line(text)
    n = F.aggregate(F.split(F.substring(flat, 1, most), ""), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")), lambda s, c: F.when((c != "") & (s["bytes"] + F.octet_length(c) <= most), F.struct((s["bytes"] + F.octet_length(c)).alias("bytes"), (s["chars"] + 1).alias("chars"))).otherwise(F.struct(F.lit(most + 1).alias("bytes"), s["chars"].alias("chars"))), lambda s: s["chars"])
    return F.when(F.octet_length(flat) <= most, flat).otherwise(F.substring(flat, F.lit(1), n))


def latex_escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\textbackslash{}")
    text = F.regexp_replace(text, r"([&%$#_])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(text, "~", r"\\textasciitilde{}"), r"\^", r"\\textasciicircum{}")


def file_title(name: Column) -> Column:
    """A file name without its path and extension, separators as blanks."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(.)\.[A-Za-z0-9]{1,8}$", "$1")
    return F.trim(F.regexp_replace(stem, r"[_\s-]+", " "))


def safe_filename(name: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9 ._-]+", "_"), r"^\.+", "")), 1, 120)
