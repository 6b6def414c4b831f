"""Claims against sources: lexical evidence under a budget, verdicts, repairs and what is published.

Every join carries the document, so that a frequent word meets only its own document's passages; counts are combined
before they are shuffled; greedy packing is a fold over one claim's ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import numbers as N
from scriptoria.functions import text as T

VERDICTS = ("supported", "contradicted", "insufficiently_supported", "not_meaningfully_verifiable")
# Thresholds of the overlap floor, and words that carry no content.
LEAST_SHARE, LEAST_SHARED, LONG_SPAN, CLAUSE_WORDS = 0.15, 3, 6, 3
FUNCTION_WORDS = """a about above after again against all am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is
it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some
such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where
which while who whom why will with would you your yours yourself yourselves also may might must shall one s t""".split()


# Claims and evidence


def claims(spans: DataFrame, stage: int = 1, key: str = "doc_id") -> DataFrame:
    """Claims of spans (key, span_id, text, anchors array<string>): anchors that occur in the text, and the whole span unless an anchor equals it."""
    whole = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    good = F.array_distinct(F.filter(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: (a != "") & F.contains(F.col("text"), a)))
    every = F.when(F.array_contains(good, whole), good).otherwise(F.concat(good, F.array(whole)))
    rows = spans.where(whole != "").select(key, "span_id", whole.alias("whole"), F.posexplode(every).alias("k", "anchor"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("span_id", "k"))
    rows = rows.withColumn("claim_id", F.format_string(f"V{stage:02d}C%06d", number)).withColumn("is_fallback", F.col("anchor") == F.col("whole"))
    return rows.select(key, "claim_id", "span_id", (F.col("k") + 1).alias("ordinal"), "anchor", "is_fallback")


def lexical_index(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, segment_id, ord, term."""
    return segments.select(key, "segment_id", "ord", F.explode(T.terms(F.col("text"))).alias("term"))


def required(anchor: Column, text: Column) -> Column:
    """Whether a passage literally has the claim's names (all), a label or a number of it."""
    names, labels, numbers, low = T.proper_names(anchor), T.district_labels(anchor), T.significant_numbers(anchor), F.lower(text)
    return ((F.size(names) > 0) & F.forall(names, lambda n: F.contains(low, F.lower(n)))) | F.exists(labels, lambda w: F.contains(low, F.lower(w))) | F.exists(numbers, lambda n: F.contains(text, n))


def json_size(text: Column) -> Column:
    """Bytes of a JSON string with escaped non-ASCII characters, without its quotes."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    return F.length(text) + n(r'["\\\x08\t\n\f\r]') + 5 * n(r"[\x00-\x07\x0B\x0E-\x1F\x7F-\x{FFFF}]") - 5 * n(r"\x7F") + 11 * n(r"[\x{10000}-\x{10FFFF}]")


def passage_cost(segment_id: Column, text: Column) -> Column:
    """Bytes of a passage as it is sent: {"segment_id":"...","text":"..."}."""
    return F.lit(len('{"segment_id":"","text":""}')) + json_size(segment_id) + json_size(text)


def ranked(claim_rows: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, claim_id, segment_id, ord, required, overlap, rank, cost: required passages first, then shared terms, then source order."""
    mine = claim_rows.select(key, "claim_id", F.explode(T.terms(F.col("anchor"))).alias("term"))
    shared = mine.join(lexical_index(segments, key), [key, "term"]).groupBy(key, "claim_id", "segment_id").agg(F.count("*").alias("overlap"))
    # only claims that have a name, label or number meet texts; the others meet their passages' ids and costs alone
    literal = claim_rows.where(F.size(T.proper_names(F.col("anchor"))) + F.size(T.district_labels(F.col("anchor"))) + F.size(T.significant_numbers(F.col("anchor"))) > 0)
    must = literal.select(key, "claim_id", "anchor").join(segments.select(key, "segment_id", "text"), key).where(required(F.col("anchor"), F.col("text")))
    must = must.select(key, "claim_id", "segment_id", F.lit(True).alias("required"))
    slim = segments.select(key, "segment_id", "ord", passage_cost(F.col("segment_id"), F.col("text")).alias("cost"))
    pairs = claim_rows.select(key, "claim_id").join(slim, key)
    rows = pairs.join(must, [key, "claim_id", "segment_id"], "left").join(shared, [key, "claim_id", "segment_id"], "left")
    rows = rows.withColumn("required", F.coalesce("required", F.lit(False))).withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    order = Window.partitionBy(key, "claim_id").orderBy(F.desc("required"), F.desc("overlap"), "ord")
    return rows.withColumn("rank", F.row_number().over(order))


def selected(rows: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """key, claim_id, chosen, omitted, token_cost, complete: greedily in rank order, passing over what doesn't fit; a line end between passages."""
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.array().cast("array<string>").alias("ids"))

    def step(s, p):
        cost = s["cost"] + p["cost"] + F.when(s["cost"] > 0, 1).otherwise(0)
        return F.when(cost <= budget, F.struct(cost.cast("long").alias("cost"), F.concat(s["ids"], F.array(p["segment_id"])).alias("ids"))).otherwise(s)

    found = rows.groupBy(key, "claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "segment_id", "cost"))).alias("p"))
    found = found.withColumn("s", F.aggregate("p", start, step))
    omitted = F.filter(F.col("p.segment_id"), lambda x: ~F.array_contains(F.col("s.ids"), x))
    return found.select(key, "claim_id", F.col("s.ids").alias("chosen"), omitted.alias("omitted"), F.col("s.cost").alias("token_cost"), (F.size(omitted) == 0).alias("complete"))


# Verdicts


def reduced(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict per claim of its batches' findings (verdict, complete), conservatively."""
    has = lambda v: F.bool_or(F.col("verdict") == v)
    flags = findings.groupBy(*keys).agg(has(VERDICTS[0]).alias("s"), has(VERDICTS[1]).alias("c"), has(VERDICTS[3]).alias("n"), F.countDistinct("verdict").alias("kinds"), F.bool_and("complete").alias("complete"))
    verdict = (
        F.when(F.expr("s and c"), VERDICTS[2]).when(F.expr("n and kinds > 1"), VERDICTS[2]).when(F.col("n"), VERDICTS[3])
        .when(F.expr("c and complete and not s"), VERDICTS[1]).when(F.col("s"), VERDICTS[0]).otherwise(VERDICTS[2])
    )
    reason = F.when(F.expr("s and c"), "conflicting_evidence").when(F.expr("n and kinds > 1"), "inconsistent_meaningfulness")
    return flags.select(*keys, verdict.alias("verdict"), reason.alias("reason"))


def sentence_verdicts(assessed: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all claims of a span are supported, and the worst verdict else."""
    severity = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate((VERDICTS[0], VERDICTS[3], VERDICTS[2], VERDICTS[1])) for x in (v, i)]), F.col("verdict"))
    return assessed.groupBy(*keys).agg(F.bool_and(F.col("verdict") == VERDICTS[0]).alias("supported"), F.max_by("verdict", severity).alias("worst"), F.count("*").alias("claims"))


def published(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, sentences of spans (key, ordinal, text, supported): groups of spans that continue in lower case publish only whole; paragraph breaks that dropped text crossed stay."""
    order = Window.partitionBy(key).orderBy("ordinal")
    own = spans.withColumn("t", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where("t <> ''")
    begins = F.when(F.substring("t", 1, 1).rlike(r"\p{Ll}") & (F.row_number().over(order) > 1), 0).otherwise(1)
    own = own.withColumn("begins", begins).withColumn("group", F.sum("begins").over(order))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "t", "text")))
    groups = own.groupBy(key, "group").agg(F.bool_and("supported").alias("ok"), ordered.alias("s"))
    joined = F.array_join(F.col("s.t"), " ")
    any_break = F.exists(F.col("s.text"), lambda x: x.rlike(r"\n\s*\n"))
    end_break = F.element_at(F.col("s.text"), -1).rlike(r"\n\s*\n\s*$")
    groups = groups.select(key, "group", "ok", joined.alias("piece"), F.when(F.col("ok"), end_break).otherwise(any_break).alias("breaks"))
    # a break stands before a kept group if the kept group before it ended in one, or what was dropped between had one
    by_group = Window.partitionBy(key).orderBy("group")
    kept = F.sum(F.col("ok").cast("int")).over(by_group.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("kept", F.coalesce(kept, F.lit(0)))
    broken = groups.withColumn("after", F.col("kept") + F.col("ok").cast("int")).where("breaks").select(key, F.col("after").alias("kept")).distinct().withColumn("gap", F.lit("\n\n"))
    rows = groups.where("ok").join(broken, [key, "kept"], "left")
    piece = F.concat(F.when(F.col("kept") == 0, "").otherwise(F.coalesce("gap", F.lit(" "))), F.col("piece"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kept", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"), F.count("*").alias("sentences"))


#: Scripts that are written without blanks, so that a run of letters is no word.
UNSEGMENTED = "[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Khitan_Small_Script", "Khmer", "Lao", "Myanmar", "Nushu", "Tangut", "Thai")) + "]"


def content_words(text: Column) -> Column:
    """Words that carry content, in order, without common endings; none of scripts that are written without blanks."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: ~w.isin(*FUNCTION_WORDS) & ~w.rlike(UNSEGMENTED))
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(?:ing|edly|ed|ly|es|s)$", "")).otherwise(w))


def overlap_too_low(text: Column, quotes: Column) -> Column:
    """Whether the quotes leave part of the text, or of one of its clauses, unstated."""
    quoted = F.array_distinct(content_words(quotes))

    def low(sequence):
        own = F.array_distinct(sequence)
        shared = F.size(F.array_intersect(own, quoted))
        run = F.aggregate(sequence, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, w: F.struct(F.when(F.array_contains(quoted, w), 0).otherwise(s["now"] + 1).alias("now"), F.greatest(s["most"], F.when(F.array_contains(quoted, w), 0).otherwise(s["now"] + 1)).alias("most")), lambda s: s["most"])
        return (F.size(own) > 0) & ((shared < LEAST_SHARE * F.size(own)) | ((F.size(own) >= LONG_SPAN) & (shared < LEAST_SHARED)) | ((F.size(quoted) >= LEAST_SHARED) & (run >= CLAUSE_WORDS)))

    parts = F.transform(T.clauses(text), content_words)
    return low(content_words(text)) | F.exists(parts, lambda p: (F.size(F.array_distinct(p)) >= CLAUSE_WORDS) & low(p))


def repaired(spans: DataFrame, repairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: spans (key, span_id, ordinal, text, content_hash) with repairs (key, span_id, original_hash, action, replacement) whose hash still fits."""
    rows = spans.join(repairs, [key, "span_id"], "left")
    fits = F.col("original_hash") == F.col("content_hash")
    tail = F.regexp_extract("text", r"(\s*)$", 1)
    piece = F.when(fits & (F.col("action") == "remove"), "").when(fits, F.concat(F.col("replacement"), tail)).otherwise(F.col("text"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", piece.alias("p")))), lambda x: x["p"]), "").alias("text"), F.count_if(fits).alias("repairs"))


def assembled_kind(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The worst kind of a document's sections: unchecked, subset, verified."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    return sections.groupBy(key).agg(F.when(has("failed"), "failed").when(has("unchecked"), "unchecked").when(has("subset"), "subset").otherwise("verified").alias("kind"), F.count("*").alias("sections"))


def audit_faults(segments: DataFrame, citations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Citations (key, node_id, segment_id, quote) that name no segment of the document or a quote that isn't in it. None is right."""
    known = segments.select(key, "segment_id", F.col("text").alias("source"))
    rows = citations.join(known, [key, "segment_id"], "left")
    fault = F.when(F.col("source").isNull(), "unknown_segment").when(F.col("quote").isNotNull() & ~F.contains("source", "quote"), "quote_not_found")
    return rows.withColumn("fault", fault).where("fault is not null").select(key, "node_id", "segment_id", "fault")


def lost_sentences(source: DataFrame, shortened: DataFrame, key: str = "doc_id") -> DataFrame:
    """Source sentences (key, ord, text) with a number that the shortened text (key, text) no longer has."""
    literals = source.select(key, "ord", "text", F.explode(F.array_distinct(T.significant_numbers(F.col("text")))).alias("literal"))
    kept = shortened.select(key, F.explode(F.array_distinct(T.significant_numbers(F.col("text")))).alias("literal"))
    return literals.join(kept, [key, "literal"], "left_anti").groupBy(key, "ord", "text").agg(F.array_sort(F.collect_set("literal")).alias("lost"))


def compressed(sentences: DataFrame, target: int, key: str = "doc_id") -> DataFrame:
    """key, text, words: the deterministic shortening: sentences of most terms first until `target` words are reached, in their own order."""
    rows = sentences.withColumn("words", T.word_count(F.col("text"))).withColumn("rank", F.size(T.terms(F.col("text"))))
    best = Window.partitionBy(key).orderBy(F.desc("rank"), "ord")
    rows = rows.withColumn("upto", F.sum("words").over(best)).withColumn("first", F.row_number().over(best))
    kept = rows.where((F.col("upto") <= target) | (F.col("first") == 1))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.sum("words").alias("words"))


def classified(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The deterministic classifier of claims (anchor) against a passage (text): supported where all of the claim's terms are in it."""
    mine, theirs = T.terms(F.col("anchor")), T.terms(F.col("text"))
    share = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1))
    verdict = F.when(F.size(mine) == 0, VERDICTS[3]).when(share == 1, VERDICTS[0]).otherwise(VERDICTS[2])
    return evidence.select(*keys, verdict.alias("verdict"), share.alias("share"))


# Allowed differences

#: Words that don't count when wordings are compared, and units in one form.
LENIENT = "a an the of to in on for and or with from by at as is was were be been being that this it its their his her".split()
UNITS = {"ft": "foot", "feet": "foot"}


def wording(text: Column) -> Column:
    """Distinct words that matter for a comparison: no numbers, approximations or function words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+(?:-[a-z]+)?)"), F.lit(1))
    tens, ones = "|".join(N.TENS), "|".join(N.UNITS)
    skipped = [*LENIENT, *N.APPROXIMATE, *N.UNITS, *N.TENS]
    words = F.filter(words, lambda w: ~w.isin(*skipped) & ~w.rlike(f"^(?:{tens})-(?:{ones})$"))
    fold = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(fold, w), w)))


def allowed_difference(anchor: Column, evidence: Column, strict_numbers: bool = False, strict_names: bool = False) -> Column:
    """"rounded_number" or "shortened_name" if that may be all that a claim differs in, else null; it only asks for a second look."""
    same = (F.size(wording(anchor)) > 0) & (F.size(F.array_except(wording(anchor), wording(evidence))) == 0)
    mine, theirs = N.number_values(anchor), N.number_values(evidence)
    number = same & F.when(F.size(mine) > 0, N.numbers_close(anchor, evidence)).otherwise(F.size(theirs) > 0)
    low = F.lower(anchor)
    shortened = F.exists(T.proper_names(evidence), lambda n: ~F.contains(low, F.lower(n)) & F.exists(F.split(F.lower(n), " +"), lambda p: F.regexp_like(low, F.concat(F.lit("(?:^|[^a-z0-9])"), p, F.lit("(?:[^a-z0-9]|$)")))))
    named = same & F.forall(T.proper_names(anchor), lambda n: F.contains(F.lower(evidence), F.lower(n))) & shortened
    by_number = F.lit(not strict_numbers) & number
    found = F.when(by_number & ~(F.lit(strict_names) & shortened), "rounded_number").when(~by_number & F.lit(not strict_names) & named, "shortened_name")
    return F.when(F.trim(evidence) != "", found)


# A whole pass


def passages(segments: DataFrame, most: int, key: str = "doc_id", least: int = 32) -> DataFrame:
    """key, segment_id, source_id, ord, text: segments whose text is over `most` bytes are cut at half of it, at blanks where there are some; the pieces are numbered after the last segment."""
    from scriptoria.operators.segments import Budget
    from scriptoria.sources.arrow import flat_mapped

    def rows(k, segment, order, text):
        budget = Budget(text or "")
        whole = budget.cost(0, len(text or "")) <= most
        for n, (a, b) in enumerate([(0, len(text or ""))] if whole else budget.hard(0, len(text), max(least, most // 2))):
            yield (k, segment, order, n, whole, text[a:b] if text else "")

    kinds = dict(segments.dtypes)
    parts = flat_mapped(segments.select(key, "segment_id", "ord", "text"), f"{key} {kinds[key]}, source_id string, source_ord {kinds['ord']}, part int, whole boolean, text string", rows)
    extra = F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy("source_ord", "part"))
    last = F.max("source_ord").over(Window.partitionBy(key))
    parts = parts.withColumn("ord", F.when(F.col("whole"), F.col("source_ord")).otherwise(last + extra))
    return parts.select(key, F.when(F.col("whole"), F.col("source_id")).otherwise(F.format_string("S%06d", F.col("ord") + 1)).alias("segment_id"), "source_id", "ord", "text")


def evidence_batches(rows: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """key, claim_id, batch, segment_ids: all ranked passages of a claim, as many in a batch as the budget holds; the first batch is what a first look sees, the rest is what it omitted."""
    from scriptoria.operators.segments import runs

    found = rows.groupBy(key, "claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "segment_id", "cost"))).alias("p"))
    found = found.withColumn("sizes", F.transform("p", lambda p: p["cost"] + 1))
    batches = F.transform(runs(F.col("sizes"), F.col("sizes"), F.lit(budget)), lambda r: F.slice(F.col("p.segment_id"), r["first"] + 1, r["n"]))
    return found.select(key, "claim_id", F.posexplode(batches).alias("batch", "segment_ids"))


#: Marks that count as the plain one when a quotation is looked for.
LIKE_QUOTES = {"'": "\u2018\u2019\u201a\u201b\u2032", '"': "\u201c\u201d\u201e\u201f\u2033", "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"}


def _alike(text: Column) -> Column:
    """A text with each run of white space as one blank, and quotation marks and dashes in their plain shape."""
    plain = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.translate(plain, "".join(LIKE_QUOTES.values()), "".join(p * len(others) for p, others in LIKE_QUOTES.items()))


def located(quote: Column, passage: Column) -> Column:
    """The piece of a passage that a quotation copies, as the passage has it, or null.

    An exact copy is itself. Else white space may differ in its kind and amount, and quotation marks and dashes in their
    shape: both texts are compared in one form, in which only white space is shorter, so the lengths of the passage's runs
    of white space carry a place back. (As a pattern, a quotation would nest as deep as it has words.)"""
    sought = F.trim(_alike(quote))
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  use(value), computed once
    blanks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" ")))
    length = lambda runs, first, n: F.length(F.array_join(F.slice(runs, first, n), ""))

    def piece(x):
        """x: plain, sought, at (from 1), runs."""
        before = F.substring(x["plain"], F.lit(1), x["at"] - 1)
        own = lambda b, n: F.substring(passage, x["at"] - b + length(x["runs"], F.lit(1), b), F.length(x["sought"]) - n + length(x["runs"], b + 1, n))
        return bound(F.struct(blanks(before).alias("b"), blanks(x["sought"]).alias("n")), lambda y: own(y["b"], y["n"]))

    runs = F.regexp_extract_all(passage, F.lit(r"(?U)\s+"), F.lit(0))
    both = F.struct(_alike(passage).alias("plain"), sought.alias("sought"))
    placed = lambda x: bound(x.withField("at", F.instr(x["plain"], x["sought"])), lambda y: F.when(y["at"] > 0, bound(y.withField("runs", runs), piece)))
    found = bound(both, placed)
    return F.when(sought == "", F.lit(None)).when(F.contains(passage, quote), quote).otherwise(found)


def restored(source: DataFrame, shortened: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: shortened texts (key, text) with the source sentences (key, ord, text) whose numbers they lost after a blank line, in
    their order; a sentence that is there already isn't put back, and a text shortened to nothing is its whole source."""
    short = shortened.select(key, F.trim("text").alias("short"))
    low = F.lower("short")
    lost = lost_sentences(source, shortened, key).join(short, key).where(~F.contains(low, F.lower(F.trim("text"))))
    tail = lost.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("tail"))
    empty = source.join(short.where("short = ''").select(key), key, "left_semi").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("whole"))
    rows = short.join(tail, key, "left").join(empty, key, "left")
    text = F.when(F.col("short") == "", F.trim("whole")).when(F.col("tail").isNull(), F.col("short")).otherwise(F.concat("short", F.lit("\n\n"), "tail"))
    return rows.select(key, text.alias("text"))


def provenance_faults(node: Column, legal: Column, available: Column | None = None, require: bool = True) -> Column:
    """array<string>: what is wrong with the references of a record (records.NODE). legal: map of segment ids that may be cited to their texts.

    no_evidence: a unit without any; no_annotation_evidence: a qualification or contradiction without any; unknown_segment: a
    reference to none of legal; no_provenance: nothing is cited where `require` asks for it; quotation, unit_quote and
    annotation_quote: a quotation that isn't in the very segment it cites. Quotations are checked only in `available` (all
    of legal by default)."""
    available = legal if available is None else available
    empty = F.array().cast("array<struct<segment_id:string,quote:string>>")
    units = F.coalesce(node["content_units"]["evidence"], F.array().cast("array<array<struct<segment_id:string,quote:string>>>"))
    notes = F.concat(*(F.coalesce(node[c]["evidence"], F.array().cast("array<array<struct<segment_id:string,quote:string>>>")) for c in ("qualifications", "contradictions")))
    quotations, provenance = F.coalesce(node["quotations"], empty), F.coalesce(node["provenance"], F.array().cast("array<string>"))
    bare = lambda groups: F.exists(groups, lambda g: F.coalesce(F.size(g) <= 0, F.lit(True)))
    flat = lambda groups: F.flatten(F.transform(groups, lambda g: F.coalesce(g, empty)))
    cited = F.concat(provenance, F.transform(F.concat(quotations, flat(units), flat(notes)), lambda e: e["segment_id"]))
    texts = lambda e: F.try_element_at(available, e["segment_id"])
    false = lambda quotes: F.exists(quotes, lambda e: F.coalesce(e["quote"].isNotNull() & ~F.contains(texts(e), e["quote"]), F.lit(False)))
    rules = (
        ("no_evidence", bare(units)), ("no_annotation_evidence", bare(notes)), ("unknown_segment", F.exists(cited, lambda c: ~F.coalesce(F.map_contains_key(legal, F.coalesce(c, F.lit(""))), F.lit(False)))),
        ("no_provenance", F.lit(require) & (F.size(provenance) == 0)), ("quotation", false(quotations)), ("unit_quote", false(flat(units))), ("annotation_quote", false(flat(notes))),
    )
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def validated(findings: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings (key, claim_id, batch, verdict, segment_id, quote, chosen): a verdict whose evidence wasn't chosen, or whose quote isn't in it, becomes insufficient and loses its evidence."""
    known = segments.select(key, "segment_id", F.col("text").alias("source"))
    rows = findings.join(known, [key, "segment_id"], "left")
    good = F.array_contains("chosen", F.col("segment_id")) & located(F.col("quote"), F.col("source")).isNotNull()
    good = F.coalesce(good, F.lit(False)) | F.col("verdict").isin(VERDICTS[2], VERDICTS[3])
    cited = good & ~F.col("verdict").isin(VERDICTS[2], VERDICTS[3])
    return rows.select(key, "claim_id", "batch", F.when(good, F.col("verdict")).otherwise(VERDICTS[2]).alias("verdict"), F.when(cited, F.col("segment_id")).alias("segment_id"), F.when(cited, F.col("quote")).alias("quote"), (~good).alias("downgraded"))


def verified(claim_rows: DataFrame, segments: DataFrame, budget: int, key: str = "doc_id", strict_numbers: bool = False, strict_names: bool = False) -> DataFrame:
    """key, claim_id, verdict, reason, tolerance of claims (key, claim_id, anchor) by the deterministic classifier.

    All evidence is examined batch by batch, so retrieval is complete; a claim that stays unsupported gets a second look
    where a passage differs from it only in what is allowed."""
    ranked_rows = ranked(claim_rows, segments, key)
    batches = evidence_batches(ranked_rows, budget, key).select(key, "claim_id", "batch", F.explode("segment_ids").alias("segment_id"))
    seen = batches.join(segments.select(key, "segment_id", "text"), [key, "segment_id"]).join(claim_rows.select(key, "claim_id", "anchor"), [key, "claim_id"])
    found = classified(seen, [key, "claim_id", "batch"]).withColumn("complete", F.lit(True))
    verdicts = reduced(found, [key, "claim_id"])
    lenient = seen.withColumn("tolerance", allowed_difference(F.col("anchor"), F.col("text"), strict_numbers, strict_names)).groupBy(key, "claim_id").agg(F.max("tolerance").alias("tolerance"))
    rows = verdicts.join(lenient, [key, "claim_id"])
    second = (F.col("verdict") == VERDICTS[2]) & F.col("reason").isNull() & F.col("tolerance").isNotNull()
    return rows.select(key, "claim_id", F.when(second, VERDICTS[0]).otherwise(F.col("verdict")).alias("verdict"), "reason", F.when(second, F.col("tolerance")).alias("tolerance"))


def assembled(sections: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, places) of sections (key, ord, heading, text): headings and texts with blank lines between, and where each section begins."""
    piece = F.array_join(F.array_compact(F.array(F.col("heading"), F.nullif(F.col("text"), F.lit("")))), "\n\n")
    rows = sections.withColumn("piece", piece).where("piece <> ''")
    before = F.sum(F.length("piece") + 2).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    places = rows.select(key, "ord", F.coalesce(before, F.lit(0)).cast("int").alias("start"), F.length("piece").alias("length"))
    docs = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"), F.count("*").alias("sections"))
    return docs, places
