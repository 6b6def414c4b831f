"""Budgets, estimates, times, response categories and numbers in prose, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a sentence and claims of one, for estimates; the window of an unknown model.
SENTENCE_WORDS, CLAIMS_PER_SENTENCE, ASSUMED_WINDOW = 20, 2.5, 8192
#: Number words.
UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
APPROXIMATE = ("nearly", "almost", "about", "around", "approximately", "roughly", "over", "under", "some")


def margin(window: Column, floor: int, share: float) -> Column:
    return F.greatest(F.lit(floor).cast("long"), F.floor(window * share).cast("long"))


def request_budget(window: Column, *, output: Column, overhead: Column, evidence: Column, headroom: Column, margin_floor: int, margin_share: float) -> Column:
    """struct(margin, usable, capacity)."""
    m = margin(window, margin_floor, margin_share)
    return F.struct(m.alias("margin"), (window - m).alias("usable"), (window - m - output - overhead - evidence - headroom).alias("capacity"))


def budget_failure(budget: Column, output: Column, wanted: Column, largest_child: Column) -> Column:
    """Why a request can't be sent; null if it can."""
    return (
        F.when(budget["usable"] <= 0, "no_input_capacity").when(output >= budget["usable"], "output_exceeds_context").when(budget["capacity"] <= 0, "no_input_capacity")
        .when(wanted > budget["capacity"], "input_exceeds_capacity").when(2 * largest_child > budget["capacity"], "merge_pair_exceeds_capacity")
    )


def editorial_allowance(words: Column, most: Column) -> Column:
    return F.greatest(most.cast("long"), 3 * words + 1024)


def context_windows(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (model) with tokens of the longest prefix in known (prefix, tokens), and whether it is assumed.

    The equi-join is on prefixes of the lengths that known has, so that it stays one for any number of models."""
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    tries = F.array_compact(F.array(*[F.when(F.length("model") >= n, F.substring("model", 1, n)) for n in lengths]))
    models = asked.select("model").distinct()
    best = models.withColumn("prefix", F.explode(tries)).join(known, "prefix").groupBy("model").agg(F.max_by("tokens", F.length("prefix")).alias("found"))
    return asked.join(best, "model", "left").withColumn("tokens", F.coalesce("found", F.lit(ASSUMED_WINDOW))).withColumn("assumed", F.col("found").isNull()).drop("found")


def verification_calls(words: Column) -> Column:
    return (1 + F.ceil(CLAIMS_PER_SENTENCE * F.greatest(F.lit(1), words) / SENTENCE_WORDS)).cast("long")


def words_to_keep(words: Column, share: float = 0.7) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(words * share).cast("long"))


def word_band(words: Column, target: Column, slack: float = 0.1) -> Column:
    low, high = F.ceil(target * (1 - slack)), F.floor(target * (1 + slack) + 1e-9)
    return F.when(words < low, "under").when(words > high, "above").otherwise("inside")


def elapsed(start: Column, end: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 1e6), 1)


def duration(start: Column, end: Column) -> Column:
    s = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return F.when(s >= 0, F.bround(s, 3))


def error_category(code: Column) -> Column:
    return (
        F.when(code.isin(401, 403), "authentication").when(code == 402, "quota").when(code == 404, "model_not_found").when(code.isin(408, 504), "timeout")
        .when(code == 429, "rate_limited").when(code >= 500, "unavailable").when(code >= 400, "invalid_request").otherwise("none")
    )


def transient(code: Column) -> Column:
    return code.isin(408, 429, 504) | (code >= 500)


def eta(remaining: Column, completed: Column, seconds: Column, least: int = 3) -> Column:
    """Seconds left at the pace so far; null before `least` calls."""
    return F.when((completed >= least) & (seconds > 0), F.when(remaining == 0, F.lit(0.0)).otherwise(F.bround(remaining * seconds / completed, 1)))


def number_values(text: Column) -> Column:
    """array<double>: numerals with thousands separators, number words and hyphenated tens."""
    numerals = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").cast("double"))
    values = {w: float(i) for i, w in enumerate(UNITS)} | {w: float(v) for w, v in TENS.items()}
    values |= {f"{t}-{UNITS[i]}": float(v + i) for t, v in TENS.items() for i in range(10)}
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z]+(?:-[A-Za-z]+)?)"), F.lit(1))
    return F.concat(numerals, F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull()))


def is_approximate(text: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+(?:-[a-z]+)?)"), F.lit(1)), F.array(*map(F.lit, APPROXIMATE)))


def numbers_close(claim: Column, evidence: Column) -> Column:
    """Each of the claim's numbers is in the evidence, or within a tenth of one where the claim says it is approximate."""
    mine, theirs, rough = number_values(claim), number_values(evidence), is_approximate(claim)
    close = F.forall(mine, lambda x: F.exists(theirs, lambda y: (x == y) | (rough & (F.abs(x - y) <= 0.1 * F.greatest(F.abs(y), F.lit(1.0))))))
    return (F.size(mine) > 0) & (F.size(theirs) > 0) & close


def retry_delays(attempts: int, base: float, cap: float) -> Column:
    """Upper bounds of the waits before each further attempt."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), i)))
