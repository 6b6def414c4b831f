"""Shortening a text to a number of words by repeated light passes, and what is shortened at all.

A pass is any function of a text, such as a model's; the default keeps all but the last tenth of the sentences. Documents don't depend on
each other, so each is shortened in the task that has it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.segments import sentence_starts
from scriptoria.sources.arrow import flat_mapped

# The band around the target, the most passes, and when passes in a row are too slow to go on.
TOLERANCE, MOST_PASSES, SLOW_SHARE, SLOW_PASSES = 0.10, 99, 0.01, 3


class Shortened(NamedTuple):
    text: str
    words: int
    accepted: int
    refused: int
    why: str  # it stopped: band, refused, slow, passes


def without_the_last_tenth(text: str) -> str:
    starts = sentence_starts(text)
    keep = max(1, len(starts) - -(-len(starts) // 10))
    return text[: starts[keep]] if keep < len(starts) else text


def shortened(text: str, target: int, shorten: Callable[[str], str] = without_the_last_tenth, refusals: int = 1, tolerance: float = TOLERANCE) -> Shortened:
    """Passes go on while the text is above the band. One that doesn't make it shorter is refused and the longer text kept; after `refusals` of them
    in a row, or SLOW_PASSES that each took less than SLOW_SHARE of the words, it ends."""
    if target <= 0:
        raise ValueError("the target must be positive")
    now, accepted, refused, in_a_row, slow, why = text.strip(), 0, 0, 0, 0, "band"
    words = len(now.split())
    while words > target * (1 + tolerance):
        if accepted + refused >= MOST_PASSES:
            why = "passes"
            break
        new = shorten(now).strip()
        left = len(new.split())
        if left >= words:
            refused, in_a_row = refused + 1, in_a_row + 1
            if in_a_row >= refusals:
                why = "refused"
                break
            continue
        slow = slow + 1 if 1 - left / words < SLOW_SHARE else 0
        now, words, accepted, in_a_row = new, left, accepted + 1, 0
        if slow >= SLOW_PASSES:
            why = "slow"
            break
    return Shortened(now, words, accepted, refused, why)


def shortened_texts(docs: DataFrame, target: int, key: str = "doc_id", make: Callable[[], Callable[[str], str]] = lambda: without_the_last_tenth, **limits) -> DataFrame:
    """key, text, words, accepted, refused, why of rows (key, text); a null text is empty."""
    held: list = []

    def rows(k, text):
        if not held:
            held.append(make())
        yield (k, *shortened(text or "", target, held[0], **limits))

    return flat_mapped(docs.select(key, "text"), f"{key} {dict(docs.dtypes)[key]}, text string, words int, accepted int, refused int, why string", rows)


def to_shorten(summary: Column, cores: Column, target: int, tolerance: float = TOLERANCE) -> Column:
    """The text that passes begin with: none for a summary in the band, itself above it, and below it the segments' own texts (cores, array<string> in order)
    with blank lines between, as the summary holds too little."""
    words = T.word_count(summary)
    parts = F.filter(F.coalesce(cores, F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    whole = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))
    return F.when(words > target * (1 + tolerance), summary).when(words < target * (1 - tolerance), whole)
