"""Model calls as a stage: any provider behind one protocol, with bounded retries and re-asks inside the task.

The default provider is extractive and deterministic. Each partition is independent, so a lost executor repeats only
its own calls; what a cache already holds is joined away before."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.sources.arrow import flat_mapped

TRANSIENT = ("timeout", "rate_limited", "unavailable")


class Answer(NamedTuple):
    text: str
    tokens: int = 0


class ProviderError(Exception):
    def __init__(self, category: str, message: str = ""):
        super().__init__(message or category)
        self.category = category


class Provider(Protocol):
    def generate(self, instructions: str, text: str) -> Answer: ...


class Extractive:
    """The `keep` sentences with most distinct words, as the JSON record of a leaf; each is its own evidence."""

    def __init__(self, keep: int = 3):
        self.keep = keep

    def generate(self, instructions: str, text: str) -> Answer:
        from scriptoria.operators.segments import sentence_starts

        starts = sentence_starts(text)
        parts = [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        ranked = sorted(range(len(parts)), key=lambda i: (-len(set(re.findall(r"\w+", parts[i].lower()))), i))[: self.keep]
        chosen = [parts[i] for i in sorted(ranked) if parts[i]]
        return Answer(json.dumps({"summary": " ".join(chosen), "quotes": chosen}, ensure_ascii=False), len(text.encode()))


def called(provider: Provider, instructions: str, text: str, check: Callable[[str], str | None], attempts: int = 3, asks: int = 2, base: float = 0.5, cap: float = 30.0) -> tuple:
    """(answer, tokens, calls, asks, reason): transient errors are tried again after growing waits; an answer that `check` refuses is asked for again with its reason."""
    calls, note, reason, tokens = 0, "", None, 0
    for ask in range(asks + 1):
        for attempt in range(attempts):
            calls += 1
            try:
                answer = provider.generate(instructions + note, text)
                break
            except ProviderError as e:
                if e.category not in TRANSIENT or attempt == attempts - 1:
                    return None, tokens, calls, ask, e.category
                time.sleep(min(cap, base * 2**attempt))
        tokens += answer.tokens
        reason = check(answer.text)
        if reason is None:
            return answer.text, tokens, calls, ask, None
        note = f"\nYour last answer was refused: {reason[:400]}"
    return None, tokens, calls, asks, reason


def settled(items: list, most: int, ask: Callable[[list, str], tuple[dict, dict, dict]]) -> dict:
    """item: (value, asks, size of the group that settled it, how): every item is asked for in groups of `most`, then those that are missing in groups of half
    the largest first one, then alone, so no more than three times.

    ask(group, note) gives (accepted, lenient, refused) by item; an item in none of them was left out. A note names the rules that
    the group's earlier answers broke. After its last ask an item takes its lenient value if it has one; how is "accepted",
    "lenient", "omitted" or "refused"."""
    out: dict = {}
    lenient, reasons, asks, missing, size = {}, {}, dict.fromkeys(items, 0), list(items), most
    largest = min(most, len(items))
    for size in dict.fromkeys((most, max(1, -(-largest // 2)), 1)):
        for at in range(0, len(missing), size):
            group = missing[at : at + size]
            note = "; ".join(sorted({reasons[i] for i in group if i in reasons}))
            accepted, maybe, refused = ask(group, note)
            for i in group:
                asks[i] += 1
                if i in accepted:
                    out[i] = (accepted[i], asks[i], len(group), "accepted")
                    continue
                if i in maybe:
                    lenient[i] = (maybe[i], len(group))
                reasons[i] = refused.get(i, "omitted")
        missing = [i for i in missing if i not in out]
    for i in missing:
        value, own = lenient.get(i, (None, 1))
        out[i] = (value, asks[i], own, "lenient" if i in lenient else "omitted" if reasons[i] == "omitted" else "refused")
    return out


def settled_items(work: DataFrame, key: str, most: int, ask: Callable[[list, str], tuple[dict, dict, dict]]) -> DataFrame:
    """key, item, value, asks, group_size, how of rows (key, items array<long>): settled() for each row, in the task that has it."""

    def rows(k, items):
        for item, (value, asks, own, how) in settled(list(items or ()), most, ask).items():
            yield (k, item, value, asks, own, how)

    return flat_mapped(work.select(key, "items"), f"{key} {dict(work.dtypes)[key]}, item long, value string, asks int, group_size int, how string", rows)


def is_object(text: str) -> str | None:
    from scriptoria.functions.records import the_object

    return the_object(text)[1]


def generated(requests: DataFrame, key: str, make: Callable[[], Provider] = Extractive, instructions: str = "", check: Callable[[str], str | None] = is_object, **limits) -> DataFrame:
    """key, answer, tokens, calls, asks, reason of rows (key, text)."""
    held: list = []

    def rows(k, text):
        if not held:
            held.append(make())
        yield (k, *called(held[0], instructions, text or "", check, **limits))

    return flat_mapped(requests.select(key, "text"), f"{key} {dict(requests.dtypes)[key]}, answer string, tokens long, calls int, asks int, reason string", rows)


def cache_key(*identity) -> F.Column:
    """Digest of the identity columns' canonical JSON."""
    return F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)


def resolved(requests: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers of all requests, what is new to the cache): known answers are joined, only the rest is computed, once per cache key."""
    missing = requests.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    fresh = compute(missing.select(F.col("cache_key"), "text")).select("cache_key", "answer")
    return requests.select(key, "cache_key").join(cache.select("cache_key", "answer").unionByName(fresh), "cache_key", "left"), fresh


def first_writer(entries: DataFrame, order: str) -> DataFrame:
    """Content-addressed entries: the first of each key stays."""
    rest = [c for c in entries.columns if c != "cache_key"]
    return entries.groupBy("cache_key").agg(F.min_by(F.struct(*rest), order).alias("e")).select("cache_key", "e.*")
