"""Token counters: the default in bytes, and byte-pair vocabularies from files, behind one protocol.

A counter that isn't monotone (a longer text can have fewer tokens) only promises what was counted: a prefix found by
bisection is counted again, and some characters around it are tried."""

from __future__ import annotations

import base64
from typing import Protocol

from pyspark.sql import DataFrame

from scriptoria.sources.arrow import flat_mapped

#: Characters around a bisected end that are tried for counters that aren't monotone.
TAIL = 16


class Counter(Protocol):
    identity: str
    exact: bool
    monotonic: bool

    def count(self, text: str) -> int: ...


class Utf8:
    """A bound from above for byte-level vocabularies: one token a byte."""

    identity, exact, monotonic = "estimate:utf8-bytes", False, True

    def count(self, text: str) -> int:
        return len(text.encode("utf-8", "surrogatepass"))


class Ranks:
    """A vocabulary file of base64 tokens and their ranks."""

    exact, monotonic = True, False

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.identity = f"ranks:{path.rsplit('/', 1)[-1]}"
        self._code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self._code.encode_ordinary(text))


class TokenizerFile:
    """A tokenizer.json file."""

    exact, monotonic = True, False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.identity = f"tokenizer:{path.rsplit('/', 1)[-1]}"
        self._code = Tokenizer.from_file(path)
        self._code.encode_special_tokens = True

    def count(self, text: str) -> int:
        return len(self._code.encode(text, add_special_tokens=False).ids)


def resolved(name: str = "utf8", path: str | None = None, pattern: str | None = None) -> Counter:
    """The counter that a run names; an unknown name is an error."""
    if name == "utf8":
        return Utf8()
    if name == "ranks" and path and pattern:
        return Ranks(path, pattern)
    if name == "tokenizer" and path:
        return TokenizerFile(path)
    raise ValueError(f"no token counter {name!r}")


def fitting_prefix(counter: Counter, text: str, start: int, end: int, most: int) -> int:
    """The end of the longest prefix of text[start:end] found within `most` tokens; start if not even one character fits."""
    lo, hi = start, end
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if counter.count(text[start:mid]) <= most else (lo, mid - 1)
    if counter.monotonic:
        return lo
    for at in range(min(end, lo + TAIL), start, -1):
        if counter.count(text[start:at]) <= most:
            return at
    return start


def fitting_suffix(counter: Counter, text: str, start: int, end: int, most: int) -> int:
    """The begin of the longest suffix of text[start:end] found within `most` tokens; end if none fits."""
    lo, hi = start, end
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if counter.count(text[mid:end]) <= most else (mid + 1, hi)
    if counter.monotonic:
        return lo
    for at in range(max(start, lo - TAIL), end):
        if counter.count(text[at:end]) <= most:
            return at
    return end


def counted(df: DataFrame, key: str, column: str, name: str = "utf8", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, tokens of each text; null has none. The counter is opened once in each task."""
    held: list = []

    def rows(k, text):
        if not held:
            held.append(resolved(name, path, pattern))
        yield (k, held[0].count(text or ""))

    return flat_mapped(df.select(key, column), f"{key} {dict(df.dtypes)[key]}, tokens long", rows)
