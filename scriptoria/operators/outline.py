"""Outline titles placed in a document's text: each after the one before, as a whole line, at a line's begin, anywhere,
then in compatibility forms, then as a line with its blanks lost. A document's titles depend on one another, so they are
placed in one Arrow pass."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from scriptoria.sources.arrow import flat_mapped


class Folded:
    """A text in compatibility form, with the source offset of each of its characters."""

    def __init__(self, text: str):
        parts, self.origin = [], []
        for i, c in enumerate(text):
            form = c if c.isascii() else unicodedata.normalize("NFKC", c)
            parts.append(form)
            self.origin += [i] * len(form)
        self.text = "".join(parts)
        self.origin.append(len(text))

    def search(self, pattern: re.Pattern, start: int, end: int) -> tuple[int, int] | None:
        """Source range of the first match within a source range; one that cuts a character in two is passed over."""
        at, stop = bisect_right(self.origin, start - 1), bisect_right(self.origin, end - 1)
        for m in pattern.finditer(self.text, at, stop):
            a, b = m.span(1)
            if (a == 0 or self.origin[a] != self.origin[a - 1]) and (b == len(self.text) or self.origin[b] != self.origin[b - 1]):
                return self.origin[a], self.origin[b]
        return None


def folded(text: str) -> str:
    return "".join(c if c.isascii() else unicodedata.normalize("NFKC", c) for c in text)


def _patterns(title: str) -> list[re.Pattern]:
    body = r"(?<!\w)" + r"\s+".join(map(re.escape, title.split())) + r"(?!\w)"
    return [re.compile(p, re.I | re.M) for p in (rf"^[ \t]*({body})[ \t]*$", rf"^[ \t]*({body})", f"({body})")]


def place(text: str, hints: list[tuple], pages: list[tuple] = ()) -> tuple[list[tuple], int]:
    """([(start, end, title, level, first page, last page)], titles not found); hints: (title, level, page or None); pages: (page, start, end, blank)."""
    shown = [p for p in pages if not p[3]]
    by_page, form = {p[0]: p for p in shown}, None
    found: dict[int, tuple[str, int]] = {}
    cursor = missed = 0
    for title, level, page in hints:
        windows = [(cursor, len(text))]
        if page is not None:
            windows = [(max(cursor, by_page[page][1]), by_page[page][2]), by_page[page][1:3]] if page in by_page else []
        hit = None
        if title.split():
            for a, b in windows:
                for plain, same in zip(_patterns(title), _patterns(folded(title)), strict=True):
                    m = plain.search(text, a, b)
                    hit = m.span(1) if m else None
                    if hit is None and not (text.isascii() and title.isascii()):
                        form = form or Folded(text)
                        hit = form.search(same, a, b)
                    if hit:
                        break
                if hit:
                    break
            if hit is None:
                spaced = re.compile(r"^[ \t]*(" + r"[ \t]*".join(map(re.escape, folded("".join(title.split())))) + r")[ \t]*$", re.I | re.M)
                form = form or Folded(text)
                hit = next((h for a, b in windows if (h := form.search(spaced, a, b))), None)
        if hit is None or hit[0] in found:
            missed += 1
            continue
        found[hit[0]] = (" ".join(text[hit[0] : hit[1]].split()), level)
        cursor = max(cursor, hit[1])
    starts, first = sorted(found), [p[1] for p in shown]

    def page_at(offset: int) -> int | None:
        return shown[max(0, bisect_right(first, offset) - 1)][0] if shown else None

    out = []
    for i, s in enumerate(starts):
        end = next((t for t in starts[i + 1 :] if found[t][1] <= found[s][1]), len(text))
        out.append((s, end, *found[s], page_at(s), page_at(end - 1)))
    return out, missed


def anchored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, title, level, page_start, page_end of documents (key, text, hints array<struct<title,level,page>>, pages array<struct<page,start,end,blank>>)."""

    def rows(k, text, hints, pages) -> Iterator[tuple]:
        for row in place(text or "", [(h["title"], h["level"], h["page"]) for h in hints or ()], [(p["page"], p["start"], p["end"], p["blank"]) for p in pages or ()])[0]:
            yield (k, *row)

    return flat_mapped(docs.select(key, "text", "hints", "pages"), f"{key} {dict(docs.dtypes)[key]}, start int, end int, title string, level int, page_start int, page_end int", rows)
