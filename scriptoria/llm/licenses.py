"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment confirms them.

Templates are grouped by their number of shingles (five words; templates of fewer words have one shingle of all).
A group of length L reads windows of 2 L shingles, L apart, so that each occurrence of a template lies wholly in
one. Where a window contains at least 0.8 of a template's shingles their Jaccard similarity is at least about 0.25;
BANDS bands of one minimum agree at least once with probability 1 - 0.75 ** 48 = 1 - 1e-6. A retrieved template
matches if the window contains at least 0.8 of its different shingles.

Edge cases: null and empty texts have no match; matches of several templates of one license are one row; an empty
template list or table gives no rows. The templates are a parameter of fixed size that every task gets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common
from scriptoria.llm.words import U, Words, grams

K, CONTAINED, BANDS = 5, 0.8, 48
#: Texts that name a license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)


def group_length(n: int) -> int:
    """The least of 1, 2, 3, 4, 6, 9, 13, 19 ... (half more each time) that is no less than n."""
    size = 1
    while size < n:
        size = max(size + 1, size * 3 // 2)
    return size


class Library:
    """Templates by (words of a shingle, L): their shingle sets, and for each band all minima in order with the templates that
    have them, so that a window's minimum is looked up, however many templates there are."""

    def __init__(self, templates, bands: int = BANDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.scale = rng.integers(0, 1 << 63, bands, dtype=U) * U(2) + U(1)
        self.shift = rng.integers(0, 1 << 63, bands, dtype=U)
        self.groups: dict[int, dict[int, list]] = {}
        for name, text in templates:
            words = Words(pa.array([text], pa.string()))
            if not len(words.hashes):
                continue
            k = min(K, len(words.hashes))
            own = np.unique(grams(words.hashes, words.first, k)[0])
            length = group_length(len(words.hashes) - k + 1)
            self.groups.setdefault(k, {}).setdefault(length, []).append((name, own, (own[None, :] * self.scale[:, None] + self.shift[:, None]).min(axis=1)))
        self.minima = {}
        for k, lengths in self.groups.items():
            for length, own in lengths.items():
                every = np.stack([minima for _, _, minima in own], axis=1)  # (bands, templates)
                order = np.argsort(every, axis=1, kind="stable")
                self.minima[k, length] = np.take_along_axis(every, order, 1), order


def scan(words: Words, library: Library) -> dict[tuple[int, str], tuple[float, int, int]]:
    """(row, license) to (highest containment, first word of the first matching window, matching windows)."""
    found: dict = {}
    for k, lengths in library.groups.items():
        h, first = grams(words.hashes, words.first, k)
        if not len(h):
            continue
        n = np.diff(first)
        rows = np.flatnonzero(n)
        layout = {}
        for length in lengths:
            blocks = -(-n[rows] // length)
            begin = np.cumsum(blocks) - blocks
            of = np.repeat(np.arange(len(rows)), blocks)
            number = np.arange(blocks.sum()) - begin[of]
            layout[length] = (first[rows][of] + number * length, of, number, np.flatnonzero((number < blocks[of] - 1) | (blocks[of] == 1)), blocks)
        asked: dict[int, list] = {length: [] for length in lengths}  # window * templates + template
        for b in range(len(library.scale)):
            v = h * library.scale[b]
            v += library.shift[b]
            for length, own in lengths.items():
                at, of, _, windows, _ = layout[length]
                least = v if length == 1 else np.minimum.reduceat(v, at)
                both = least[:-1].copy()
                np.minimum(both, least[1:], out=both)
                both = np.r_[both, least[-1:]]
                single = windows[layout[length][4][of[windows]] == 1] if length > 1 or (n[rows] == 1).any() else windows[:0]
                both[single] = least[single]
                minima, order = library.minima[k, length]
                lo = np.searchsorted(minima[b], both, "left")
                hit = np.flatnonzero(minima[b][np.minimum(lo, len(own) - 1)] == both)
                if len(hit):
                    n_equal = np.searchsorted(minima[b], both[hit], "right") - lo[hit]
                    place = np.repeat(lo[hit], n_equal) + np.arange(n_equal.sum()) - np.repeat(np.cumsum(n_equal) - n_equal, n_equal)
                    asked[length].append(np.repeat(hit, n_equal) * len(own) + order[b][place])
        for length, hit in asked.items():
            if not hit:
                continue
            at, of, number, windows, _ = layout[length]
            many, whole = len(lengths[length]), set(windows.tolist())
            for w, t in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(hit)), many)), strict=True):
                if w not in whole:
                    continue
                name, own, _ = lengths[length][t]
                row = int(rows[of[w]])
                window = np.unique(h[at[w] : min(at[w] + 2 * length, first[row + 1])])
                share = len(np.intersect1d(window, own, assume_unique=True)) / len(own)
                if share >= CONTAINED:
                    best, start, count = found.get((row, name), (0.0, 1 << 62, 0))
                    found[row, name] = (max(best, share), min(start, int(number[w]) * length), count + 1)
    return found


def license_matches(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id") -> DataFrame:
    """A row per document and license found: key, license, containment, first_word, windows."""

    def work(batch):
        found = scan(Words(batch.column("text")), _library(templates))
        if not found:
            return None
        order = sorted(found)
        got = [found[x] for x in order]
        return {"key": batch.column("key").take(pa.array([r for r, _ in order])), "license": [x for _, x in order], "containment": [x[0] for x in got], "first_word": [x[1] for x in got], "windows": [x[2] for x in got]}

    kind = dict(docs.dtypes)[key]
    named = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(named, f"key {kind}, license string, containment double, first_word long, windows long", work).withColumnRenamed("key", key)


_LIBRARIES: dict = {}


def _library(templates) -> Library:
    if templates not in _LIBRARIES:
        _LIBRARIES[templates] = Library(templates)
    return _LIBRARIES[templates]


def query(spark, sf_dir: str) -> DataFrame:
    return license_matches(common.table(spark, sf_dir, "documents"))


def oracle(templates=TEMPLATES) -> str:
    """Containment in every window of every template, without retrieval."""
    rows = []
    for t, (name, text) in enumerate(templates):
        n = len(Words(pa.array([text])).hashes)
        k = min(K, n)
        rows.append(f"({t}, '{name}', '{text.replace(chr(39), chr(39) * 2)}', {k}, {group_length(n - k + 1)})")
    words = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format
    return f"""
WITH t(id, license, text, k, size) AS (VALUES {", ".join(rows)}),
tw AS (SELECT id, license, k, size, {words("text")} AS w FROM t),
ts AS (SELECT DISTINCT id, license, k, size, array_to_string(w[i : i + k - 1], ' ') AS gram FROM tw, unnest(range(1, len(w) - k + 2)) AS x(i)),
tn AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
dw AS (SELECT doc_id, row_number() OVER () AS d, {words("text")} AS w FROM documents),
dg AS (SELECT doc_id, d, k, i - 1 AS p, len(w) - k + 1 AS grams, array_to_string(w[i : i + k - 1], ' ') AS gram
       FROM dw, (SELECT DISTINCT k FROM ts) s, unnest(range(1, len(w) - k + 2)) AS x(i) WHERE len(w) >= k),
m AS (SELECT doc_id, d, ts.id, license, size, p, grams, dg.gram FROM dg JOIN ts ON dg.k = ts.k AND dg.gram = ts.gram),
mw AS (SELECT doc_id, d, id, license, size, gram, p // size - o AS j FROM m, (VALUES (0), (1)) AS y(o)
       WHERE p // size - o >= 0 AND p // size - o <= greatest((grams + size - 1) // size - 2, 0)),
c AS (SELECT doc_id, d, mw.id, license, size, j, count(DISTINCT gram) AS shared FROM mw GROUP BY ALL)
SELECT doc_id, license, max(CAST(shared AS DOUBLE) / n) AS containment, CAST(min(j * size) AS BIGINT) AS first_word, count(*) AS windows
FROM c JOIN tn ON c.id = tn.id WHERE CAST(shared AS DOUBLE) / n >= 0.8 GROUP BY d, doc_id, license
"""
