"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import skewed_join, small_batches, term_counts, text_slices, written

#: Short notices, file headers and headings of licence texts by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0 Universal."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
)
WORD = r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*"
#: Fixed value: names of files that state the licence of their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-].*)?$"


@dataclass(frozen=True)
class LicenceSettings:
    threshold: float = 0.75


def _terms(texts: pa.Array) -> list[list[str]]:
    find = re.compile(WORD).findall
    return [find(t) for t in pc.utf8_lower(texts).to_pylist()]


TERMS = sorted({w for _, text in TEMPLATES for w in _terms(pa.array([text]))[0]})


def notice_pieces(hits: list[int], n: int, reach: int, most: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of n words that hold every run of up to `reach` words with a hit (ascending places of words).

    Near hits share a range; ranges over `most` words are cut with reach - 1 words in common, so that no run is lost.
    """
    spans: list[list[int]] = []
    for at in hits:
        lo, hi = max(at - reach + 1, 0), min(at + reach, n)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        for a in range(lo, max(hi - reach + 1, lo + 1), most - reach + 1):
            yield a, min(a + most, hi)


def term_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows with each template term as a word, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(TERMS, pa.string())
        sums, total = np.zeros(len(TERMS), np.int64), 0
        for _, texts in text_slices(batches, text_col):
            sums += np.bincount(term_counts(texts, known)[1], minlength=len(TERMS))
            total += len(texts)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(sums[some], total), pa.int64())], ["term", "n"])

    counts = {r[0]: r[1] for r in small_batches(docs.select(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most a row per template term
    return counts.get(-1, 0), {w: counts.get(i, 0) for i, w in enumerate(TERMS)}


class Matcher:
    """Cosine of sparse TF-IDF vectors to the templates; words of no template count in a length with the largest weight.

    A template's anchors are its heaviest terms, so many that its other terms together are shorter than the
    threshold: a text without any anchor can't reach it, whatever else it holds.
    """

    def __init__(self, n_texts: int, frequencies: dict[str, int], threshold: float = LicenceSettings.threshold):
        self.threshold = threshold
        self.idf = {w: float(np.log((1 + n_texts + len(TEMPLATES)) / (1 + frequencies[w])) + 1) for w in TERMS}
        self.other = float(np.log(1 + n_texts + len(TEMPLATES)) + 1)
        words = _terms(pa.array([t for _, t in TEMPLATES]))
        self.lengths = np.array([len(w) for w in words])
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.anchors: set[str] = set()
        for at, own in enumerate(words):
            weights, norm = self.vector(own)
            left = 1.0
            for w, x in sorted(weights.items(), key=lambda p: (-p[1], p[0])):
                self.postings.setdefault(w, []).append((at, x / norm))
                if left >= threshold**2 - 1e-9:
                    self.anchors.add(w)
                    left -= (x / norm) ** 2

    def anchor_pattern(self) -> str:
        """An RE2 pattern that every lower-case text with an anchor among its words matches."""
        letters, digits = ("|".join(sorted(re.escape(w) for w in self.anchors if w[0].isalpha() == kind)) for kind in (True, False))
        return "|".join(f"(?:^|[^{edge}])(?:{words})(?:[^{edge}]|$)" for words, edge in ((letters, "a-z"), (digits, "0-9")) if words)

    def vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        """Weights of the words, and the length of the vector."""
        out = {w: (1 + float(np.log(n))) * self.idf.get(w, self.other) for w, n in Counter(words).items()}
        return out, float(np.sqrt(sum(x * x for x in out.values())))

    def best(self, words: list[str]) -> tuple[str | None, float]:
        """The identifier of the most similar template (ties: the first) and the cosine."""
        weights, norm = self.vector(words)
        sums = np.zeros(len(TEMPLATES))
        for w, x in weights.items():
            for at, y in self.postings.get(w, ()):
                sums[at] += x * y
        if not sums.any():
            return None, 0.0
        at = int(np.argmax(sums))
        return TEMPLATES[at][0], min(float(sums[at] / norm), 1.0)

    def best_window(self, words: list[str]) -> tuple[str | None, float, int]:
        """The identifier, cosine and first word of the window most similar to the template of as many words.

        A piece shorter than a template is one window. Ties go to the first word, then the first template;
        without a cosine at or over the threshold there is none (null, 0, 0).
        """
        own = {w: i for i, w in enumerate(dict.fromkeys(words))}
        local = np.zeros((len(TEMPLATES), len(own)))
        for w, i in own.items():
            for at, x in self.postings.get(w, ()):
                local[at, i] = x
        # no window can come nearer to a template than the part of it whose terms the piece holds
        able = np.flatnonzero((local**2).sum(axis=1) >= self.threshold**2 - 1e-9)
        out: tuple[str | None, float, int] = (None, 0.0, 0)
        if not len(able):
            return out
        idf = np.array([self.idf.get(w, self.other) for w in own])
        sums = np.zeros((len(words) + 1, len(own)))
        sums[np.arange(1, len(words) + 1), [own[w] for w in words]] = 1
        sums = sums.cumsum(axis=0)
        tops = []
        lengths = np.minimum(self.lengths[able], len(words))
        for n in np.unique(lengths).tolist():
            some = able[lengths == n]
            counts = sums[n:] - sums[:-n]
            weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
            cosines = weights @ local[some].T / np.linalg.norm(weights, axis=1)[:, None]
            edge = cosines.max()
            start, which = (int(x[0]) for x in np.nonzero(cosines >= edge - 1e-9))
            tops.append((float(edge), start, int(some[which])))
        edge = max(t[0] for t in tops)
        if edge < self.threshold:
            return out
        cosine, start, at = min((t for t in tops if t[0] >= edge - 1e-9), key=lambda t: t[1:])
        return TEMPLATES[at][0], min(cosine, 1.0), start

    def scan(self, text: str) -> tuple[str | None, float | None, int | None]:
        """Identifier, cosine and line of the best candidate of a lower-case text: its lines and its windows of template length."""
        found = list(re.finditer(WORD, text))
        words = [m[0] for m in found]
        hits = [i for i, w in enumerate(words) if w in self.anchors]
        if not hits:
            return None, None, None
        breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
        line_of = np.searchsorted(breaks, [m.start() for m in found])
        candidates = []
        for line in np.unique(line_of[hits]).tolist():
            a, b = np.searchsorted(line_of, [line, line + 1])
            name, cosine = self.best(words[a:b])
            if cosine >= self.threshold:
                candidates.append((name, cosine, line))
        for a, b in notice_pieces(hits, len(words), int(self.lengths.max())):
            name, cosine, start = self.best_window(words[a:b])
            if name is not None:
                candidates.append((name, cosine, int(line_of[a + start])))
        best: tuple = (None, None, None)
        for name, cosine, line in candidates:
            if best[1] is None or cosine > best[1] + 1e-9 or (cosine >= best[1] - 1e-9 and line < best[2]):
                best = (name, cosine, line)
        return best


def scan_licences(docs: DataFrame, text_col: str = "text", settings: LicenceSettings = LicenceSettings()) -> DataFrame:  # noqa: B008
    """`docs` with own_licence, own_cosine, own_line (of the most similar notice at or over the threshold; null without one).

    Candidates of the whole text are its lines, and its windows of as many words as a template, which may
    start and end anywhere, so that wrapped notices, comment blocks and licence files are found; own_line
    is that of the first word. Only candidates with an anchor of a template are compared, as no other can
    reach the threshold. The earliest of equally similar candidates counts. Null, empty and wordless texts
    have none; repeated rows are scanned alike. Columns of these names are replaced; rows are kept one for
    one, and an empty table gives none.
    """
    n_texts, frequencies = term_frequencies(docs, text_col)
    added = [T.StructField("own_licence", T.StringType()), T.StructField("own_cosine", T.DoubleType()), T.StructField("own_line", T.LongType())]
    kept = [f for f in docs.schema if f.name not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(n_texts, frequencies, settings.threshold)
        pattern = matcher.anchor_pattern()
        for batch, texts in text_slices(batches, text_col):
            found: list = [(None, None, None)] * len(texts)
            lower = pc.utf8_lower(texts)
            for row in np.flatnonzero(pc.match_substring_regex(lower, pattern).to_numpy(zero_copy_only=False)).tolist():
                found[row] = matcher.scan(lower[row].as_py())
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], schema.names)

    return small_batches(docs.select([f.name for f in kept])).mapInArrow(run, schema)


def inherit_licences(scanned: DataFrame, path_col: str = "path") -> DataFrame:
    """`scanned` with licence, licence_from ("header", "inherited" or null) and licence_directory; read more than once.

    A file's own notice comes first. Otherwise the file gets the licence of the nearest directory above
    it, its own directory first, that holds a file named like LICENCE_FILE with a notice (of several,
    that with the larger cosine, then the smaller path and identifier). Directories are joined, not
    files; a directory of many files is one row, and a hot one is broadcast to its files. Null paths are
    files of the top directory; repeated rows are kept; columns of the three names are replaced.
    """
    scanned = scanned.drop("licence", "licence_from", "licence_directory")
    path = F.coalesce(F.col(path_col), F.lit(""))
    placed = scanned.withColumn("__vs_dir", F.regexp_replace(path, r"/?[^/]*$", ""))
    stated = placed.filter(F.col("own_licence").isNotNull() & F.regexp_like(F.regexp_extract(path, r"[^/]*$", 0), F.lit(LICENCE_FILE)))
    best = F.min(F.struct(-F.col("own_cosine"), path.alias("p"), F.col("own_licence").alias("l"))).alias("top")
    homes = stated.groupBy(F.col("__vs_dir").alias("home")).agg(best).select("home", F.col("top.l").alias("l"))
    dirs = placed.groupBy("__vs_dir").agg(F.count(F.lit(1)).alias("__vs_n"))
    parts = F.split("__vs_dir", "/")
    above = dirs.select("__vs_dir", "__vs_n", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.withColumn("home", F.array_join(F.slice(F.split("__vs_dir", "/"), F.lit(1), F.col("depth")), "/"))
    above = written(above, "licence-above")  # a directory near the top stands above many others
    sized = written(homes.join(above.groupBy("home").agg(F.count(F.lit(1)).alias("n")), "home"), "licence-homes")
    nearest = skewed_join(above, sized, ["home"], "n").drop("n").groupBy("__vs_dir").agg(F.max("__vs_n").alias("__vs_n"), F.max(F.struct("depth", "l", "home")).alias("__vs_near"))
    out = skewed_join(placed, written(nearest, "licence-directories"), ["__vs_dir"], "__vs_n", "left")
    own, near = F.col("own_licence").isNotNull(), F.col("__vs_near")
    return out.withColumns({
        "licence": F.when(own, F.col("own_licence")).otherwise(near["l"]),
        "licence_from": F.when(own, F.lit("header")).when(near.isNotNull(), F.lit("inherited")),
        "licence_directory": F.when(~own, near["home"]),
    }).drop("__vs_dir", "__vs_near", "__vs_n")
