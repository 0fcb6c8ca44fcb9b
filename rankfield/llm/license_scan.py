"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Of every ``window`` consecutive word ``gram``-grams of a template the one with the smallest hash is a fingerprint, so a
copied run of gram + window - 1 words holds one. The inverted index leads from a fingerprint to the template
and its place there. All grams of a document are looked up; hits that agree on where the template would begin
are one candidate, which is aligned word by word in a band around that place. Matched words, coverage and span are
reported. Documents are not shuffled; templates are sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.llm.text import ALNUM, Words, grams, slices

GRAM, WINDOW, BAND = 3, 3, 8
BLOCK_WORDS = 1_000_000

# Notices as their licenses word them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template_id string, text string")


@dataclass(frozen=True)
class Index:
    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray  # sorted fingerprints, and of each its template and place
    template: np.ndarray
    place: np.ndarray


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of each window; of the only window, if there are fewer."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


def build_index(rows: list[tuple[str, np.ndarray]], gram: int, window: int) -> Index:
    prints, template, place = [], [], []
    for number, (_, words) in enumerate(rows):
        hashes, _ = grams(words, np.zeros(len(words), np.int64), tuple(range(1, gram)))
        at = winnow(hashes, window)
        prints.append(hashes[at])
        template.append(np.full(len(at), number))
        place.append(at)
    prints, template, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (prints, template, place))
    order = np.argsort(prints, kind="stable")
    return Index([n for n, _ in rows], [w for _, w in rows], prints[order].astype(np.uint64), template[order].astype(np.int64), place[order].astype(np.int64))


def align(template: np.ndarray, words: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, past the last) of the best alignment of a whole template that begins within ``band`` of ``start``.

    A match gives 2, a mismatch or a gap in either text costs 1; words before and after are free.
    """
    offset = np.arange(-band, band + 1)
    low = -1 << 20
    score = np.where((start + offset >= 0) & (start + offset <= len(words)), 0, low)
    first, matched = start + offset, np.zeros(len(offset), np.int64)
    for i in range(len(template)):
        at = start + i + offset
        inside = (at >= 0) & (at < len(words))
        hit = inside & (words[np.clip(at, 0, max(0, len(words) - 1))] == template[i])
        step = np.where(inside, score + np.where(hit, 2, -1), low)
        skip = np.append(score[1:] - 1, low)
        better = skip > step
        new = np.where(better, skip, step)
        new_first = np.where(better, np.append(first[1:], 0), first)
        new_matched = np.where(better, np.append(matched[1:], 0), matched + hit)
        # Gaps in the template: the best cell to the left, one point lower for each word.
        best = np.maximum.accumulate(new + offset)
        origin = np.maximum.accumulate(np.where(new + offset == best, np.arange(len(offset)), 0))
        score, first, matched = best - offset, new_first[origin], new_matched[origin]
    end = int(score.argmax())
    return int(matched[end]), max(0, int(first[end])), min(len(words), start + len(template) + int(offset[end]))


def search(words: Words, index: Index, gram: int, band: int, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(row, template, matched, first, past the last word), without overlaps of one template, best ones first to be kept."""
    if not len(index.prints):
        return []
    hashes = words.hashes()
    found, at = grams(hashes, words.row, tuple(range(1, gram)))
    low, high = np.searchsorted(index.prints, found), np.searchsorted(index.prints, found, "right")
    hit = np.flatnonzero(high > low)
    size = (high - low)[hit]
    entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[hit], size)
    place = np.repeat(at[hit], size)
    row, template = words.row[place], index.template[entry]
    start = place - words.first[row] - index.place[entry]
    order = np.lexsort((start, template, row))
    out, last, since = [], None, 0
    for r, t, s in zip(row[order].tolist(), template[order].tolist(), start[order].tolist(), strict=True):
        if last == (r, t) and s - since <= band:
            continue
        last, since = (r, t), s
        own = hashes[words.first[r] : words.first[r + 1]]
        matched, first, end = align(index.words[t], own, s + band // 2, band)
        if matched >= coverage * len(index.words[t]):
            out.append((r, t, matched, first, end))
    kept: list[tuple[int, int, int, int, int]] = []
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for found_one in sorted(out, key=lambda x: (x[0], x[1], -x[2], x[3])):
        r, t, _, first, end = found_one
        spans = taken.setdefault((r, t), [])
        if all(end <= a or first >= b for a, b in spans):
            spans.append((first, end))
            kept.append(found_one)
    return sorted(kept)


def license_scan(
    docs: DataFrame, templates: DataFrame, *, coverage: float = 0.8, gram: int = GRAM, window: int = WINDOW, band: int = BAND, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per occurrence: doc_id, template_id, matched, coverage, first_word, last_word, first_byte, last_byte.

    Words are lower-cased letters and digits; last_word and last_byte are past the end. An occurrence has at least
    ``coverage`` of a template's words in order, and some fingerprint whole. Templates of fewer than ``gram`` words
    and null texts give no rows; repeated rows are scanned each; a null template_id reads as an empty string.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part["text"], ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([part["name"], pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(words.hashes().view(np.int64)))], ["name", "words"])

    parsed = templates.select(F.coalesce(F.col("template_id").cast("string"), F.lit("")).alias("name"), "text").mapInArrow(parse, "name string, words array<long>").where(F.size("words") >= gram)
    total = parsed.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    texts = docs.select("doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        rows = parsed.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == block).collect()
        index = build_index([(r["name"], np.array(r["words"], np.int64).view(np.uint64)) for r in sorted(rows, key=lambda r: r["name"])], gram, window)
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, sizes = sent.value.names, [len(w) for w in sent.value.words]
            for part in slices(batches, "text"):
                words = Words(part["text"], ALNUM, lower=True)
                rows = search(words, sent.value, gram, band, coverage)
                r, t, matched, first, end = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [()] * 5))
                begin, stop = words.first[r] + first, words.first[r] + end - 1
                columns = [part["doc_id"].take(pa.array(r)), pa.array([names[i] for i in t], pa.string()), pa.array(matched), pa.array(np.array([m / sizes[i] for m, i in zip(matched, t, strict=True)], float))]
                columns += [pa.array(x) for x in (first, end, words.start[begin] - words.offsets[r], words.end[stop] - words.offsets[r])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "template_id", "matched", "coverage", "first_word", "last_word", "first_byte", "last_byte"])

        part = texts.mapInArrow(run, f"doc_id {id_type}, template_id string, matched long, coverage double, first_word long, last_word long, first_byte long, last_byte long")
        found = part if found is None else found.unionByName(part)
    return found
