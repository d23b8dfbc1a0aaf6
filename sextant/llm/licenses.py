"""License scans (operator 8): MinHash bands over overlapping text windows, then exact containment.

Templates of m shingles are held by size class: in class w (a power of two), windows of 2w
shingles start every w shingles, so a template of at most w shingles lies whole in one window.
That window then has at most 2w distinct shingles and m > w / 2 of them are the template's, so
the similarity of window and template is above 1/4. Bands have one row each, and ``SAMPLES``
bands miss a pair of similarity 1/4 with probability 0.75**64, about 1e-8; a template of which
only ``CONTAINMENT`` is there is missed with less than 1e-6. Windows that hold fewer shingles of
templates than that share of the class's smallest one can't be verified, and aren't hashed.

A retrieved template is verified by exact containment: the share of its distinct word shingles
in its window. Each place is a row: from the window's shingles of the template, left to right,
as many words as the template has (a quarter more where some were put in) that hold the share.
Templates shorter than five words are one shingle of their words.

Templates are a table (name, text), by default the notices ``TEMPLATES`` and the full texts in
``licence_texts`` (named "<licence> text"); tasks read it in shards of ``TEMPLATE_BYTES`` from the
shared folder, and texts are read once for each shard. Licences that share most of their words, as
versions of one do, are each reported with their containment.

Edge cases: null and empty texts and texts without words hold no license. Case is ignored for
A-Z. Templates without words or with null text are never found; equal templates are each reported.
Rows are judged alone, so repeated rows give repeated results; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import Words, held, sizes, slices, table, utf8, windows, write_shards

WORDS = 5
SAMPLES = 64
CONTAINMENT = 0.8
#: Bytes of the templates that a task holds at once.
TEMPLATE_BYTES = 16 << 20

# Notices as their licences or common use word them.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("mit-line", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def full_texts() -> list[tuple[str, str]]:
    """(name, text) of each file in ``licence_texts``."""
    files = sorted((f for f in (resources.files(__package__) / "licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f"{f.name.removesuffix('.txt')} text", f.read_text(encoding="utf-8")) for f in files]


_rng = np.random.default_rng(23)
_A = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The SAMPLES minima of some shingles, in steps of bounded memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(best, (_A[:, None] * low[None, k : k + 4096] + _B[:, None]).min(axis=1), out=best)
    return best


class Templates:
    """MinHash bands of templates (name, text), by size class."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.sets, self.words, self.length = [], [], [], []
        at, data = utf8(pa.array([t for _, t in templates], pa.string()))
        words = Words(at, data)
        by_class: dict[tuple[int, int], list[int]] = {}
        for k, (name, _) in enumerate(templates):
            own = words.hash[words.first[k] : words.first[k + 1]]
            if len(own):
                n = min(WORDS, len(own))
                shingles = np.unique(windows(own, n))
                by_class.setdefault((n, max(0, int(np.ceil(np.log2(len(shingles)))))), []).append(len(self.names))
                self.names.append(name), self.sets.append(shingles), self.words.append(n), self.length.append(len(own) - n + 1)
        #: By words in a shingle: all their shingles, a gate by low bits, and of each class (w, members, their minima).
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, list[tuple]]] = {}
        for n in sorted({n for n, _ in by_class}):
            of_n = [(c, members) for (m, c), members in sorted(by_class.items()) if m == n]
            every = np.unique(np.concatenate([self.sets[m] for _, members in of_n for m in members]))
            gate = np.zeros(1 << 20, bool)
            gate[every & np.uint64(0xFFFFF)] = True
            self.classes[n] = (every, gate, [(1 << c, np.array(members), np.array([_minima(self.sets[m]) for m in members])) for c, members in of_n])

    def scan(self, words: Words) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first word, word after the last) of each place of each template."""
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        n_words = np.diff(words.first)
        of_text = np.repeat(np.arange(len(n_words)), n_words)
        for n, (every, gate, classes) in self.classes.items():
            shingles = windows(words.hash, n)
            place = np.flatnonzero(of_text[: len(shingles)] == of_text[n - 1 :])
            if not len(place):
                continue
            shingles, text = shingles[place], of_text[place]
            inside = gate[shingles & np.uint64(0xFFFFF)]
            maybe = np.flatnonzero(inside)
            inside[maybe] = np.isin(shingles[maybe], every)
            if not inside.any():
                continue
            new = np.r_[True, text[1:] != text[:-1]]
            inner = np.arange(len(place)) - np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
            for w, members, low in classes:  # segments of w shingles in each text; a window is a segment and the next
                head = np.flatnonzero(inner % w == 0)
                joined = np.r_[text[head][1:] == text[head][:-1], False]
                stop = np.r_[head[1:], len(place)]
                count = np.add.reduceat(inside.astype(np.int64), head)
                count[:-1] += np.where(joined[:-1], count[1:], 0)
                least = CONTAINMENT * min(len(self.sets[m]) for m in members)
                for p in np.flatnonzero(count >= least - 1e-9):
                    i, j = head[p], stop[p + 1] if joined[p] else stop[p]
                    for m in members[(low == _minima(shingles[i:j])).any(axis=1)]:
                        for share, begin, end in self._places(shingles[i:j], m):
                            t = int(text[i])
                            found.setdefault((t, int(m)), []).append((share, int(place[i + begin] - words.first[t]), int(place[i + end] - words.first[t]) + n))
        out = []
        for (t, m), places in sorted(found.items()):
            kept: list[tuple[float, int, int]] = []
            for x in sorted(set(places), key=lambda x: (-x[0], x[1], x[2])):  # of overlapping places the best
                if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                    kept.append(x)
            out += [(t, m, *x) for x in sorted(kept, key=lambda x: x[1])]
        return out

    def _places(self, window: np.ndarray, m: int) -> list[tuple[float, int, int]]:
        """(containment, first and last shingle) of the places of a template in a window that holds it."""
        own = self.sets[m]
        hits = np.flatnonzero(np.isin(window, own))
        share = lambda x: len(np.unique(window[x])) / len(own)
        if share(hits) < CONTAINMENT:
            return []
        out, k = [], 0
        while k < len(hits):
            for length in (self.length[m], math.ceil(self.length[m] / CONTAINMENT)):
                inside = hits[k:][hits[k:] < hits[k] + length]
                if share(inside) >= CONTAINMENT:
                    out.append((share(inside), int(inside[0]), int(inside[-1])))
                    k += len(inside) - 1
                    break
            k += 1
        return out or [(share(hits), int(hits[0]), int(hits[-1]))]


def _build(shard: pa.Table | None) -> Templates:
    return Templates(list(zip(shard.column("name").to_pylist(), shard.column("text").to_pylist(), strict=True)) if shard is not None else [])


def _scan(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = held(uri, _build)
            at, data = utf8(batch.column(1))
            for i, j in slices(at):
                found = index.scan(Words(at[i : j + 1], data))
                if found:
                    text, template, share, begin, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + k for k in text])), pa.array([index.names[k] for k in template], pa.string()), pa.array(share, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                        ["doc_id", "license", "containment", "first_word", "end_word"],
                    )

    return run


def scan(docs: DataFrame, templates: DataFrame | None = None, most: int = TEMPLATE_BYTES) -> DataFrame:
    """(doc_id, license, containment, first_word, end_word) of each place of each template in each document."""
    if templates is None:
        templates = docs.sparkSession.createDataFrame([*TEMPLATES, *full_texts()], "name string, text string")
    given = templates.select(F.col("name").cast("string").alias("name"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_word long, end_word long"
    out = None
    for uri in write_shards(given, "license_templates", sizes(given, F.octet_length("text"))[1], most, F.struct("name", "text"), ["name", "text"]):
        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(uri), schema)
        out = found if out is None else out.unionByName(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
