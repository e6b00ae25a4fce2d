"""Licence scans: sparse TF-IDF cosine of lines and licence files to templates, then inheritance along directories.

Units of a text are its lines and its paragraphs (runs of lines without an empty one); of a licence file also the whole
text. A unit's vector holds its terms' counts times their inverse document frequency; document frequencies of the
templates' terms are counted over all texts, every other term weighs like an unseen one. A unit's licence is the
template of the highest cosine, if it reaches `threshold`; a text's licence is that of its best unit. Units without one
of the rarer terms cannot reach the threshold (the remaining terms' share of any template is too small) and are skipped
for that reason alone.

A file without a licence of its own takes that of the nearest directory at or above it that holds a licence file with a
recognised licence. Directories, not files, are joined to their ancestors.

Null text: no licence of its own. Null path: no inheritance. Ties: the higher cosine, then the smaller licence name; of
several licence files in a directory, the smallest file name. Repeated rows: each is returned. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import arrow_map
from stockline.operators.scale import checkpointed

THRESHOLD = 0.75
#: Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-"
                     "NonCommercial 4.0 International License."),
}

_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Templates:
    """Weighted templates under document frequencies over n documents."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], n: int, threshold: float):
        vocabulary = {t for texts in templates.values() for text in texts for t in terms(text)}
        self.unseen = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
        self.threshold, self.vectors = threshold, []
        for name, texts in sorted(templates.items()):
            for text in texts:
                vector = {t: c * self.idf[t] for t, c in Counter(terms(text)).items()}
                norm = math.sqrt(sum(w * w for w in vector.values()))
                self.vectors.append((name, {t: w / norm for t, w in vector.items()}))
        # The commonest terms that all together cannot lift any template to the threshold; a unit needs one of the rest.
        common, mass = set(), [0.0] * len(self.vectors)
        for term in sorted(vocabulary, key=lambda t: (self.idf[t], t)):
            more = [m + vector.get(term, 0.0) ** 2 for m, (_, vector) in zip(mass, self.vectors)]
            if max(more) >= threshold**2 * (1 - 1e-9):
                break
            common.add(term)
            mass = more
        rare = sorted(vocabulary - common)
        self.rare = re.compile("(?<![a-z0-9])(?:" + "|".join(map(re.escape, rare)) + ")(?![a-z0-9])")

    def best(self, unit: str) -> tuple[float, str | None]:
        if not self.rare.search(unit):
            return 0.0, None
        vector = {t: c * self.idf.get(t, self.unseen) for t, c in Counter(terms(unit)).items()}
        norm = math.sqrt(sum(w * w for w in vector.values())) or 1.0
        scored = ((sum(w * v for t, w in known.items() if (v := vector.get(t))), name) for name, known in self.vectors)
        score, name = min(((-s / norm, name) for s, name in scored))
        return (-score, name) if -score >= self.threshold else (0.0, None)

    def of_text(self, text: str | None, is_file: bool) -> tuple[float, str | None]:
        lowered = (text or "").lower()
        if not self.rare.search(lowered):
            return 0.0, None
        found = [self.best(unit) for unit in units(lowered, is_file)]
        score, name = min(((-s, name) for s, name in found if name), default=(0.0, None))
        return -score, name


def units(text: str, is_file: bool) -> Iterator[str]:
    lines = text.split("\n")
    yield from lines
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
        else:
            if len(paragraph) > 1:
                yield " ".join(paragraph)
            paragraph = []
    if is_file:
        yield text


def term_frequency(texts: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """(documents with each term of the vocabulary, all documents); one row per term reaches the driver."""
    shared = frozenset(vocabulary)

    def work(part: pa.RecordBatch) -> dict:
        counts = Counter({"": part.num_rows})
        for text in part.column(0):
            counts.update(shared.intersection(terms(text.as_py() or "")))
        return {"term": list(counts), "n": list(counts.values())}

    sums = arrow_map(texts.select("text"), work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {row.term: row.n for row in sums.collect()}
    return found, found.pop("", 0)


def own_licences(files: DataFrame, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, directory, name, is_file (a licence file by name), own_license, own_score."""
    vocabulary = {t for texts in templates.values() for text in texts for t in terms(text)}
    weighted = Templates(templates, *term_frequency(files, vocabulary), threshold)

    def work(part: pa.RecordBatch) -> dict:
        found = [weighted.of_text(t.as_py(), f) for t, f in zip(part.column(3), part.column(2).to_pylist())]
        scores, names = zip(*found)
        return {"doc_id": part.column(0), "path": part.column(1), "is_file": part.column(2),
                "own_license": names, "own_score": scores}

    rows = files.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("path"),
        F.coalesce(file_name(F.col("path")).rlike(_LICENCE_FILE), F.lit(False)).alias("is_file"), F.col("text"),
    )
    schema = "doc_id long, path string, is_file boolean, own_license string, own_score double"
    return arrow_map(rows, work, schema).select("*", directory(F.col("path")).alias("directory"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The directory of a path, without a closing slash; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scanned(files: DataFrame, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, license (own or inherited), inherited_from (a directory, else null).

    files: doc_id, path, text.
    """
    own = checkpointed(own_licences(files, templates, threshold))
    named = own.filter(F.col("is_file") & F.col("own_license").isNotNull())
    given = named.groupBy(F.col("directory").alias("ancestor")).agg(F.min(F.struct("path", "own_license")).alias("file"))
    given = given.select("ancestor", F.col("file.own_license").alias("given"))
    places = own.filter(F.col("directory").isNotNull()).select("directory").distinct()
    parts = F.split("directory", "/", -1)
    depths = F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(parts)))
    above = places.select("directory", F.explode(depths).alias("depth")).select(
        "directory", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("ancestor")
    )
    nearest = above.join(given, "ancestor").groupBy("directory").agg(
        F.max(F.struct("depth", "ancestor", "given")).alias("near")
    )
    near = nearest.select(
        F.col("directory").alias("_directory"), F.col("near.ancestor").alias("_from"), F.col("near.given").alias("_given")
    )
    joined = own.join(near, F.col("directory") == F.col("_directory"), "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "_given").alias("license"),
        F.when(inherits, F.col("_from")).alias("inherited_from"),
    )
