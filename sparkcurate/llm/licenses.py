"""Licence scans: sparse TF-IDF cosine of lines to licence templates, and inheritance along paths.

Every line of every whole text is compared with the templates; a line may be a header anywhere in its file.
Document frequencies of the templates' terms come from the whole corpus. Only lines with an anchor are
looked at term by term: anchors are the rarest terms, so many that the others alone, however they are
combined, keep every cosine below the threshold (by Cauchy and Schwarz), so nothing is lost. What is left
is a join of line terms with template terms and two sums.

A file is a licence file by its name, or if licence lines make up ``file_share`` of its words. It holds
for its directory and all below that have none of their own: directories, not files, are joined with
their ancestors, and files then look up their directory.

Texts are read twice and never shuffled. Templates and their terms are parameters, and bound all
that is broadcast for the comparison.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, stored

#: Notices by which licences are stated.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Names of licence files.
LICENSE_NAME = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[._-].*)?$"
TERM = r"[a-z0-9]+"


def terms_column(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def document_frequency(texts: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each vocabulary term occurs, and the number of texts."""
    words = F.array(*[F.lit(t) for t in vocabulary])
    held = texts.select(F.array_intersect(words, terms_column(F.col("text"))).alias("held"))
    # One count per vocabulary term and one for all rows, in a single aggregation.
    found = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("term")).groupBy("term").count()
    counts = {r.term: r["count"] for r in found.collect()}
    return counts, counts.pop("", 0)


def template_vectors(templates: tuple, frequency: dict[str, int], n: int) -> tuple[dict, list, float]:
    """Idf by term, unit vectors of the templates (name, {term: weight}), and the idf of unknown terms."""
    unknown = math.log(1 + n) + 1
    parsed = [(name, Counter(re.findall(TERM, text.lower()))) for name, text in templates]
    idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1 for _, c in parsed for t in c}
    vectors = []
    for name, counts in parsed:
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in counts.items()))
        vectors.append((name, {t: k * idf[t] / norm for t, k in counts.items()}))
    return idf, vectors, unknown


def anchor_terms(idf: dict[str, float], vectors: list, threshold: float) -> list[str]:
    """The fewest rarest terms without which no line can reach the threshold."""
    order, anchors = sorted(idf, key=lambda t: (-idf[t], t)), set()
    for term in order:
        rest = max(sum(w * w for t, w in v.items() if t not in anchors) for _, v in vectors)
        if rest < threshold**2:
            break
        anchors.add(term)
    return sorted(anchors)


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                  templates: tuple = TEMPLATES, threshold: float = 0.7, file_share: float = 0.25) -> DataFrame:
    """The licence of every file: id, path, license, origin, score, n_license_lines, from_dir.

    ``origin`` is ``header`` (a line of the file states it), ``file`` (it is a licence file),
    ``inherited`` (from the nearest directory above with a licence file, ``from_dir``) or ``none``. One row
    per input row, repeated ones included. Of several lines the best score decides, then the name; of
    several licence files in a directory likewise. A null text has no line; a null path lies in the
    root. A licence file whose text matches nothing holds for nothing. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = files.sparkSession
    text, path = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(path_col), F.lit(""))
    plain = files.select(F.col(id_col).alias("id"), path.alias("path"), text.alias("text"))
    vocabulary = sorted({t for _, x in templates for t in re.findall(TERM, x.lower())})
    frequency, n = document_frequency(plain, vocabulary)
    idf, vectors, unknown = template_vectors(templates, frequency, n)
    anchors = anchor_terms(idf, vectors, threshold)
    anchored = rf"(?i)(?<![a-z0-9])(?:{'|'.join(anchors)})(?![a-z0-9])"
    lines = F.when(F.col("text").rlike(anchored), F.filter(F.split("text", "\n"), lambda x: x.rlike(anchored)))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = stored(plain.select(
        F.monotonically_increasing_id().alias("row"), "id", "path", folder.alias("dir"),
        F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_NAME).alias("named"),
        F.when(F.col("text").rlike(anchored), F.size(terms_column(F.col("text")))).alias("words"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"),
    ))
    # Bounded by the templates: a row per template and term.
    weights = F.broadcast(spark.createDataFrame(
        [(t, i, name, w) for i, (name, v) in enumerate(vectors) for t, w in v.items()],
        "term string, template int, license string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    said = rows.select("row", F.posexplode("lines").alias("line", "said"))
    terms = (
        said.select("row", "line", F.explode(terms_column(F.col("said"))).alias("term"))
        .groupBy("row", "line", "term").agg(F.count(F.lit(1)).alias("k"))
        .join(idfs, "term", "left")
        .select("row", "line", "term", "k", (F.col("k") * F.coalesce("idf", F.lit(unknown))).alias("v"))
    )
    norms = terms.groupBy("row", "line").agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum("k").alias("k"))
    dots = terms.join(weights, "term").groupBy("row", "line", "template", "license").agg(
        F.sum(F.col("v") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, ["row", "line"]).select(
        "row", "line", "license", "k", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best_line = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l")))
    stated = cosines.where(F.col("score") >= threshold).groupBy("row", "line", "k").agg(best_line.alias("b"))
    own = stored(stated.groupBy("row").agg(
        F.min(F.struct(F.col("b.s").alias("s"), F.col("b.l").alias("l"))).alias("b"),
        F.count(F.lit(1)).alias("n_license_lines"), F.sum("k").alias("said"),
    ).select("row", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), "n_license_lines", "said"))
    marked = stored(rows.drop("lines").join(own, "row", "left").withColumn(
        "is_file", F.col("license").isNotNull() & (F.col("named") | (F.col("said") >= F.col("words") * file_share))))
    holders = marked.where("is_file").groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b"))
    holders = holders.select(F.col("dir").alias("from_dir"), F.col("b.l").alias("given"), (-F.col("b.s")).alias("gave"))
    nearest = inherited(marked.select("dir").distinct(), holders)
    met = marked.join(nearest, "dir", "left")
    none = F.col("license").isNull() & F.col("given").isNull()
    return met.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col),
        F.coalesce("license", "given").alias("license"),
        F.when(none, "none").when(F.col("license").isNull(), "inherited").when(F.col("is_file"), "file")
        .otherwise("header").alias("origin"),
        F.coalesce("score", "gave").alias("score"),
        F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"),
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def inherited(folders: DataFrame, holders: DataFrame) -> DataFrame:
    """For each directory the nearest one at or above it in ``holders`` (from_dir, ...): dir, from_dir, ...

    The root is the empty path. Directories without any holder are left out.
    """
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    depths = F.sequence(F.lit(0), F.size(parts))
    chain = folders.select("dir", F.explode(F.transform(depths, lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above")))).alias("a"))
    met = chain.select("dir", "a.depth", F.col("a.above").alias("from_dir")).join(holders, "from_dir")
    rest = [c for c in holders.columns if c != "from_dir"]
    return met.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", *rest)).alias("m")).select(
        "dir", "m.from_dir", *[f"m.{c}" for c in rest])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, with source and language as its directories."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                       F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit(".txt")))
    return scan_licenses(docs.withColumn("path", path))


QUERIES = {"op4_licenses": op4_licenses}
ORACLES: dict[str, str] = {}
