"""License scans, in DataFrame functions only: TF-IDF cosine of headers to templates, then inheritance down the tree.

A file's header is what its whole text says about licensing: the lines that hold one of ``CUES``, and the passages that
say what a template says, whatever lines and marks they are wrapped in and whether they hold a cue. The collection for
TF-IDF is all headers and the templates; a term's weight is its count times ``ln((1 + N) / (1 + df)) + 1``. A header
takes the licence of the template of the highest cosine, if that reaches ``min_score`` (ties: the licence first by name). A file is a
licence file when at least ``file_share`` of its words are in its header; it speaks for its directory. A directory's
licence is that of most of its licence files (ties: by name). A file without a header of its own inherits from the
nearest ancestor directory that has a licence, found by joining the paths of its ancestors.

Edge cases: null and empty texts have no header; a null path is a file outside every directory, which inherits nothing;
a path without a slash lies in the root ""; repeated paths are judged row by row; without templates, files or rows
nothing is licensed; extra columns are ignored by ``scan``.

Scale: header lines meet the templates by term, a join with a small table of fixed size; only header lines are taken
apart, other text is read once and left. Distinct headers are scored, so a header that a third of all files share is
one row. Ancestors are one row for each level of a path, and meet directories by an equi-join that AQE can split.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import lower_ascii, stash, word_count

CUES = "licen[cs]e|copyright|copyleft|spdx|all rights reserved|public domain"
MIN_SCORE = 0.5
FILE_SHARE = 0.2
DIR_SIZE = 64

#: What headers and licence files usually say.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 3."),
    "ISC": ("ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("Copyright. All rights reserved.", "Proprietary and confidential; unauthorized copying is strictly prohibited."),
}


def terms(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9.]+"), lambda t: F.btrim(t, F.lit(".")) != "")


def passages(templates: Mapping[str, Sequence[str]]) -> str:
    """A regular expression of the templates and their sentences of four words or more, with anything but words between words."""
    said = set()
    for text in (t for texts in templates.values() for t in texts):
        for part in (text, *re.split(r"\.\s+", text)):
            words = [w.strip(".") for w in re.split("[^a-z0-9.]+", part.lower()) if w.strip(".")]
            if len(words) >= 4 or part == text:
                said.add("[^A-Za-z0-9]+".join(w.replace(".", "[.]") for w in words))
    # The longest first; sentences that begin alike are told apart after their beginning.
    return f"(?i)\\b(?:{'|'.join(sorted(said - {''}, key=lambda x: (-len(x), x)))})\\b" if said - {""} else ""


def header(text: Column, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> Column:
    """The lines with a cue and the passages of templates beyond them, joined; null where there is neither."""
    lines = F.when(F.lower(text).rlike(CUES), F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(CUES))).otherwise(F.array().cast("array<string>"))
    if rx := passages(templates):
        found = F.filter(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda p: p.contains("\n") | ~F.lower(p).rlike(CUES))
        bare = lambda x: F.regexp_replace(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
        lines = F.when(F.size(found) > 0, F.concat(F.filter(lines, lambda x: ~F.exists(found, lambda p: F.contains(p, bare(x)))), found)).otherwise(lines)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def weights(texts: DataFrame, n: int) -> DataFrame:
    """(name, term, weight, norm) of (name, text), with document frequencies over these texts."""
    tf = texts.select("name", F.explode(F.transform(terms(F.col("text")), lambda t: F.btrim(t, F.lit(".")))).alias("term")).groupBy("name", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").select("name", "term", (F.col("tf") * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)).alias("weight"))
    norms = weighed.groupBy("name").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norms, "name")


def scores(headers: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, min_score: float = MIN_SCORE) -> DataFrame:
    """(header, license, score) for distinct headers that reach min_score with their best template."""
    spark = headers.sparkSession
    known = spark.createDataFrame([(f"t:{i}:{k}", v) for k, texts in templates.items() for i, v in enumerate(texts)], "name string, text string")
    texts = headers.select(F.concat(F.lit("h:"), "header").alias("name"), F.col("header").alias("text")).where("header is not null").distinct().unionByName(known)
    texts, _ = stash(texts, "license-headers")
    w, _ = stash(weights(texts, texts.count()), "license-weights")
    mine = w.where("name like 't:%'").select(F.expr("substring(name, 5)").alias("license"), F.col("name").alias("template"), "term", (F.col("weight") / F.col("norm")).alias("t"))
    theirs = w.where("name like 'h:%'").select("name", "term", (F.col("weight") / F.col("norm")).alias("h"))
    dots = theirs.join(mine, "term").groupBy("name", "license", "template").agg(F.round(F.sum(F.col("h") * F.col("t")), 9).alias("score"))
    first = dots.groupBy("name").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))
    return first.where(F.col("score") >= min_score).select(F.expr("substring(name, 3)").alias("header"), "license", "score")


def directory(path: Column) -> Column:
    """What stands before the last slash; "" without one; null for null."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """The folder itself, its parents and the root "", as (depth, folder)."""
    parts = F.split(folder, "/")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder")))
    return F.when(folder == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("folder")))).otherwise(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("folder"))), deeper))


def scan(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, min_score: float = MIN_SCORE, file_share: float = FILE_SHARE) -> DataFrame:
    """For files (id, path, text): id, path, license, score (of the own header), licensed_by (header or directory), from_dir."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = header(text, templates)
    read = files.select("id", "path", h.alias("header"), (word_count(h) >= file_share * word_count(text)).alias("is_file"))
    read, _ = stash(read, "license-files")
    best = scores(read, templates, min_score).select(F.col("header").alias("_header"), F.col("license").alias("own"), "score")
    said = read.join(best, F.col("header") == F.col("_header"), "left").withColumn("folder", directory(F.col("path")))
    said, _ = stash(said.select("id", "path", "folder", "own", "score", "is_file"), "license-said")
    votes = said.where("is_file and own is not null and path is not null").groupBy("folder", "own").agg(F.count("*").alias("n"))
    of_dir = votes.groupBy("folder").agg(F.min_by("own", F.struct(-F.col("n"), "own")).alias("inherited"))
    # Each folder once, however many files it has; then each of its ancestors meets the directories with a licence.
    up = said.where("path is not null").select("folder").distinct().select(F.col("folder").alias("below"), F.explode(ancestors(F.col("folder"))).alias("a")).select("below", "a.depth", "a.folder")
    nearest = up.join(of_dir, "folder").groupBy("below").agg(F.max_by(F.struct("folder", "inherited"), "depth").alias("near"))
    out = said.join(nearest, F.col("folder") == F.col("below"), "left")
    by = F.when(F.col("own").isNotNull(), F.lit("header")).when(F.col("near").isNotNull(), F.lit("directory"))
    return out.select("id", "path", F.coalesce("own", "near.inherited").alias("license"), "score", by.alias("licensed_by"), F.when(F.col("own").isNull(), F.col("near.folder")).alias("from_dir"))


def report(docs: DataFrame) -> DataFrame:
    """Every document as a file of a tree: below its source, language, run of 64 ids and run of 8 ids, or only the first of these.

    How deep a file lies goes by its id, so that folders of every level have files, and licence files speak for all below.
    """
    none, doc = F.lit("none"), F.col("doc_id").cast("long")
    levels = F.array(F.coalesce("source", none), F.coalesce("lang", none), *[F.floor(doc / size).cast("string") for size in (DIR_SIZE, DIR_SIZE // 8)])
    path = F.concat_ws("/", F.array_join(F.slice(levels, 1, (F.pmod(doc, F.lit(4)) + 1).cast("int")), "/"), doc.cast("string"))
    files = docs.select(doc.alias("id"), F.when(doc.isNotNull(), path).alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id").withColumn("score", F.round("score", 6))


def _values() -> str:
    return ", ".join("('t:{}:{}', '{}')".format(i, k, v.replace("'", "''")) for k, texts in TEMPLATES.items() for i, v in enumerate(texts))


REPORT_SQL = (
    r"""
WITH files AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id,
         array_to_string(list_slice([coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 64 AS VARCHAR), CAST(doc_id // 8 AS VARCHAR)], 1, 1 + doc_id % 4), '/') AS folder,
         coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), '@CUES@')) AS lines
  FROM documents),
read AS (
  SELECT doc_id, folder, CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) END AS header,
         len(regexp_extract_all(array_to_string(lines, chr(10)), '[^ \t-\r]+')) >= 0.2 * len(regexp_extract_all(text, '[^ \t-\r]+')) AS is_file
  FROM files),
texts AS (
  SELECT DISTINCT 'h:' || header AS name, header AS text FROM read WHERE header IS NOT NULL UNION ALL VALUES @VALUES@),
tf AS (
  SELECT name, term, count(*) AS tf FROM (
    SELECT name, trim(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+')), '.') AS term FROM texts)
  WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT name, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS weight FROM tf JOIN df USING (term)),
u AS (SELECT name, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY name)) AS u FROM w),
dots AS (
  SELECT a.name, b.name[5:] AS license, b.name AS template, round(sum(a.u * b.u), 9) AS score FROM u a JOIN u b USING (term)
  WHERE a.name LIKE 'h:%' AND b.name LIKE 't:%' GROUP BY ALL),
best AS (
  SELECT name[3:] AS header, license AS own, score FROM dots
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, license) = 1 AND score >= 0.5),
said AS (SELECT r.*, own, score FROM read r LEFT JOIN best USING (header)),
of_dir AS (
  SELECT folder, own AS inherited FROM (SELECT folder, own, count(*) AS n FROM said WHERE is_file AND own IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, own) = 1),
near AS (
  SELECT f.folder AS below, arg_max(d.folder, length(d.folder)) AS folder, arg_max(d.inherited, length(d.folder)) AS inherited
  FROM (SELECT DISTINCT folder FROM said) f JOIN of_dir d ON f.folder = d.folder OR starts_with(f.folder, d.folder || '/') GROUP BY f.folder)
SELECT s.doc_id, s.folder || '/' || s.doc_id AS path, coalesce(own, d.inherited) AS license, round(score, 6) AS score,
       CASE WHEN own IS NOT NULL THEN 'header' WHEN d.inherited IS NOT NULL THEN 'directory' END AS licensed_by,
       CASE WHEN own IS NULL THEN d.folder END AS from_dir
FROM said s LEFT JOIN near d ON s.folder = d.below
"""
    .replace("@CUES@", CUES)
    .replace("@VALUES@", _values())
)
