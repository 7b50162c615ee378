"""License scans: word-bigram Dice against licence templates; built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICE = 0.8
BROADCAST_BIGRAMS = 200_000
# Licence notices as they are commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
)


def templates(spark: SparkSession) -> DataFrame:
    """The built-in templates as (template_id, license, text)."""
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id int, license string, text string")


def with_bigrams(df: DataFrame, text: str) -> DataFrame:
    """Adds bigrams, the distinct pairs of neighbouring words of the normalised text; rows with fewer than two words go.

    The words are bound as a lambda's variable, and the pairs come out of a generator, so that later filters on them are not
    pushed down to where they would have the text normalised again and again.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")

    def pairs(w):
        found = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.when(F.size(w) > 1, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return df.withColumn("bigrams", F.explode(F.transform(F.array(words), pairs))).where(F.size("bigrams") > 0)


def scan_licenses(docs: DataFrame, notices: DataFrame | None = None, least: float = DICE) -> DataFrame:
    """Lines and whole texts of docs (doc_id, text) that are a licence notice: Dice of word bigrams of `least` or more.

    A unit with n bigrams can reach a template with m only if 2 min(n, m) / (n + m) >= least, so units outside every
    template's bounds are dropped before their bigrams are looked up in the templates' (an equi-join; the templates are
    sent to all tasks if they have at most BROADCAST_BIGRAMS pairs). Returns doc_id, line (number from 0; -1: the whole text, if it has several lines),
    template_id, license, overlap, n_bigrams, n_template, dice: the best template of each unit, ties to the smaller id.
    Null and empty texts give no rows; repeated rows are scanned each; other columns are ignored.
    """
    spark = docs.sparkSession
    t = with_bigrams((notices or templates(spark)).select("template_id", "license", "text"), "text")
    t = t.select("template_id", "license", F.size("bigrams").alias("n_template"), "bigrams")
    low, high, total = t.agg(F.min("n_template"), F.max("n_template"), F.sum("n_template")).first()
    if low is None:
        low, high, total = 1, 0, 0
    ratio = least / (2 - least)
    rows = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    whole = rows.where("instr(text, '\n') > 0").select("doc_id", "row", F.lit(-1).alias("line"), F.col("text").alias("unit"))
    n = F.size("bigrams")
    bounds = (n >= low * ratio - 1e-9) & (n <= high / ratio + 1e-9)
    units = with_bigrams(lines.unionByName(whole), "unit").where(bounds).select("doc_id", "row", "line", n.alias("n_bigrams"), F.explode("bigrams").alias("bigram"))
    index = t.select("template_id", "license", "n_template", F.explode("bigrams").alias("bigram"))
    a, b = F.col("n_bigrams"), F.col("n_template")
    # so few rows that every task may hold them; more are joined by a shuffle
    hits = units.join(F.broadcast(index) if total <= BROADCAST_BIGRAMS else index, "bigram").where(2 * F.least(a, b) >= least * (a + b) - 1e-9)
    hits = hits.groupBy("doc_id", "row", "line", "n_bigrams", "template_id", "license", "n_template").agg(F.count("*").alias("overlap"))
    hits = hits.withColumn("dice", 2 * F.col("overlap") / (a + b)).where(F.col("dice") >= least)
    best = hits.groupBy("doc_id", "row", "line").agg(F.max(F.struct("dice", (-F.col("template_id")).alias("neg"), "license", "overlap", "n_bigrams", "n_template")).alias("x"))
    return best.select("doc_id", "line", (-F.col("x.neg")).alias("template_id"), "x.license", "x.overlap", "x.n_bigrams", "x.n_template", "x.dice")


def op7_license_dice(spark, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "line", "template_id", "license", "overlap", "n_bigrams", "n_template", F.round("dice", 6).alias("dice"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t0 AS (SELECT template_id, license, {words.format("text")} AS w FROM (VALUES {values}) v(template_id, license, text)),
t AS (SELECT template_id, license, {pairs} AS b FROM t0 WHERE len(w) > 1),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(0, len(ls)))::int AS line, unnest(ls) AS unit FROM l
      UNION ALL SELECT doc_id, -1, text FROM l WHERE len(ls) > 1),
u0 AS (SELECT doc_id, line, {words.format("unit")} AS w FROM u),
u1 AS (SELECT doc_id, line, {pairs} AS b FROM u0 WHERE len(w) > 1),
h AS (SELECT doc_id, line, template_id, license, len(list_intersect(u1.b, t.b))::bigint AS overlap, len(u1.b)::int AS n_bigrams, len(t.b)::int AS n_template
      FROM u1 JOIN t ON 2 * least(len(u1.b), len(t.b)) >= {DICE}::double * (len(u1.b) + len(t.b)) - 1e-9),
d AS (SELECT *, 2 * overlap / (n_bigrams + n_template)::double AS dice FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template_id) AS k FROM d WHERE dice >= {DICE}::double)
SELECT doc_id, line, template_id, license, overlap, n_bigrams, n_template, round(dice, 6) AS dice FROM r WHERE k = 1
"""


OP7_SQL = _sql()
