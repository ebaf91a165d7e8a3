"""Licence families of paragraphs, by a trained classifier.

Paragraphs that speak of licences are found in all texts. A logistic regression over word n-grams, trained on templates and on
paragraphs of the corpus that name their licence, gives each a family or the unknown class; its probabilities are calibrated on
rows kept from training, and a family stands only if one of its templates shares enough n-grams with the paragraph. Everything
that touches the corpus is DataFrame functions; the weights are fitted on a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import beside, cut, let

# Words that mark a line as one about licences, the names licences go by, and templates of each family.
ANCHOR = r"(?i)licen[sc]|copyright|copyleft|all rights reserved|permission is hereby|redistribut|public domain|creative commons|\bcc by\b|spdx|warrant(?:y|ies)"
#: What stands between words: a dot belongs to a word only before a digit.
BETWEEN = r"(?:[^\p{L}\p{N}.]|\.(?!\p{N}))+"
START, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def told(name: str) -> str:
    """A name that is also an ordinary word ("mit" is German, Apache a people): it counts only where the words beside it tell of a licence."""
    return (rf"{START}(?:{name}) (?:(?:x11|expat|software|public|style|[0-4] clause) )*licen[sc]"
            rf"|{START}under (?:(?:the|an?|both|either|terms of|conditions of) )*(?:{name}){END}"
            rf"|{START}(?:licen[sc]\w*|spdx) (?:(?:identifier|expression|is|are|under|as|type|name|with|the|osi|approved) )*(?:{name}){END}"
            rf"|{START}(?:{name}) (?:(?:or|and) )?(?:apache (?:licen[sc]e )?(?:v|version )?[12]|l?gpl|bsd [0-4]|mpl)"
            rf"|(?:apache (?:licen[sc]e )?(?:v|version )?[12](?:\.\d)?|gpl(?: ?v?[23](?:\.0)?)?|bsd [0-4] clause|mpl [12](?:\.\d)?) (?:or|and) (?:{name}){END}")


NAMES = {
    "mit": told("mit"),
    "apache": rf"{told('apache')}|{START}apache (?:v|version )?[12](?:\.[01])?{END}",
    "gpl": rf"{START}(?:[la]?gpl|gnu (?:lesser |library |affero )?general public)",
    "bsd": rf"{told('bsd')}|{START}bsd [0-4] clause|{START}[0-4] clause bsd{END}|{START}0bsd{END}",
    "cc-by-nc": rf"{START}cc by (?:sa )?nc{END}|{START}attribution non ?commercial",
    "cc-by": rf"{START}cc by{END}(?! (?:sa )?nc{END})|{START}creative commons attribution{END}(?! non)",
    "mpl": rf"{told('mpl')}|{START}mpl (?:v|version )?[12](?:\.\d)?{END}|{START}mozilla public{END}",
    "public-domain": rf"{START}public domain{END}|{START}cc0{END}|{START}unlicense{END}",
}
#: What any text that names a licence holds besides ANCHOR, across line breaks too; looks only at the starts of words, as most texts hold nothing of it.
HINT = r"(?i)(?<![a-z0-9])(?=[aglcmpu0-4])(?:apache|[la]?gpl|gnu|0?bsd|[0-4]_clause|cc_by|cc0|attribution|mpl|mozilla|public|unlicense|under_(?:(?:the|an?|both|either|terms_of|conditions_of)_)*mit)".replace("_", BETWEEN)
#: A heading that says no more than licence belongs to the block after it.
HEADING = r"(?im)^([\p{P}\p{S}\x20\t]*licen[sc](?:e|es|ing)[\p{P}\p{S}\x20\t]*)\r?\n(?:[\x20\t]*\r?\n)+"
BLANK = r"\n(?:[\x20\t\r]*\n)+"
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "SPDX-License-Identifier: MIT", "License: MIT"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
               "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "either version 3 of the License, or (at your option) any later version",
            "SPDX-License-Identifier: GPL-3.0-or-later", "License: GPL-3.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
            "SPDX-License-Identifier: BSD-3-Clause", "License: BSD-3-Clause"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "mpl": ["Released under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0.",
                      "SPDX-License-Identifier: CC0-1.0"],
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Paragraphs of each label that the classifier is trained on at most, by the smallest hashes, and n-grams it looks at.
TRAINED_ON, VOCABULARY = 400, 1500
#: Every so many-th row is kept from training for calibration, which asks for this precision.
HELD_OUT, PRECISION = 4, 0.99
#: Share of the n-grams of the shorter of paragraph and template that must be in the other.
CONFIRMED = 0.5


def grams(paragraph: Column) -> Column:
    """The distinct words and pairs and triples of words, in lower case."""
    words = F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.]+|\.(?=\P{N}|$)"), lambda w: w != "")
    return let(words, lambda w: F.array_compact(F.array_distinct(F.concat(
        w, F.transform(w, lambda x, i: F.when(i + 1 < F.size(w), F.concat_ws(" ", x, F.get(w, i + 1)))),
        F.transform(w, lambda x, i: F.when(i + 2 < F.size(w), F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))))))


def named(paragraph: Column) -> Column:
    """The families a text names, sorted."""
    return let(F.regexp_replace(F.lower(paragraph), BETWEEN, " "), lambda plain: F.filter(
        F.array(*[F.when(plain.rlike(p), F.lit(f)) for f, p in sorted(NAMES.items())]), lambda x: x.isNotNull()))


@dataclass
class Model:
    """Weights by n-gram and family, bias by family, temperature and the probability below which a paragraph is unknown."""

    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[list[str], str, bool]], ridge: float = 0.01, steps: int = 200) -> Model:
    """The model of labelled rows (n-grams, label, held out): gradient descent with momentum, then temperature and threshold."""
    seen = Counter(g for gs, label, held in rows if not held and label != UNKNOWN for g in gs)
    vocabulary = [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]]
    at = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([FAMILIES.index(label) for _, label, _ in rows])
    for r, (gs, _, _) in enumerate(rows):
        found = [at[g] for g in gs if g in at]
        x[r, found] = 1 / np.sqrt(max(1, len(found)))
    held = np.array([h for _, _, h in rows])
    target = np.eye(len(FAMILIES))[y]
    share = 1 / np.maximum(1, np.bincount(y[~held], minlength=len(FAMILIES)))[y]  # families count alike
    w, b, vw, vb = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES)), 0.0, 0.0
    a, t, s = x[~held], target[~held], (share / share[~held].sum())[~held][:, None]
    for _ in range(steps):
        g = (softmax(a @ w + b) - t) * s
        vw, vb = 0.9 * vw - 5 * (a.T @ g + ridge / len(a) * w), 0.9 * vb - 5 * g.sum(axis=0)
        w, b = w + vw, b + vb
    z, truth = (x[held], y[held]) if held.any() else (a, y[~held])
    z = z @ w + b
    losses = {T: -np.log(np.maximum(softmax(z / T)[np.arange(len(truth)), truth], 1e-12)).mean() for T in np.geomspace(0.1, 10, 41)}
    temperature = float(min(losses, key=losses.get))
    p = softmax(z / temperature)
    best, top = p.argmax(axis=1), p.max(axis=1)
    family = best != FAMILIES.index(UNKNOWN)
    least = next((float(c) for c in np.arange(0.5, 0.96, 0.05) if (family & (top >= c)).any() and (best == truth)[family & (top >= c)].mean() >= PRECISION), 0.95)
    return Model(vocabulary, w, b, temperature, least)


FOUND = "array<struct<block:int,own:boolean,names:array<string>,grams:array<string>>>"


def paragraphs(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``row``, ``rid`` and ``found``: the lines of each text that speak of licences, with the families they name and their n-grams.

    Lines up to a blank line are a block. One of several lines is there as a whole as well, not ``own``, if one of its lines
    is or if it names a licence across a line break.
    """
    t = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    df = beside(docs, keep, _text=t)
    unit = lambda x, block, own: F.struct(block.alias("block"), F.lit(own).alias("own"), named(x).alias("names"), x.alias("text"))

    def units(x: Column, block: Column) -> Column:
        """Of a block: its lines that speak of licences, then the block itself."""
        own = F.filter(F.transform(F.split(x, "\n"), lambda line: unit(line, block, True)), lambda u: u["text"].rlike(ANCHOR) | (F.size(u["names"]) > 0))
        whole = F.filter(F.array(unit(x, block, False)), lambda u: x.contains("\n"))
        return F.when(x.rlike(ANCHOR) | x.rlike(HINT), let(own, lambda o: F.concat(o, F.filter(whole, lambda u: (F.size(o) > 0) | (F.size(u["names"]) > 0))))).otherwise(F.filter(whole, lambda u: F.lit(False)))

    found = F.flatten(F.transform(F.split(F.regexp_replace("_text", HEADING, "$1\n"), BLANK), units))
    found = F.transform(found, lambda u: F.struct(u["block"], u["own"], u["names"], grams(u["text"]).alias("grams")))
    speaks = F.col("_text").rlike(ANCHOR) | F.col("_text").rlike(HINT)
    return df.select("row", F.monotonically_increasing_id().alias("rid"), F.when(speaks, found).otherwise(F.array()).cast(FOUND).alias("found"))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string").select("family", grams(F.col("template")).alias("grams"))


def fit(each: DataFrame) -> Model:
    """Trained on the templates and, of each label, on the lines (``names``, ``grams``) with the smallest hashes.

    A line that names several licences has no label, nor has one that names none but shares three words in a row with a template.
    """
    spark = each.sparkSession
    known = templates(spark).select(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("g")).first()["g"]  # fixed templates
    alike = F.arrays_overlap("grams", F.array(*[F.lit(g) for g in known if g.count(" ") == 2]))
    label = F.when(F.size("names") == 0, F.lit(UNKNOWN)).when(F.size("names") == 1, F.get("names", 0))
    labelled = cut(each.select("grams", F.when(~((label == UNKNOWN) & alike), label).alias("label")).where("label IS NOT NULL").select("grams", "label", F.xxhash64("grams").alias("h")).dropDuplicates(["h", "label"]))
    rows = [(r["grams"], r["family"], False) for r in templates(spark).collect()]
    for label in FAMILIES:
        taken = labelled.where(F.col("label") == label).orderBy("h").limit(TRAINED_ON).collect()
        rows += [(r["grams"], label, i % HELD_OUT == 1) for i, r in enumerate(taken)]
    rows += [(gs[: len(gs) // 3], UNKNOWN, False) for gs in (["see", "the", "licence", "see the", "the licence", "see the licence"], ["copyright", "notice", "copyright notice"])]
    return train(rows)


def classify(each: DataFrame, model: Model) -> DataFrame:
    """``rid, line, grams`` with family (unknown included), probability and confirmed."""
    spark = each.sparkSession
    weights = cut(spark.createDataFrame([(g, [float(x) for x in w]) for g, w in zip(model.vocabulary, model.weights)], "gram string, w array<double>"))
    rows = each.select("rid", "line", F.explode("grams").alias("g"))
    hits = rows.join(weights, rows["g"] == weights["gram"]).groupBy("rid", "line").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("w", i)).alias(f"w{i}") for i in range(len(FAMILIES))])
    z = [(F.coalesce(F.col(f"w{i}") / F.sqrt("n"), F.lit(0.0)) + float(model.bias[i])) / model.temperature for i in range(len(FAMILIES))]
    scored = F.array_sort(F.array(*[F.struct(F.round(-x, 9).alias("z"), F.lit(f).alias("family")) for x, f in zip(z, FAMILIES)]))
    k = hits.withColumnsRenamed({"rid": "_rid", "line": "_line"})
    df = each.join(k, (each["rid"] == k["_rid"]) & (each["line"] == k["_line"]), "left").select("rid", "line", "grams", scored.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(F.get("s", 0)["z"] - x["z"]))
    df = df.select("rid", "line", "grams", F.get("s", 0)["family"].alias("likeliest"), F.round(1 / total, 6).alias("probability"))
    df = df.withColumn("family", F.when(F.col("probability") >= model.least, F.col("likeliest")).otherwise(F.lit(UNKNOWN)))
    t = cut(templates(spark)).select(F.col("family").alias("_family"), F.col("grams").alias("_grams"))
    alike = F.size(F.array_intersect("grams", "_grams")) / F.greatest(F.lit(1), F.least(F.size("grams"), F.size("_grams")))
    near = df.join(t, df["family"] == t["_family"], "left").groupBy("rid", "line").agg(
        F.first("family").alias("family"), F.first("probability").alias("probability"), F.max(alike).alias("alike"))
    return near.withColumn("confirmed", F.coalesce(F.col("alike") >= CONFIRMED, F.lit(False)))


def scan_licences(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """All documents as ``row`` with n_paragraphs (lines that speak of licences), n_confirmed, n_unknown (without a family) and
    ``families``, the confirmed ones sorted and joined by commas.

    A line has the families it names and the one the classifier gives and a template confirms. Families that only the joined
    lines of a block have go to those of its lines that have none; a block that names one across a line break, and has no line
    that speaks of licences, counts as a line. Null and empty texts have none; repeated rows are judged alike; an empty table stays empty.
    """
    found = cut(paragraphs(docs, text, keep))
    each = found.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("line", "x")).select("rid", "line", "x.block", "x.own", "x.names", "x.grams")
    judged = classify(each.select("rid", "line", "grams"), fit(each.where("own"))).select(
        F.col("rid").alias("_rid"), F.col("line").alias("_line"), F.when(F.col("confirmed"), F.array("family")).otherwise(F.array().cast("array<string>")).alias("likely"))
    have = each.join(judged, (each["rid"] == judged["_rid"]) & (each["line"] == judged["_line"])).select("rid", "block", "own", F.array_union("names", "likely").alias("families"))
    block = have.groupBy("rid", "block").agg(
        F.count_if("own").alias("n"), F.count_if(F.col("own") & (F.size("families") == 0)).alias("bare"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("own"), F.col("families"))))).alias("mine"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("own"), F.col("families"))))).alias("whole"))
    more = F.size(F.array_except("whole", "mine")) > 0
    block = block.select("rid", F.greatest("n", F.lit(1)).alias("n"), F.when((F.col("n") > 0) & ~more, F.col("bare")).otherwise(F.lit(0)).alias("bare"), F.array_union("mine", "whole").alias("families"))
    sums = block.groupBy("rid").agg(
        F.sum("n").alias("n_paragraphs"), F.sum(F.col("n") - F.col("bare")).alias("n_confirmed"), F.sum("bare").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families")).withColumnRenamed("rid", "_rid")
    n = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_paragraphs", "n_confirmed", "n_unknown")]
    return found.join(sums, found["rid"] == sums["_rid"], "left").select("row", *n, F.coalesce("families", F.lit("")).alias("families"))
