"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A notice may be wrapped over lines or stand within a long one, so a paragraph is a run of one to six
adjacent lines without a blank one between; a long line counts as several, cut between words. All
such paragraphs are described by their one- and two-word runs. A multinomial logistic regression over
these sparse features, trained on the labelled sentences, on text that speaks of licences without
granting one and on a bounded sample of ordinary lines (without a word of licences, ``CUES``), names
the family of a paragraph or the class "unknown". A bound on its scores tells of most paragraphs that
they are "unknown"; the others are scored in full. The least probability for a family is
calibrated on a part of the table that was left out of a first training. A prediction counts if the
paragraph holds enough of the two-word runs of a template of that family. Of paragraphs that overlap
the most similar one stays, the shortest of equals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm.common import store, text_of
from renewlens.llm.decontamination import normalised_words

UNKNOWN = "unknown"
BACKGROUND_ROWS = 2_000
MOST_VOCABULARY = 1 << 16
# Lines of a paragraph, and characters of a line beyond which it is cut.
LINES = 6
LINE_CHARS = 400
# Share of a template's two-word runs that confirms it, in percent.
CONFIRM_PERCENT = 60

# Words that every notice holds, as a pattern.
CUES = (
    r"(?i)licen[cs]|permission|permitted|redistribut|copyright|unencumbered|public domain"
    r"|\b(a|l)?gpl|\bcc0|\bcc[ -]by|\bspdx|rights reserved|copying|as is|warrant"
)

# How the notices of each family begin or are worded, and what they call it.
SENTENCES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use "
     "this file except in compliance with the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy "
     "of this software and associated documentation files"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software "
     "Foundation; either version 2 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and "
     "related rights under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any "
     "purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without "
     "permission."),
)
NAMES = (
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "MIT License"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GPL version 3"),
    ("GPL-3.0", "GPLv3 license"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GPL version 2"),
    ("GPL-2.0", "GPLv2 license"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LGPL version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AGPL version 3"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "New BSD License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("ISC", "ISC License"),
)
TEMPLATES = (
    *SENTENCES,
    *NAMES,
    *(
        (family, f"SPDX-License-Identifier: {family}")
        for family in dict.fromkeys(family for family, _ in (*NAMES, ("Unlicense", "")))
    ),
)

# How a family is granted; the classifier learns each name within these.
GRANTS = (
    "Released under the {}.",
    "This project is licensed under the {}",
    "Distributed under the terms of the {} or later; see the file COPYING.",
    "You may use, copy and share this code as the {} allows.",
)

# Sentences with the words of licences that grant nothing.
NOT_LICENCES = (
    "The driver lost his license after the accident.",
    "She studied at MIT and works on version 3 of the software.",
    "The Apache helicopter landed near the public road.",
    "He released the file under pressure from the public.",
    "The general public may visit the work free of charge.",
    "A new version of the program was released in May.",
    "Please renew your driving licence before the end of the month.",
    "The source code is open and the terms are fair.",
    "Creative people work in the commons of the town.",
    "No permission was needed to use the copy of the book.",
    "The licence fee pays for public television.",
    "Version 2.0 of the form is subject to review.",
    "They compared several software licenses in a survey.",
    "The rights of the author are discussed in chapter 4.",
    "Copies of this work are sold under the old name.",
    "The museum is licensed to sell food and drink.",
    "All rights reserved.",
    "The permission of the owner is needed to enter the public domain of the park.",
    "Version 3 of the general report was published under the terms of the free press.",
    "A copy of the software is sold as is, without a warranty, for any purpose.",
    "They compared the MIT License and the BSD 3-Clause License in a survey.",
    "The article tells the history of the GNU General Public License and the Apache License.",
)


@dataclass(frozen=True)
class Classifier:
    """Weights of each run by class, the classes' intercepts, and the least probability."""

    classes: tuple[str, ...]
    weights: DataFrame  # gram, weights
    intercepts: tuple[float, ...]
    threshold: float


def grams(words: Column) -> Column:
    """Distinct runs of one and two words."""
    return F.array_distinct(F.concat(words, pairs(words)))


def pairs(words: Column) -> Column:
    """Runs of two words in their order."""
    both = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)),
    )
    return F.when(F.size(words) > 1, both).otherwise(F.array().cast("array<string>"))


def _pair_hashes(words: Column) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i)),
    )
    return F.when(F.size(words) > 1, hashes).otherwise(F.array().cast("array<bigint>"))


def licence_words(text: Column) -> Column:
    """Normalised words; the two spellings of licence are one."""
    return normalised_words(F.regexp_replace(text, "(?i)licence", "license"))


def best_gains(classifier: Classifier) -> tuple[list[tuple[int, float]], float]:
    """(hash, gain) of every run of one or two words that has weights, and the gain that is needed.

    The gain of a run is the most that it speaks for any family over "unknown", rounded up. Only where the gains of
    a paragraph reach what the intercepts ask for can its likeliest class be a family. Bounded by the
    vocabulary of the training table.
    """
    unknown = classifier.classes.index(UNKNOWN)
    words = F.split("gram", " ")
    code = F.xxhash64(F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    others = F.filter("weights", lambda _, k: k != unknown)
    gain = F.array_max(others) - F.get("weights", F.lit(unknown))
    known = classifier.weights.select(code.alias("code"), gain.alias("gain")).collect()
    most = max(z for k, z in enumerate(classifier.intercepts) if k != unknown)
    # Less by what sums in another order may differ by.
    needed = classifier.intercepts[unknown] - most - 1e-6
    return [(row["code"], math.ceil(row["gain"] * 10_000) / 10_000) for row in known], needed


def _numbers_and_gains(known: list[tuple[int, float]]) -> tuple[Callable[[Column], Column], Column]:
    """The numbers of those of some hashes that are known, and the gains by number.

    Spark finds a constant key in a set at once, but its value in a map only by going through it. So the
    hashes lie in slots by their remainder, few in each.
    """
    slots: list[list] = [[] for _ in range(len(known) + 1)]
    for number, (code, _) in enumerate(known):
        slots[code % len(slots)].append({"code": code, "number": number})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<code:bigint,number:int>>>")
    gains = F.from_json(F.lit(json.dumps([gain for _, gain in known])), "array<double>")

    def numbers(codes: Column) -> Column:
        def of(code: Column) -> Column:
            slot = F.get(table, F.pmod(code, F.lit(len(slots))).cast("int"))
            return F.transform(F.filter(slot, lambda one: one["code"] == code), lambda one: one["number"])

        return F.flatten(F.transform(codes, of))

    return numbers, gains


def paragraphs(
    documents: DataFrame, classifier: Classifier, *, id_col: str, text_col: str
) -> DataFrame:
    """row (of the table), doc_id, unit (its first), n_units, paragraph (line, from 0), text, words.

    Every run of adjacent lines is judged, whatever it says. Returned are those of at least two words that
    the classifier may give a family. The sum of the gains (``best_gains``) of a run's words and pairs,
    each taken once, is no less than its score for any family; a line from which on no such sum reaches
    what is needed begins "unknown" paragraphs only.
    """
    known, needed = best_gains(classifier)
    numbers, gains = _numbers_and_gains(known)
    rows = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("whole"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    most = f".{{1,{LINE_CHARS}}}"
    units = F.flatten(
        F.transform(
            F.split("whole", "\n"),
            lambda line, i: F.transform(
                F.when(F.length(line) <= LINE_CHARS, F.array(line)).otherwise(
                    F.regexp_extract_all(line, F.lit(rf"(?s){most}(?=\s|$)|{most}"), F.lit(0))
                ),
                lambda part: F.struct(
                    i.alias("line"), part.alias("text"), licence_words(part).alias("words")
                ),
            ),
        )
    )
    rows = rows.select("row", "doc_id", units.alias("units"))

    def said(unit: Column, i: Column) -> Column:
        """Numbers of what a unit says itself, and of the pair over the cut before it."""
        words = unit["words"]
        # The hash of the last word alone comes a second time.
        codes = F.array_distinct(
            F.concat(
                F.transform(words, lambda word: F.xxhash64(word)),
                F.transform(words, lambda word, j: F.xxhash64(word, F.get(words, j + 1))),
            )
        )
        last = F.try_element_at(F.get("units", i - 1)["words"], F.lit(-1))
        over = F.xxhash64(last, F.get(words, F.lit(0)))
        both = F.transform(F.array(codes, F.array(over)), numbers)
        return F.struct(both.alias("numbers"), (F.size(words) > 0).alias("worded"))

    def with_most(one: Column) -> Column:
        most = F.aggregate(
            F.flatten(one["numbers"]), F.lit(0.0), lambda so_far, k: so_far + F.greatest(F.get(gains, k), F.lit(0.0))
        )
        return F.struct(one["numbers"].alias("numbers"), one["worded"].alias("worded"), most.alias("most"))

    # Columns that a function reads for each element are named twice, so that Spark keeps them apart.
    rows = rows.withColumn("said", F.transform(F.transform("units", said), with_most))

    def able(unit: Column, i: Column) -> Column:
        """The runs from a unit on, if any beginning of the longest can have a family."""
        run = F.slice("said", i + 1, LINES)
        blank = F.array_position(F.transform(run, lambda one: one["worded"]), False)
        together = F.when(blank > 0, blank - 1).otherwise(F.size(run)).cast("int")
        longest = F.slice("said", i + 1, together)
        # Less than this sum with all repeats, and without what speaks against, is soon ruled out.
        bound = F.aggregate(longest, F.lit(0.0), lambda so_far, one: so_far + one["most"])
        held = F.transform(
            longest,
            lambda one, j: F.when(j == 0, F.get(one["numbers"], F.lit(0))).otherwise(
                F.flatten(one["numbers"])
            ),
        )

        def added(so_far: Column, number: Column) -> Column:
            total = so_far["total"] + F.get(gains, number)
            return F.struct(total.alias("total"), F.greatest(so_far["most"], total).alias("most"))

        nothing = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
        # Distinct numbers keep the order in which they come first, so each run is a beginning of these.
        most = F.aggregate(F.array_distinct(F.flatten(held)), nothing, added, lambda sums: sums["most"])
        none = F.array().cast("array<struct<unit:int,n_units:int>>")
        each = F.transform(
            F.sequence(F.lit(1), together), lambda n: F.struct(i.alias("unit"), n.alias("n_units"))
        )
        return F.when(unit["worded"] & (bound >= needed) & (most >= needed), each).otherwise(none)

    # The outer form keeps Spark from building the array a second time to test it.
    each = rows.select(
        "row", "doc_id", "units", F.explode_outer(F.flatten(F.transform("said", able))).alias("begin")
    ).filter(F.col("begin").isNotNull())
    unit, n_units = F.col("begin.unit"), F.col("begin.n_units")
    joined = each.select(
        "row",
        "doc_id",
        unit.alias("unit"),
        n_units.alias("n_units"),
        F.get("units", unit)["line"].alias("paragraph"),
        F.concat_ws("\n", F.transform(F.slice("units", unit + 1, n_units), lambda one: one["text"])).alias("text"),
    )
    return joined.withColumn("words", licence_words(F.col("text"))).filter(F.size("words") > 1)


def background_lines(documents: DataFrame, *, text_col: str, most_rows: int) -> DataFrame:
    """hash, text, words: distinct lines without a cue, those of smallest hash, at most ``most_rows``.

    The choice depends on the lines alone, not on their order or layout.
    """
    text = text_of(text_col)
    n_lines = documents.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0]
    lines = documents.select(F.explode(F.split(text, "\n")).alias("text"))
    lines = lines.filter((F.length("text") <= LINE_CHARS) & ~F.col("text").rlike(CUES))
    lines = lines.withColumn("hash", F.xxhash64("text"))
    # Several times as many as wanted are made distinct, however many lines there are.
    share = min(1.0, 8 * most_rows / max(n_lines or 0, 1))
    drawn = lines.filter(F.pmod("hash", F.lit(1 << 40)) < int(share * (1 << 40)))
    chosen = drawn.groupBy("hash").agg(F.min("text").alias("text"))
    words = licence_words(F.col("text"))
    return (
        chosen.orderBy(F.pmod("hash", F.lit(1 << 40)), "hash")
        .limit(most_rows)
        .select("hash", "text", words.alias("words"))
        .filter(F.size("words") > 1)
    )


def template_table(spark: SparkSession, templates) -> DataFrame:
    rows = [(number, family, text) for number, (family, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, family string, text string")
    words = licence_words(F.col("text"))
    return table.withColumn("words", words).withColumn(
        "hashes", F.array_distinct(_pair_hashes(F.col("words")))
    )


def _fit(table: DataFrame, classes: tuple[str, ...]) -> tuple[DataFrame, tuple[float, ...]]:
    """Weights (gram, weights by class) and intercepts of a multinomial logistic regression."""
    numbers = {name: number for number, name in enumerate(classes)}
    label = F.lit(0.0)
    for name, number in numbers.items():
        label = F.when(F.col("family") == name, float(number)).otherwise(label)
    # Every class weighs the same in all.
    sizes = table.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    rows = table.join(sizes, "family").select("example", "grams", label.alias("label"), (1 / F.col("n")).alias("weight"))
    # Only runs of the labelled sentences can speak for or against a family.
    said = table.filter(~F.col("sampled")).select(F.explode("grams").alias("gram")).distinct()
    vocabulary = [row["gram"] for row in said.orderBy("gram").limit(MOST_VOCABULARY).collect()]
    if len(vocabulary) >= MOST_VOCABULARY:
        raise ValueError(f"the labelled sentences have {MOST_VOCABULARY} runs or more")
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counts = counts.setBinary(True)
    # A bounded table in one order, so that its sums are the same in every run.
    rows = rows.coalesce(1).sortWithinPartitions("example")
    model = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=0.002, maxIter=60, standardization=False
    ).fit(counts.transform(rows))
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    present = matrix.shape[0]
    weights = [
        (gram, [float(matrix[k, j]) if k < present else 0.0 for k in range(len(classes))])
        for j, gram in enumerate(vocabulary)
    ]
    spark = table.sparkSession
    return (
        store(spark.createDataFrame(weights, "gram string, weights array<double>"), "licence-weights"),
        tuple(float(intercepts[k]) if k < present else 0.0 for k in range(len(classes))),
    )


def classify(
    rows: DataFrame, keys: list[str], classes: tuple[str, ...], weights: DataFrame, intercepts
) -> DataFrame:
    """``rows`` have ``keys`` and grams; adds family (the likeliest class) and probability.

    The weights are bounded by the vocabulary of the training table.
    """
    each = rows.select(*keys, F.explode("grams").alias("gram")).join(
        F.broadcast(weights), "gram", "left"
    )
    sums = [
        (F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0.0)) + intercepts[k]).alias(f"z{k}")
        for k in range(len(classes))
    ]
    scored = each.groupBy(*keys).agg(*sums)
    scored = scored.withColumn(
        "best",
        F.array_max(
            F.array(
                *[F.struct(F.col(f"z{k}").alias("z"), F.lit(name).alias("name")) for k, name in enumerate(classes)]
            )
        ),
    )
    total = sum((F.exp(F.col(f"z{k}") - F.col("best.z")) for k in range(1, len(classes))), F.exp(F.col("z0") - F.col("best.z")))
    return scored.select(*keys, F.col("best.name").alias("family"), (1 / total).alias("probability"))


def labelled_sentences(context: list[str], templates, names) -> list[tuple[str, str, bool]]:
    """(family, text, left_out): every labelled sentence alone, and among other words.

    Left out of the first training are, of the names, a grant of its own, and of the others a
    beginning of its own: the calibration sees wordings that the training did not.
    """
    plain = [(family, text, False) for family, text in templates]
    plain += [
        (family, grant.format(name), number == len(GRANTS) - 1)
        for family, name in names
        for number, grant in enumerate(GRANTS)
    ]
    plain += [(UNKNOWN, text, False) for text in NOT_LICENCES]
    around = [line[:200] for line in context] or [""]
    varied = []
    for number, (family, text, left_out) in enumerate(plain):
        before, after = around[2 * number % len(around)], around[(2 * number + 1) % len(around)]
        varied += [
            (family, text, left_out),
            (family, f"Note: {text} See the file for details.", left_out),
            (family, f"{before}\n{text} {after}", left_out),
            (family, f"Code and data: {text}", True),
        ]
    return varied


def train(
    spark: SparkSession, background: DataFrame, templates=TEMPLATES, names=NAMES
) -> Classifier:
    """Train on templates, on names within grants, on sentences that grant nothing, on background.

    ``background``: hash, text, words; a bounded sample of lines without a cue. As many as there are
    labelled sentences also stand around these.
    """
    classes = (*sorted({family for family, _ in (*templates, *names)}), UNKNOWN)
    most = 2 * (len(templates) + len(names) * len(GRANTS) + len(NOT_LICENCES))
    context = [row["text"] for row in background.orderBy("hash").limit(most).collect()]
    table = spark.createDataFrame(
        labelled_sentences(context, templates, names), "family string, text string, left_out boolean"
    )
    table = table.withColumn("words", licence_words(F.col("text"))).withColumn("sampled", F.lit(False))
    sample = background.select(
        F.lit(UNKNOWN).alias("family"),
        "text",
        (F.pmod(F.col("hash"), F.lit(4)) == 3).alias("left_out"),
        "words",
        F.lit(True).alias("sampled"),
    )
    both = store(
        table.unionByName(sample)
        .withColumn("grams", grams(F.col("words")))
        .withColumn("example", F.monotonically_increasing_id()),
        "licence-table",
    )
    first = _fit(both.filter(~F.col("left_out")), classes)
    left_out = both.filter("left_out")
    said = classify(left_out.select("example", "grams"), ["example"], classes, *first)
    judged = said.withColumnRenamed("family", "said").join(
        left_out.select("example", "family"), "example"
    )
    named = F.col("said") != UNKNOWN
    agrees = F.col("said") == F.col("family")
    worst, least = judged.agg(
        F.max(F.when(named & (F.col("family") == UNKNOWN), F.col("probability"))),
        F.min(F.when(named & agrees, F.col("probability"))),
    ).first()
    middle = ((worst or 0.0) + (least or 1.0)) / 2
    weights, intercepts = _fit(both, classes)
    return Classifier(classes, weights, intercepts, min(max(middle, 0.3), 0.9))


def train_on(
    documents: DataFrame,
    *,
    text_col: str = "text",
    templates=TEMPLATES,
    names=NAMES,
    background_rows: int = BACKGROUND_ROWS,
) -> Classifier:
    """A classifier whose class "unknown" is shaped by lines of these documents."""
    sample = background_lines(documents, text_col=text_col, most_rows=background_rows)
    sample = store(sample, "licence-background")
    return train(documents.sparkSession, sample, templates, names)


def scan(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    names=NAMES,
    percent: int = CONFIRM_PERCENT,
    background_rows: int = BACKGROUND_ROWS,
    classifier: Classifier | None = None,
) -> DataFrame:
    """One row per paragraph that states a licence: doc_id, paragraph (its first line), n_units
    (lines or parts of long ones), family, probability, similarity (share of the likest template's
    two-word runs) and text.

    A paragraph goes where one that overlaps it is more similar; of equals the shortest stays, then
    the first. Classes of equal probability go by name. Whole texts are read, also very long ones
    and long lines; null and empty texts have no paragraphs. Null ids stay null, repeated rows give
    the same result twice, other columns are not read, an empty table gives no rows. The background
    is at most ``background_rows`` lines; it shapes the classifier's class "unknown". Every paragraph is
    judged, with a cue or without.
    """
    spark = documents.sparkSession
    if classifier is None:
        classifier = train_on(
            documents, text_col=text_col, templates=templates, names=names, background_rows=background_rows
        )
    table = store(template_table(spark, templates), "licence-templates")
    possible = paragraphs(documents, classifier, id_col=id_col, text_col=text_col)
    possible = store(
        possible.withColumn("hashes", F.array_distinct(_pair_hashes(F.col("words")))).withColumn(
            "grams", grams(F.col("words"))
        ).drop("words"),
        "licence-possible",
    )
    place = ["row", "unit", "n_units"]
    named = classify(
        possible.select(*place, "grams"), place, classifier.classes, classifier.weights, classifier.intercepts
    ).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= classifier.threshold))
    shapes = table.groupBy(F.col("family").alias("t_family")).agg(
        F.collect_list("hashes").alias("templates")
    )
    share = F.array_max(
        F.transform("templates", lambda t: F.size(F.array_intersect("hashes", t)) / F.size(t))
    )
    confirmed = (
        named.join(possible.drop("grams"), place)
        .join(F.broadcast(shapes), F.col("family") == F.col("t_family"))
        .withColumn("similarity", share)
        .filter(F.col("similarity") * 100 >= percent)
        .drop("hashes", "templates", "t_family")
    )
    # At most LINES paragraphs begin in a unit, so a frame is small however long the text is.
    near = Window.partitionBy("row").orderBy("unit").rangeBetween(1 - LINES, LINES - 1)
    rank = F.struct(
        F.col("similarity"), (-F.col("n_units")).alias("size"), (-F.col("unit")).alias("begin")
    )
    ranked = confirmed.withColumn("rank", rank)
    others = ranked.withColumn("others", F.collect_list("rank").over(near))
    better = F.exists(
        "others",
        lambda other: (other > F.col("rank"))
        & (-other["begin"] < F.col("unit") + F.col("n_units"))
        & (F.col("unit") < -other["begin"] - other["size"]),
    )
    return others.filter(~better).select(
        "doc_id",
        F.col("paragraph").cast("bigint").alias("paragraph"),
        F.col("n_units").cast("bigint").alias("n_units"),
        "family",
        "probability",
        "similarity",
        "text",
    )
