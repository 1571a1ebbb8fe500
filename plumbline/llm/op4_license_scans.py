"""Licence scan, in DataFrame operations only: a trained paragraph classifier, calibrated and confirmed by templates.

1. A paragraph is a run of lines that are not blank, without list numbers and comment marks, so that wrapped notices are
   whole. It is scored as a whole, and so is each of its lines, as lines may name different licences. Of more than
   three blocks of BLOCK words the surroundings (three blocks) of each block with a word of CUES are scored.
   More than 1 - CONFIRM of each notice's bigrams have such a word, so what has none cannot be confirmed.
2. Word unigrams and bigrams are hashed to sparse vectors. A multinomial logistic regression tells the licence
   families and the class `unknown` apart. It learns from pieces of the notices below, plain and amid prose, and for
   `unknown` from DECOYS and from a bounded sample of paragraphs of the corpus (about PROSE documents).
3. On a fifth of these rows, which takes no part in fitting, the largest probability is calibrated (Platt scaling with
   smoothed targets). A paragraph whose calibrated probability of being right is under one half is `unknown`.
4. A prediction is confirmed if at least CONFIRM of the word bigrams of one of the family's notices are in the
   paragraph, and OWN of those that no other family's notices have ("public license, version 2.0" alone names none). A family's notices of a run are those of its lines or those of the whole run, whichever are more; places
   that overlap count once. Lines with a word of TRIGGER that are in no confirmed place count as unknown notices.

Cases: null, empty and blank texts hold no notice; a text may hold notices of several families; rows that share a
doc_id share their findings; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words_of

BLOCK = 20
FEATURES = 1 << 13
#: Bound of the corpus sample that teaches `unknown` (expected documents).
PROSE = 1500
CONFIRM = 0.6
#: The share of a notice's bigrams which no other family has that confirms it.
OWN = 0.5
UNKNOWN = "unknown"
#: Words that speak of licences: without a confirmed notice they make an unknown one.
TRIGGER = r"(?i)licen[cs]|lizenz|copyright|copyleft|spdx|warrant|permission|redistribut|commons|gnu|\bgpl|\bcc0|\bcc-by|public-domain"
#: With further words of the notices below: of each notice less than CONFIRM of the bigrams have none.
CUES = TRIGGER + r"|\b(?:apache|artistic|boost|bsd|cc|compliance|conditions|copy|development|distributed|distribution|domain|eclipse|eupl|european|except|hereby|identifier|law|mozilla|noncommercial|notice|person|provided|released|sharealike|should|software|source|substantial|terms|without|wtfpl|zlib)\b"
#: Comment marks and list numbers before a line's text, and what ends a comment.
MARKS = r"(?m)^[ \t]*(?:(?:/\*+|//+!?|\*+/?|#+|;+|--+|>+|%+|\|+|<!--+|[\u2022\u00b7\u2013-]+|(?:dnl|rem|REM)\b|\(?(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{1,4})[.)](?=[ \t]))[ \t]*){1,4}+|(?:\*/|-->)[ \t]*$"

# Wording of public licence notices.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright under the CC0 Public Domain Dedication."),
    ("unlicense", "This is free and unencumbered software released into the public domain under the Unlicense license."),
    ("unlicense", "Released under the Unlicense."),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("apache-2.0", "Released under the Apache 2 license."),
    ("epl", "Licensed under the Eclipse Public License, version 2.0."),
    ("epl", "Made available under the terms of the Eclipse Public License 2.0"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "SPDX-License-Identifier: BSL-1.0"),
    ("zlib", "Released under the zlib License."),
    ("zlib", "Provided as-is, without any express or implied warranty."),
    ("wtfpl", "Released under the WTFPL, version 2."),
    ("artistic", "Licensed under the Artistic License 2.0."),
    ("artistic", "SPDX-License-Identifier: Artistic-2.0"),
    ("cddl", "Licensed under the Common Development and Distribution License, version 1.0."),
    ("eupl", "Licensed under the EUPL, version 1.2."),
    ("eupl", "Licensed under the European Union Public License, version 1.2."),
]
#: Paragraphs with the words of notices that are none.
DECOYS = [
    "His driving licence was taken away for three months after the accident.",
    "The restaurant has no license to serve beer and wine.",
    "Please ask for permission before you enter the building.",
    "The police searched the house with a warrant signed by a judge.",
    "The phone comes with a two year warranty and a free case.",
    "Copyright 2021 by the authors. All rights reserved.",
    "No part of this publication may be reproduced without written permission of the publisher.",
    "The House of Commons met on Monday to discuss the budget.",
    "This software is proprietary and licensed to the customer under a separate agreement.",
    "Fishing licences are sold at the office near the lake.",
    "The tax redistributes income and the licence fee pays for television.",
    "Artistic license was used in the film about the king.",
    "A gnu is a large antelope that lives on the plains.",
    "Die Lizenz kostet zehn Euro im Monat und endet im Mai.",
    "La licencia de conducir se renueva cada cinco años.",
]


def ngrams(text: Column) -> Column:
    """Distinct word unigrams and bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.concat(words, _pairs(words)))


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def bigrams(text: Column) -> Column:
    spelled = F.regexp_replace(F.lower(text), "licence", "license")
    return F.array_distinct(_pairs(F.regexp_extract_all(spelled, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, run, line, b, at, told, paragraph for all places of all texts that may hold a notice.

    run names a run of lines of a text; line is the number in it, or -1 for the run as a whole; b is the block in the
    middle of the place and at the block of the run where the line begins; told says that the middle has a TRIGGER.
    """
    cleaned = docs.filter(F.col("text").rlike(CUES)).select("doc_id", F.xxhash64("text").alias("copy"), F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), MARKS, "").alias("text"))
    runs = cleaned.select("doc_id", "copy", F.posexplode(F.split("text", r"\n\s*\n")).alias("n", "whole")).filter(F.col("whole").rlike(CUES))
    lines = F.filter(F.transform(F.split("whole", "\n"), words_of), lambda w: F.size(w) > 0)
    named = runs.select("doc_id", F.struct("copy", "n").alias("run"), lines.alias("lines"))
    # the whole run stands before its lines, unless it is one line
    starts = F.aggregate("lines", F.array(F.lit(0)), lambda s, w: F.array_append(s, F.element_at(s, -1) + F.size(w)))
    each = F.transform("lines", lambda w, i: F.struct(i.alias("line"), F.floor(F.get(F.col("starts"), i) / BLOCK).cast("int").alias("at"), w.alias("words")))
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("at"), F.flatten("lines").alias("words")))
    parts = named.withColumn("starts", starts).select("doc_id", "run", F.inline(F.when(F.size("lines") > 1, F.concat(whole, each)).otherwise(each)))
    # blocks with a cue; of up to three blocks all is one place
    blocks = lambda cue: F.array_distinct(F.array_compact(F.transform("words", lambda w, i: F.when(w.rlike(cue), F.floor(i / BLOCK).cast("int")))))
    short = F.size("words") <= 3 * BLOCK
    found = parts.select("*", blocks(CUES).alias("cues"), blocks(TRIGGER).alias("triggers")).filter(F.size("cues") > 0)
    cut = found.select("*", F.explode(F.when(short, F.array(F.lit(0))).otherwise(F.col("cues"))).alias("b"))
    told = F.when(short, F.size("triggers") > 0).otherwise(F.array_contains("triggers", F.col("b")))
    return cut.select("doc_id", "run", "line", "b", "at", told.alias("told"), F.array_join(F.slice("words", F.greatest((F.col("b") - 1) * BLOCK, F.lit(0)) + 1, F.lit(3 * BLOCK)), " ").alias("paragraph"))


def _notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "family string, notice string")


def training_rows(docs: DataFrame) -> DataFrame:
    """family, paragraph, fold: pieces of notices, decoys and a bounded sample of prose."""
    spark = docs.sparkSession
    n = docs.count()
    drawn = docs.filter((F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, PROSE / max(1, n)))) & ~F.col("text").rlike(TRIGGER))
    words = drawn.select("doc_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.size("words")).cast("int")
    prose = materialize(words.select("doc_id", F.slice("words", start + 1, F.lit(2 * BLOCK)).alias("words")), "prose")
    # pieces of at least six tenths of a notice, so that each still says which family it is of
    whole = _notices(spark).select("family", F.split("notice", " ").alias("w"))
    length = F.greatest(F.ceil(F.size("w") * 0.6), F.least(F.size("w"), F.lit(4))).cast("int")
    cut = whole.select("family", "w", F.explode(F.sequence(length, F.size("w"))).alias("n")).select("family", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("s"))
    pieces = cut.filter("n = size(w) or (n + s) % 3 = 0").select("family", F.slice("w", F.col("s"), F.col("n")).alias("w"))
    pieces = pieces.union(spark.createDataFrame([(UNKNOWN, d) for d in DECOYS], "family string, notice string").select("family", F.split("notice", " ")))
    # each piece also stands amid prose: a number links it with one of 97 stretches of the sample
    some = prose.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(97)).alias("k")).agg(F.min_by("words", "doc_id").alias("p"))
    keyed = pieces.withColumn("k", F.pmod(F.xxhash64(F.array_join("w", " ")), F.lit(97)))
    amid = keyed.join(F.broadcast(some), "k").select("family", F.concat(F.slice("p", 1, 15), "w", F.slice("p", 16, 15)).alias("w"))  # `some` has 97 rows at most
    rows = pieces.union(amid).union(prose.select(F.lit(UNKNOWN), "words"))
    return rows.select("family", F.array_join("w", " ").alias("paragraph")).distinct().withColumn("fold", F.pmod(F.xxhash64("paragraph", "family"), F.lit(5)))


class Classifier:
    """The regression, its classes and the calibration of its largest probability."""

    def __init__(self, rows: DataFrame):
        self.classes = sorted({f for f, _ in NOTICES} | {UNKNOWN})
        self.hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("family")) - 1
        featured = self.hashing.transform(rows.withColumn("terms", ngrams(F.col("paragraph"))).withColumn("label", place.cast("double")))
        self.model = LogisticRegression(family="multinomial", regParam=3e-4, maxIter=40).fit(featured.filter("fold <> 0").select("features", "label").coalesce(2))
        held = self._raw(featured.filter("fold = 0")).select(F.col("x"), (F.col("place") == F.col("label")).alias("right"))
        # Platt's smoothed targets as weights of both outcomes
        sums = held.agg(F.count_if("right").alias("n1"), F.count_if(~F.col("right")).alias("n0"))
        target = F.when(F.col("right"), (F.col("n1") + 1) / (F.col("n1") + 2)).otherwise(1 / (F.col("n0") + 2))
        both = held.crossJoin(F.broadcast(sums)).select("x", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight")))).alias("t"))  # `sums` is one row
        platt = LogisticRegression(weightCol="weight", maxIter=60).fit(both.select(array_to_vector(F.array("x")).alias("features"), "t.label", "t.weight").coalesce(2))
        self.slope, self.shift = max(0.0, float(platt.coefficients[0])), float(platt.intercept)

    def _raw(self, featured: DataFrame) -> DataFrame:
        """Adds place and x: the likeliest class and the log odds of its probability."""
        p = vector_to_array("probability")
        told = self.model.transform(featured).withColumn("place", F.col("prediction")).withColumn("best", F.array_max(p))
        return told.withColumn("best", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("best")))).withColumn("x", F.ln(F.col("best") / (1 - F.col("best"))))

    def predicted(self, rows: DataFrame) -> DataFrame:
        """Adds family (`unknown` unless it is surer right than wrong) and score to rows with a paragraph."""
        told = self._raw(self.hashing.transform(rows.withColumn("terms", ngrams(F.col("paragraph")))))
        score = 1 / (1 + F.exp(-(self.slope * F.col("x") + self.shift)))
        name = F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("place").cast("int"))
        return told.select(*rows.columns, F.when(score >= 0.5, name).otherwise(F.lit(UNKNOWN)).alias("family"), score.alias("score"))


def confirmed(predicted: DataFrame) -> DataFrame:
    """Adds share: the largest share of a notice of the predicted family that the paragraph holds, with OWN of what only this family's notices have of it."""
    grams = _notices(predicted.sparkSession).select("family", "notice", bigrams(F.col("notice")).alias("g"))
    owners = grams.select("family", F.explode("g").alias("x")).groupBy("x").agg(F.count_distinct("family").alias("n"), F.min("family").alias("family"))
    own = owners.filter("n = 1").groupBy("family").agg(F.collect_set("x").alias("only"))
    grams = grams.groupBy("family").agg(F.collect_list("g").alias("notices")).join(own, "family", "left")
    told = predicted.join(F.broadcast(grams), "family", "left").withColumn("own", bigrams(F.col("paragraph")))  # one row for each family
    named = lambda g: F.array_intersect(g, F.col("only"))
    held = lambda g: (F.size(named(g)) > 0) & (F.size(F.array_intersect(named(g), F.col("own"))) >= OWN * F.size(named(g)))
    share = F.array_max(F.transform(F.col("notices"), lambda g: F.when(held(g), F.size(F.array_intersect(g, F.col("own"))) / F.size(g)).otherwise(0.0)))
    return told.select(*predicted.columns, F.coalesce(share, F.lit(0.0)).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, licences, n_notices, n_unknown, score for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(paragraphs(docs), "paragraphs")
    told = confirmed(Classifier(materialize(training_rows(docs), "training")).predicted(found))
    sure = (F.col("family") != UNKNOWN) & (F.col("share") >= CONFIRM)
    told = materialize(told.select("doc_id", "run", "line", "b", "at", "told", "family", "share", "score", sure.alias("sure")), "told")
    # places of three blocks that do not overlap, from the first on
    apart = F.aggregate(F.array_sort(F.collect_set("b")), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, x: F.when(x - s["last"] > 2, F.struct((s["n"] + 1).alias("n"), x.alias("last"))).otherwise(s))["n"]
    places = told.filter("sure").groupBy("doc_id", "run", "line", "family").agg(apart.alias("n"), F.max(F.struct("share", "score")).alias("best"), F.max("score").alias("score"))
    n = F.greatest(F.coalesce(F.sum(F.when(F.col("line") >= 0, F.col("n"))), F.lit(0)), F.coalesce(F.max(F.when(F.col("line") < 0, F.col("n"))), F.lit(0)))
    notices = places.groupBy("doc_id", "run", "family").agg(n.alias("n"), F.max("best").alias("best"), F.max("score").alias("score"))
    # a line's place is unknown unless a confirmed place of the whole run is there
    asked = F.collect_list(F.when(~F.col("sure") & F.col("told") & (F.col("line") >= 0), F.col("at") + F.col("b")))
    met = F.collect_set(F.when(F.col("sure") & (F.col("line") < 0), F.col("b")))
    unknown = told.groupBy("doc_id", "run").agg(asked.alias("asked"), met.alias("met")).select("doc_id", F.size(F.filter("asked", lambda x: ~F.exists("met", lambda y: F.abs(x - y) <= 1))).alias("n_unknown"))
    by_doc = notices.groupBy("doc_id").agg(
        F.max_by("family", F.struct("best", "family")).alias("licence"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"),
        F.sum("n").alias("n_notices"),
        F.max("score").alias("score"),
    )
    by_doc = by_doc.join(unknown.groupBy("doc_id").agg(F.sum("n_unknown").alias("n_unknown")), "doc_id", "full")
    rows = docs.select("doc_id").join(by_doc, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("licence", F.lit("none")).alias("licence"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
