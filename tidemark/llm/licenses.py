"""License scans: a trained classifier that templates confirm, in DataFrame operations only.

Neighbouring lines that aren't blank are a paragraph, cut into words. Of a
paragraph that has an anchor of some template, the bigrams that templates hold
are listed with their places; only paragraphs with enough of one template's
bigrams go on. In these, windows from each bigram found, as long as the
template and as long as the longest example made of it, hold notices that may
be wrapped, follow each other or lie within long text.

A window's word n-grams (one to three words) are hashed to a sparse vector
and a multinomial logistic regression names a licence family or ``unknown``.
It is trained on notices made here from a few templates for each family and
from prose and notices that name no known licence, with seeded changes. Each
family's probability is taken against that of ``unknown`` alone, so that
several can count in one window; an isotonic regression on a held-out part of
the examples turns it into the share of such windows that do name the family,
and one below ``SURE`` is unknown.

A family is then confirmed by comparing the window with its template: the share
of the template's bigrams that it holds is ``CONFIRMED`` or more, and against
each kindred template of another family (one that shares half its bigrams) the
window holds a bigram that only this one has: "version 3" where another has
"version 2", "gnu general" where another has "gnu affero". A family whose
bigrams found are all part of another's that is found there isn't reported.

A template is confirmed by a share of its bigrams, so a paragraph without any of
some of its words (``anchors``) can't reach that share; paragraphs without an
anchor of any template are unknown at once, which changes no result.

Defined results: a null text has no paragraphs; blank paragraphs are skipped;
a paragraph of several families gets each; of overlapping windows of a family
the one of highest confirmation, then the shortest and first, is reported, so
equal lines in one document are reported each. ``paragraph`` is the number of
the line that holds the first word of the window. Rows of equal id are one
document with the notices of all.
"""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import keep

#: Public names and usual wordings of licence notices.
TEMPLATES = {
    "apache-2.0": ["licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["released under the MIT license", "licensed under the MIT license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "SPDX-License-Identifier: MIT"],
    "gpl": ["licensed under the GNU General Public License", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl-3.0": ["licensed under the GNU General Public License version 3", "licensed under the GNU General Public License v3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0"],
    "gpl-2.0": ["licensed under the GNU General Public License version 2", "licensed under the GNU General Public License v2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl-3.0": ["licensed under the GNU Affero General Public License version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0"],
    "bsd": ["licensed under the BSD 3-clause license", "licensed under the BSD license", "released under the BSD license", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "mpl-2.0": ["this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nc-sa": ["licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nd": ["licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc0": ["released under CC0 1.0 Universal Public Domain Dedication", "to the extent possible under law, the author has waived all copyright and related rights to this work", "SPDX-License-Identifier: CC0-1.0"],
}
UNKNOWN = "unknown"
#: Notices that name no known licence.
OTHERS = ["all rights reserved no part of this work may be reproduced", "see the license for details", "licensed to you under our terms of service", "a license fee applies to every commercial use", "this software is licensed not sold", "copyright by the authors", "driving license office opening hours", "the general public is free to visit under these terms", "licensed under the terms of the contract", "permission is granted to the staff to enter the building free of charge"]
#: Words that are frequent in prose; anchors are taken from others first.
FREQUENT = set("the of and to in is that for with this was on are by from as it be or an at not have which under work other following without person these terms after public".split())
FEATURES = 1 << 14
SEED, EXAMPLES, SURE, CONFIRMED = 5, 40, 0.5, 0.7
#: The most words around a template in an example.
AROUND = 18


def told(text: str) -> list[str]:
    """The words of a template, as ``words`` cuts them."""
    return re.findall(r"[^\W\d_]+[0-9]*|[0-9]+(?:\.[0-9]+)*", text.lower())


def bigrams(template: str) -> set[str]:
    own = told(template)
    return {f"{a} {b}" for a, b in zip(own, own[1:])}


def anchors(template: str) -> set[str]:
    """Words without all of which fewer than CONFIRMED of the template's bigrams are left; long and rare ones first."""
    left, whole, taken = bigrams(template), len(bigrams(template)), set()
    for word in sorted(set(told(template)), key=lambda w: (w in FREQUENT, -len(w), w)):
        if len(left) < CONFIRMED * whole:
            break
        taken.add(word)
        left = {pair for pair in left if word not in pair.split()}
    return taken


def musts(family: str, template: str) -> list[list[str]]:
    """For each kindred template of another family, the bigrams that only this one has, those where the other goes on differently if there are any: a window must hold one of each list."""
    own, found = bigrams(template), set()
    for name, texts in TEMPLATES.items():
        for other in map(bigrams, texts):
            if name != family and own - other and 2 * len(own & other) >= min(len(own), len(other)):
                forks = {a for a in own - other if any(b.split()[0] == a.split()[0] for b in other - own)}
                found.add(tuple(sorted(forks or own - other)))
    return [list(one) for one in sorted(found)]


def has_anchor(text: Column) -> Column:
    """Whether a text holds an anchor of any template; the text is lower-cased once."""
    found = {word for texts in TEMPLATES.values() for text in texts for word in anchors(text)}
    held = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(word)) for word in sorted(found)])
    return F.get(F.transform(F.array(F.lower(text)), held), 0)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a dot stays inside a number."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+[0-9]*|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def grams(found: Column, n: int) -> Column:
    """Runs of ``n`` words."""
    shifted = [F.slice(found, k + 1, F.greatest(F.size(found) - n + 1, F.lit(0))) for k in range(n)]
    if n == 1:
        return found
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    return F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(n)]))


def _vectors(rows: DataFrame) -> DataFrame:
    """Add ``grams`` and the sparse ``features`` to rows that have ``words``."""
    named = rows.withColumn("grams", F.concat(*[grams(F.col("words"), n) for n in (1, 2, 3)]))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(named)


def examples() -> list[tuple[str, str, bool]]:
    """Made notices: text, family, whether for calibration. Their number is bounded by EXAMPLES for each template."""
    rng = random.Random(SEED)
    prose = "the of and to in is that for with this was on are by from as it be or an at not have which some more other time people about over years after work where most".split()
    made = []
    for family, texts in {**TEMPLATES, UNKNOWN: OTHERS}.items():
        for text in texts:
            for k in range(EXAMPLES):
                parts = told(text)
                if k and rng.random() < 0.5:
                    parts = [w for w in parts if rng.random() > 0.05]
                before = rng.choices(prose, k=rng.choice((0, 0, 2, 6)))
                after = rng.choices(prose, k=rng.choice((0, 0, 3, 12)))
                made.append((" ".join([*before, *parts, *after]), family, k % 4 == 3))
    for k in range(EXAMPLES * 8):
        made.append((" ".join(rng.choices(prose, k=rng.randint(1, 40))), UNKNOWN, k % 4 == 3))
    return made


def train(spark: SparkSession) -> tuple[LogisticRegressionModel, list[str], IsotonicRegressionModel]:
    """The model, its families by index, and the calibration of a family's probability against unknown alone."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows = spark.createDataFrame([(t, families.index(f), c) for t, f, c in examples()], "text string, label int, calibrate boolean").coalesce(1)
    rows = _vectors(rows.withColumn("words", words(F.col("text")))).select("features", "label", "calibrate").cache()
    model = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial").fit(rows.where("not calibrate").withColumn("label", F.col("label").cast("double")))
    odds = vector_to_array(F.col("probability"))
    last = len(families) - 1
    each = model.transform(rows.where("calibrate")).select("label", F.get(odds, F.lit(last)).alias("none"), F.posexplode(F.slice(odds, 1, last)).alias("family", "odd"))
    # Of the families of an example those count that the model prefers to unknown or that it does name.
    shown = each.select((F.col("odd") / (F.col("odd") + F.col("none"))).alias("raw"), (F.col("label") == F.col("family")).cast("double").alias("right")).where("right = 1 or raw > 0.5")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="right", predictionCol="probability").fit(shown)
    rows.unpersist()
    return model, families, calibration


def _templates(spark: SparkSession) -> DataFrame:
    """A row for each bigram of each template: its number, family, words' number, bigrams' number and musts. A few hundred rows, whatever the input."""
    rows = [(pair, k, family, len(told(text)), len(bigrams(text)), musts(family, text)) for k, (family, text) in enumerate((f, t) for f, texts in TEMPLATES.items() for t in texts) for pair in sorted(bigrams(text))]
    return spark.createDataFrame(rows, "pair string, template int, licence string, length int, total int, musts array<array<string>>")


def _paragraphs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, p, words, at``: the words of each paragraph with an anchor, and the number of each word's line."""
    lines = df.where(has_anchor(F.col(text))).select(F.col(doc_id).alias("doc_id"), F.split(text, "\n", -1).alias("lines"))
    full = lines.withColumn("full", F.transform("lines", lambda line: line.rlike(r"\S")))
    at = lambda k: F.coalesce(F.get("full", k), F.lit(False))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    bounds = full.withColumn("first", F.filter(numbers, lambda k: at(k) & ~at(k - 1))).withColumn("last", F.filter(numbers, lambda k: at(k) & ~at(k + 1)))
    own = F.transform(F.arrays_zip("first", "last"), lambda z: F.struct(z["first"].alias("first"), F.slice("lines", z["first"] + 1, z["last"] - z["first"] + 1).alias("own")))
    parts = bounds.select("doc_id", F.inline(own)).where(has_anchor(F.array_join("own", "\n")))
    cut = parts.select("doc_id", "first", F.transform("own", words).alias("each"))
    places = F.flatten(F.transform("each", lambda w, k: F.array_repeat(F.col("first") + k, F.size(w))))
    return cut.select("doc_id", F.monotonically_increasing_id().alias("p"), F.flatten("each").alias("words"), places.alias("at"))


def _windows(paragraphs: DataFrame) -> DataFrame:
    """Windows of which a template is confirmed, each from a bigram of it to the last one found."""
    every = sorted(set().union(*[bigrams(t) for texts in TEMPLATES.values() for t in texts]))
    told_pairs = paragraphs.select("p", F.posexplode(grams(F.col("words"), 2)).alias("start", "pair")).where(F.col("pair").isin(every))
    hits = told_pairs.join(F.broadcast(_templates(paragraphs.sparkSession)), "pair")
    enough = hits.groupBy("p", "template", "total").agg(F.count_distinct("pair").alias("n")).where(F.col("n") >= CONFIRMED * F.col("total")).select("p", "template")
    some = keep(hits.join(enough, ["p", "template"]), "licence_hits")
    after = some.select("p", "template", F.col("start").alias("at"), F.col("pair").alias("hit"))
    longest = 2 * F.col("length") + AROUND
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + longest - 1)
    near = some.join(after, ["p", "template"]).where(inside)
    short = F.when(F.col("at") < F.col("start") + F.col("length") - 1, F.struct("hit", "at"))
    sets = near.groupBy("p", "template", "start", "licence", "total", "musts").agg(F.collect_set(short).alias("a"), F.collect_set(F.struct("hit", "at")).alias("b"))
    each = sets.select("p", "start", "licence", "total", "musts", F.explode(F.array("a", "b")).alias("found"))
    sized = each.select("p", "start", "licence", "musts", F.array_distinct("found.hit").alias("hits"), "total", (F.array_max("found.at") - F.col("start") + 2).alias("size"))
    sure = sized.withColumn("confirmation", F.size("hits") / F.col("total")).where(F.col("confirmation") >= CONFIRMED)
    held = sure.where(F.forall("musts", lambda own: F.arrays_overlap(own, F.col("hits"))))
    return held.select("p", "start", "size", "licence", F.array_sort("hits").alias("hits"), "confirmation").distinct()


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every notice that a licence family is confirmed for: ``doc_id, paragraph, licence, probability, confirmation``."""
    model, families, calibration = train(df.sparkSession)
    paragraphs = keep(_paragraphs(df, doc_id, text), "licence_paragraphs")
    windows = _windows(paragraphs).join(paragraphs, "p")
    cut = windows.withColumn("paragraph", F.get("at", F.col("start"))).withColumn("words", F.slice("words", F.col("start") + 1, F.col("size"))).drop("at")
    scored = model.transform(_vectors(cut)).withColumn("odds", vector_to_array(F.col("probability"))).drop("probability")
    names = F.array(*[F.lit(f) for f in families])
    own = F.get("odds", F.array_position(names, F.col("licence")).cast("int") - 1)
    likely = calibration.transform(scored.withColumn("raw", own / (own + F.get("odds", F.lit(len(families) - 1))))).where(F.col("probability") >= SURE)
    window = F.struct((-F.col("confirmation")).alias("order"), "size", "start", "licence", "paragraph", "probability", "confirmation", "hits")
    listed = likely.groupBy("doc_id", "p").agg(F.sort_array(F.collect_set(window)).alias("w"))
    meet = lambda x, y: (x["start"] < y["start"] + y["size"]) & (y["start"] < x["start"] + x["size"])
    part = lambda x, y: (x["licence"] != y["licence"]) & (F.size(x["hits"]) < F.size(y["hits"])) & meet(x, y) & (F.size(F.array_except(x["hits"], y["hits"])) == 0)
    own_ones = listed.withColumn("w", F.filter("w", lambda x: ~F.exists("w", lambda y: part(x, y))))
    same = lambda x, y: (x["licence"] == y["licence"]) & (meet(x, y) | (x["paragraph"] == y["paragraph"]))
    taken = F.aggregate("w", F.slice("w", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return own_ones.select("doc_id", F.inline(taken)).select("doc_id", "paragraph", "licence", "probability", "confirmation")


def licences(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document id that has a licence or none: ``doc_id, licences`` (sorted; empty: none), ``paragraphs``."""
    found = scan(df, doc_id=doc_id, text=text)
    each = df.select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("string").alias("licence"), F.lit(None).cast("int").alias("paragraph"))
    rows = each.unionByName(found.select("doc_id", "licence", "paragraph"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("licence")).alias("licences"), F.sort_array(F.collect_set("paragraph")).alias("paragraphs"))
