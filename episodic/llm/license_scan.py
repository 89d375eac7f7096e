"""Licence scan: a trained paragraph classifier whose findings are confirmed against templates.

*Classifier.*  One logistic regression a licence family over the word 1- and 2-grams of a
paragraph, scaled to unit length.  It learns from the licence notices below, from sentences that
only sound like them, and from a bounded sample of corpus paragraphs.  As in ``url_filter`` the
descent runs on one coefficient an example, so it is a fold over the small matrix of common
n-grams, and the weights are sparse: n-grams outside the examples have none.

*Unknown.*  The best family's margin is calibrated (Platt scaling, fitted on cut and thinned
notices and on corpus paragraphs that training did not see); below one half the paragraph is of
no known family.

*Windows.*  A paragraph is judged as a whole and, where it is longer, by overlapping windows of
about a notice's length, so a notice is found amid any number of other words.

*Confirmation.*  The word 3-grams of a paragraph or window and of the notices of its family must
overlap.

Only DataFrame functions run here; the corpus is read in one pass without a shuffle of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.llm.common import table, written

BUCKETS = 1 << 16
#: Documents whose paragraphs serve as unknown examples, and most paragraphs taken from them.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 40, 80
UNKNOWN = "unknown"
#: Words of the windows of a longer paragraph, in steps of half a window: a notice of up to half
#: a width lies in one window as a whole, and the longest notice has 39 words.
WIDTHS = (8, 16, 32, 64, 80)

#: Notices of each family (public licence notices, shortened to their usual sentences).
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher."),
]
#: Sentences without a licence.
OTHERS = [
    "She renewed her driving license last week.", "The committee granted permission to build a new bridge.",
    "The restaurant lost its liquor license after the inspection.", "He lectured on copyright law at the university.",
    "The general spoke to the public about the new version of the plan.", "A free concert was held under the old bridge.",
    "The software crashed twice during the demonstration.", "This program starts at eight in the evening.",
    "The common land was used by all the farmers of the village.", "Creative writing courses begin in the autumn.",
    "The Apache helicopter landed near the river.", "Students at the institute of technology published their results.",
    "The new version of the map shows every road.", "The library opens at nine and closes at six.",
    "You should have received a letter from the office.", "The conditions on the mountain were poor.",
    "The terms of the agreement were never made public.", "No part of the house was warm in winter.",
    "The law of the sea applies to every ship.", "They released the birds into the field.",
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even where lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gram(words: Column, n: int) -> Column:
    """Hashes of the ``n`` consecutive words from each place; ``words`` is a column or bound."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the 1- and 2-grams; bucket 0 is the bias."""
    return _bound(words_of(text), lambda w: _features(w, buckets))


def _features(words: Column, buckets: int) -> Column:
    hashed = F.transform(F.concat(_gram(words, 1), _gram(words, 2)), lambda h: (F.pmod(h, F.lit(buckets - 1)) + 1).cast("int"))
    return F.array_distinct(F.concat(F.array(F.lit(0)), hashed))


def grams_of(text: Column, n: int) -> Column:
    """Distinct hashes of the word n-grams."""
    return F.array_distinct(_bound(words_of(text), lambda w: _gram(w, n)))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, text): the lines of every text that hold a word; null text has none."""
    lines = F.split(F.col(text_col).cast("string"), "[\\r\\n]+")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("paragraph", "text")).where(F.col("text").rlike("[\\p{L}\\p{N}]"))


def _inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    each = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(family, text, fit): notices, other sentences and corpus paragraphs; ``fit`` marks those that
    train, the rest calibrate."""
    spark = docs.sparkSession
    notices = _inline(spark, NOTICES, "family string, text string")
    words = F.split("text", " ")
    cut = F.greatest(F.lit(3), (F.size(words) * 2 / 3).cast("int"))
    thinned = F.filter(words, lambda w, i: (i + 1) % 5 != 0)
    changed = notices.select("family", F.explode(F.array(F.array_join(F.slice(words, 1, cut), " "), F.array_join(thinned, " "))).alias("text"))
    others = _inline(spark, [(t,) for t in OTHERS], "text string").select(F.lit(UNKNOWN).alias("family"), "text")
    grams = notices.select(F.explode(grams_of(F.col("text"), 2)).alias("g")).agg(F.collect_set("g").alias("g"))
    few = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_DOCS)
    lines = paragraphs(few, "i", "t")
    # a paragraph that shares a word pair with a notice may be one, and is no example of either
    lines = lines.where(~F.arrays_overlap(grams_of(F.col("text"), 2), grams.scalar())).select("text").distinct()
    lines = lines.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PARAGRAPHS).select(F.lit(UNKNOWN).alias("family"), "text", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("fit"))
    rows = notices.withColumn("fit", F.lit(True)).unionByName(changed.withColumn("fit", F.lit(False))).unionByName(others.withColumn("fit", F.lit(True))).unionByName(lines)
    return rows.groupBy("text").agg(F.max(F.struct("fit", "family")).alias("e")).select("e.family", "text", "e.fit")


def train(rows: DataFrame, buckets: int = BUCKETS, epochs: int = 120, rate: float = 2.0, l2: float = 0.003) -> DataFrame:
    """One row: families (sorted), w (for each bucket the weights of all families, or null) and
    the calibration a, b of the best margin."""
    rows = written(rows.withColumn("x", features(F.col("text"), buckets)))
    fit = rows.where("fit")
    names = fit.where(F.col("family") != UNKNOWN).agg(F.sort_array(F.collect_set("family")).alias("f"))
    long = fit.select("text", F.size("x").alias("n"), F.explode("x").alias("b"))
    twin = long.select(F.col("text").alias("other"), F.col("n").alias("m"), "b")
    common = long.join(twin, "b").groupBy("text", "other").agg((F.count(F.lit(1)) / F.sqrt(F.first("n") * F.first("m"))).alias("k"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("other", "k"))), lambda e: e["k"])
    matrix = common.groupBy("text").agg(line.alias("k")).join(fit.select("text", "family"), "text")
    one = matrix.agg(F.sort_array(F.collect_list(F.struct("text", "family", "k"))).alias("m"))  # one number for two examples
    each = one.select("m", F.explode(names.scalar()).alias("f"))

    def step(a: Column, _: Column) -> Column:
        def new(row: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(row["k"], a, lambda k, v: k * v), F.lit(0.0), lambda s, v: s + v)
            y = F.when(row["family"] == F.col("f"), 1.0).otherwise(0.0)
            return F.get(a, i) * (1 - rate * l2) + rate * (y - 1 / (1 + F.exp(-margin)))

        return F.transform(F.col("m"), new)

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.transform("m", lambda _: F.lit(0.0)), step)
    alpha = each.select("f", F.explode(F.arrays_zip(F.col("m.text").alias("text"), fold.alias("a"))).alias("e")).select("f", "e.text", "e.a")
    by = long.join(alpha, "text").groupBy("b", "f").agg(F.sum(F.col("a") / F.sqrt("n")).alias("w"))
    by = by.groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "w"))), lambda e: e["w"]).alias("w"))
    every = rows.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b")).join(by, "b", "left")
    dense = written(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "w"))), lambda e: e["w"]).alias("w")).withColumn("families", names.scalar()))

    # Platt scaling of the best margin on examples that did not train
    unseen = rows.where("NOT fit").withColumns({"_w": dense.select("w").scalar(), "_zero": dense.select(_zeros("families")).scalar()})
    unseen = unseen.select("family", _margins(F.col("x"), F.col("_w"), F.col("_zero")).alias("s"))
    unseen = unseen.select(F.array_max("s").alias("s"), (F.col("family") != UNKNOWN).cast("double").alias("y")).agg(
        F.coalesce(F.sort_array(F.collect_list(F.struct("y", "s"))), F.array().cast("array<struct<y: double, s: double>>")).alias("c"))

    def platt(p: Column, _: Column) -> Column:
        off = F.transform("c", lambda e: F.struct((e["y"] - 1 / (1 + F.exp(-(p["a"] * e["s"] + p["b"])))).alias("g"), e["s"].alias("s")))
        grad = F.aggregate(off, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
                           lambda t, e: F.struct((t["a"] + e["g"] * e["s"]).alias("a"), (t["b"] + e["g"]).alias("b")))
        size = F.greatest(F.size("c"), F.lit(1))
        return F.struct((p["a"] + grad["a"] / size).alias("a"), (p["b"] + grad["b"] / size).alias("b"))

    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    scale = unseen.select(F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, platt).alias("p"))
    return written(dense.withColumn("p", scale.scalar()).select("families", "w", "p.a", "p.b"))


def _zeros(families: str) -> Column:
    return F.transform(families, lambda _: F.lit(0.0))


def _margins(x: Column, w: Column, zero: Column) -> Column:
    """Margins of all families of a paragraph with the feature buckets ``x``; most have no weights."""
    def total(x: Column) -> Column:
        both = F.aggregate(x, zero, lambda s, b: F.coalesce(F.zip_with(s, F.get(w, b), lambda p, q: p + q), s))
        return F.transform(both, lambda m: m / F.sqrt(F.size(x)))

    return _bound(x, total)


def _notice_places(words: Column) -> Column:
    """Places of ``words`` where a word 3-gram of any notice begins."""
    split = [re.findall(r"[^\W_]+", t.lower()) for _, t in NOTICES]
    grams = sorted({tuple(w[i : i + 3]) for w in split for i in range(len(w) - 2)})
    known = [F.xxhash64(*[F.lit(x) for x in g]) for g in grams]  # constants
    return F.filter(F.transform(_gram(words, 3), lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())


def _windows(words: Column, places: Column) -> Column:
    """(at, n, whole): the whole paragraph, and of each width below its length the windows that
    hold one of ``places``."""
    n = F.size(words)
    out = [F.array(F.struct(F.lit(0).alias("at"), n.alias("n"), F.lit(True).alias("whole")))]
    for width in WIDTHS:
        step = width // 2
        first = F.transform(places, lambda i: F.floor(i / step).cast("int"))  # noqa: B023
        starts = F.concat(F.transform(first, lambda k: F.greatest(F.lit(0), k - 1)), first)
        starts = F.array_distinct(F.transform(starts, lambda k: F.least(k * step, n - width)))  # noqa: B023
        each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(width).alias("n"), F.lit(False).alias("whole")))  # noqa: B023
        out.append(F.when(n > width, each).otherwise(F.slice(out[0], 1, 0)))
    return F.concat(*out)


def licence_paragraphs(docs: DataFrame, model: DataFrame | None = None, threshold: float = 0.5, overlap: float = 0.5,
                       id_col: str = "doc_id", text_col: str = "text", confirmed_only: bool = False) -> DataFrame:
    """(id, paragraph, text, family, score, similarity, confirmed) of the paragraphs that the
    classifier gives to a family, as a whole or in one of their windows.

    ``similarity`` is the largest share of common word 3-grams with a notice of the family: of the
    shorter one's for a whole paragraph, of the notice's for a window; ``confirmed`` from
    ``overlap`` on.  Of overlapping findings the confirmed, most similar, best scored one counts,
    and a paragraph has each family once; so a line with notices of two families has two rows.
    With ``confirmed_only`` (and ``overlap`` above 0) only windows that share a 3-gram with a
    notice are classified: no other one can be confirmed.  Null, empty and wordless texts have no
    paragraph.  Repeated rows are scanned one by one; other columns are not read.
    """
    spark = docs.sparkSession
    model = train(examples(docs, id_col, text_col)) if model is None else model
    notices = _inline(spark, NOTICES, "family string, text string").select("family", grams_of(F.col("text"), 3).alias("g"))
    notices = notices.agg(F.collect_list(F.struct("family", "g")).alias("t"))
    places = _notice_places if confirmed_only else lambda v: F.sequence(F.lit(0), F.size(v) - 1)
    both = _bound(words_of(F.col("text")), lambda v: F.struct(v.alias("v"), places(v).alias("i")))  # bound: the filter below is pushed down
    found = paragraphs(docs, id_col, text_col).withColumn("p", both).where(F.size("p.i") > 0)
    found = found.withColumn("e", _bound(F.col("p"), lambda p: _windows(p["v"], p["i"]))).withColumn("v", F.col("p.v")).withColumns({
        "_w": model.select("w").scalar(), "_zero": model.select(_zeros("families")).scalar(), "_f": model.select("families").scalar(),
        "_a": model.select("a").scalar(), "_b": model.select("b").scalar(), "_t": notices.scalar()})

    def judged(e: Column) -> Column:
        x = _bound(F.slice(F.col("v"), e["at"] + 1, e["n"]), lambda u: _features(u, BUCKETS))
        best = F.array_max(F.transform(_margins(x, F.col("_w"), F.col("_zero")), lambda m, i: F.struct(m.alias("m"), (-i).alias("i"))))
        return _bound(best, lambda m: F.struct(*[e[c].alias(c) for c in ("at", "n", "whole")], F.get(F.col("_f"), -m["i"]).alias("family"),
                                               (1 / (1 + F.exp(-(F.col("_a") * m["m"] + F.col("_b"))))).alias("score")))

    def compared(e: Column) -> Column:
        def share(g: Column) -> Column:
            def of(t: Column) -> Column:
                size = F.when(e["whole"], F.least(F.size(g), F.size(t["g"]))).otherwise(F.size(t["g"]))
                return F.size(F.array_intersect(g, t["g"])) / F.greatest(F.lit(1), size)

            return F.coalesce(F.array_max(F.transform(F.filter(F.col("_t"), lambda t: t["family"] == e["family"]), of)), F.lit(0.0))

        similarity = _bound(F.array_distinct(_bound(F.slice(F.col("v"), e["at"] + 1, e["n"]), lambda u: _gram(u, 3))), share)
        return _bound(similarity, lambda s: F.struct((s >= overlap).alias("confirmed"), s.alias("similarity"), e["score"].alias("score"),
                                                     (-e["n"]).alias("shorter"), (-e["at"]).alias("earlier"), e["family"].alias("family")))

    def best_first(kept: Column, e: Column) -> Column:
        meets = F.exists(kept, lambda k: (k["family"] == e["family"]) | ((k["earlier"] + k["shorter"] < e["earlier"]) & (e["earlier"] + e["shorter"] < k["earlier"])))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(e)))

    found = found.withColumn("e", F.transform(F.filter(F.transform("e", judged), lambda e: e["score"] >= threshold), compared))
    found = found.select("id", "paragraph", "text", F.sort_array("e", asc=False).alias("e"))
    found = found.select("id", "paragraph", "text", F.explode(F.aggregate("e", F.slice("e", 1, 0), best_first)).alias("e"))
    found = found.select("id", "paragraph", "text", "e.family", "e.score", "e.similarity", "e.confirmed")
    return found.where("confirmed") if confirmed_only else found


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = licence_paragraphs(docs, confirmed_only=True).groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_licences"), F.array_sort(F.collect_set("family")).alias("families"),
        F.min("paragraph").alias("first_paragraph"), F.max("score").alias("score"), F.max("similarity").alias("similarity"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select(
        "doc_id", F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce(F.array_join("families", ","), F.lit(UNKNOWN)).alias("families"),
        "first_paragraph", "score", "similarity")
