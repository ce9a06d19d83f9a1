"""Licence scans by a trained paragraph classifier, with DataFrame functions and Spark ML only.

Paragraphs are the blocks of a text between blank lines, with comment marks stripped, and each line of a block by itself. A
paragraph becomes a sparse binary vector of its hashed words, word pairs and word triples. A multinomial logistic
regression over licence families and one class for all else is fitted on the template notices below, varied by dropped
words and by text around them, and on a bounded sample of the corpus's paragraphs as the other class. The probability that
a paragraph is of the unknown class is calibrated by a second regression (Platt's scaling) on variants and
paragraphs that the first has not seen. The family of a paragraph that is probably a notice is the classifier's best class. That
family's templates alone confirm it: enough word pairs of one must stand in the paragraph, and one of the family's names with its
version and all its modifiers, word by word. Where the pairs stand and the name doesn't, the licence is unknown. What names a confirmed
licence is then taken out of the paragraph, and the rest is classified again, so a paragraph of several licences gives each.

A result needs ``confirm`` of a template's pairs, so of any larger share of its pairs than the rest one must be there. ``_needed`` picks
a few words, rare in the corpus, that stand in so many pairs of every template; paragraphs without any of them can give no
result whatever the classifier says, and aren't scored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm.common import bounded_sample, plain, staged, table

_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
#: Notices by which works name their licence.
_LONG = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation", _GNU.format("affero general public license", "3")],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "released under the apache license 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["licensed under the bsd license", "released under the 3-clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nd-4.0": ["licensed under cc by-nd 4.0", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "cc-by-nc-sa-4.0": ["licensed under cc by-nc-sa 4.0", "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license"],
    "cc-by-nc-nd-4.0": ["licensed under cc by-nc-nd 4.0", "this work is licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2", "released under the gnu general public license version 2", _GNU.format("general public license", "2")],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "released under the gnu general public license version 3", _GNU.format("general public license", "3")],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license as published by the free software foundation", _GNU.format("lesser general public license", "3"), _GNU.format("lesser general public license", "2.1")],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "the software is provided as is without warranty of any kind express or implied"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0"],
    "eupl-1.2": ["licensed under the eupl version 1.2", "licensed under the european union public licence version 1.2"],
    "bsl-1.0": ["distributed under the boost software license version 1.0"],
    "mpl-2.0": ["licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"],
}
#: What names each family with its version and modifiers, as words in a row; several in one entry must all be there.
NAMES = {
    "agpl-3.0": ["affero general public license", "agpl", "agplv3"],
    "apache-2.0": ["apache license version 2 0", "apache license version 2", "apache license 2 0", "apache license v2 0", "apache 2 0", "may not use this file except in compliance with the license", "distributed under the license is distributed on an as is basis"],
    "bsd": ["bsd license", "bsd 3 clause", "bsd 2 clause", "3 clause bsd", "2 clause bsd", "redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce", "may be used to endorse or promote products derived"],
    "bsl-1.0": ["boost software license"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "cc-by-nc-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "cc-by-nc-nd-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"],
    "cc-by-nc-sa-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"],
    "cc-by-nd-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0"],
    "cc-by-sa-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "cc0": ["cc0 1 0", "cc0", "waived all copyright and related"],
    "epl-2.0": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
    "eupl-1.2": ["eupl version 1 2", "eupl v 1 2", "eupl 1 2", "european union public licence version 1 2", "european union public licence v 1 2"],
    "gpl-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl version 2", "gpl v2", "gpl 2 0", "gpl 2", "gplv2", "gnu general public license|version 2 of the license"],
    "gpl-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl version 3", "gpl v3", "gpl 3 0", "gpl 3", "gplv3", "gnu general public license|version 3 of the license"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software", "permission to use copy modify and distribute this software"],
    "lgpl": ["lesser general public license", "library general public license", "lgpl", "lgplv2 1", "lgplv2", "lgplv3"],
    "mit": ["mit license", "mit licence", "permission is hereby granted free of charge", "the software is provided as is without warranty"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
}
#: A name by itself is a notice as well; one of a single word with the word before it.
TEMPLATES = {k: [*some, *(n if " " in n else f"under {n}" for n in NAMES[k] if "|" not in n)] for k, some in _LONG.items()}
UNKNOWN = "unknown"
#: Sentences with the same words that are no notices.
OTHERS = ["the driver must carry a license at all times", "a license is needed to fish in the lake", "public transport in the city is free for children", "the general said that the public was not at risk", "version 2 of the plan was released under pressure", "the work was done under the old terms", "permission was granted to the school by the council", "the software is slow and the files are large", "this work is about creative people", "copyright law differs between countries", "he studied at mit and at berkeley", "under the bridge the common terms of attribution are unknown", "an international conference on general questions", "the apache helicopter was used without conditions", "the mozilla foundation and the free software foundation met"]
_CLASSES = [*TEMPLATES, "other"]
_NOTICES = [(k, t) for k, some in TEMPLATES.items() for t in some]
_DIMENSIONS = 1 << 14
_BREAK = "[^a-z0-9+\\x80-\\uffff]+"
#: Comment marks at both ends of a line.
_MARKS = r"(?m)^[ \t]*(?:(?://+!?|/\*+|\*+/?|#+|;+|--+|<!--|%+|\|)[ \t]*)+|[ \t]*(?:\*+/|-->)?[ \t\r]*$"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and plus signs, split in one pass."""
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def _onward(grams: Column, word_list: Column, n: int) -> Column:
    """Runs of ``n`` words from the runs of one less."""
    size = F.size(word_list) - (n - 1)
    more = F.zip_with(F.slice(grams, 1, F.greatest(size, F.lit(1))), F.slice(word_list, n, F.greatest(size, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(size > 0, more).otherwise(F.array().cast("array<string>"))


def _features(df: DataFrame) -> DataFrame:
    """Adds ``words``, ``pairs`` and ``features`` to rows with a ``paragraph``."""
    df = df.withColumn("words", words(F.col("paragraph")))
    df = df.withColumn("pairs", _onward(F.col("words"), F.col("words"), 2))
    df = df.withColumn("terms", F.concat("words", "pairs", _onward(F.col("pairs"), F.col("words"), 3)))
    return HashingTF(numFeatures=_DIMENSIONS, binary=True, inputCol="terms", outputCol="features").transform(df).drop("terms")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(row, doc_id, block, line, paragraph_no, paragraph): blocks of lines, and the lines of blocks of several.

    ``block`` numbers the block's first line, from 0; ``paragraph_no`` is the first line of the paragraph; ``line`` tells lines from
    blocks. Blank is a line without anything but comment marks and white space.
    """
    lines = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.regexp_replace("text", _MARKS, ""), "\n").alias("lines"))
    ink = lambda i: F.trim(F.get("lines", i)) != ""
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    edges = lambda step: F.filter(every, lambda i: ink(i) & ~F.coalesce(ink(i + step), F.lit(False)))
    bounds = lines.select("row", "doc_id", "lines", F.arrays_zip(edges(-1).alias("a"), edges(1).alias("z")).alias("bounds"))
    parts = bounds.select("row", "doc_id", "lines", F.inline("bounds"))
    own = F.slice("lines", F.col("a") + 1, F.col("z") - F.col("a") + 1)
    whole = F.array(F.struct(F.lit(False).alias("line"), F.col("a").alias("paragraph_no"), F.array_join(own, "\n").alias("paragraph")))
    single = F.transform(own, lambda x, i: F.struct(F.lit(True).alias("line"), (F.col("a") + i).alias("paragraph_no"), x.alias("paragraph")))
    return parts.select("row", "doc_id", F.col("a").alias("block"), F.inline(F.when(F.col("z") > F.col("a"), F.concat(whole, single)).otherwise(whole)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [*_NOTICES, *(("other", t) for t in OTHERS)]
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.lit(t).alias("notice")) for k, t in rows))).alias("t")).select("t.*")


class LicenseModel:
    """The classifier, its calibration, the probability from which a paragraph counts, what the calibration's rows say (the
    share that it gets wrong at that probability), and in how many sampled paragraphs the templates' words stand."""

    def __init__(self, model: LogisticRegressionModel, slope: float, shift: float, least: float, error: float, common: dict[str, int]) -> None:
        self.model, self.slope, self.shift, self.least, self.error, self.common = model, slope, shift, least, error, common


def fit(df: DataFrame, sample_rows: int = 400, sample_paragraphs: int = 3000, least: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> LicenseModel:
    """Fits on the templates and on at most ``sample_paragraphs`` paragraphs of ``sample_rows`` rows (only the fit uses a sample).

    Sampled paragraphs that hold most of a template are left out; a third of the rest, and of the templates' variants, only
    calibrates. Training rows are sorted, so that two fits are the same to the last digit. An empty table gives a model fitted
    on the templates and the counterexamples alone.
    """
    spark = df.sparkSession
    sample = bounded_sample(plain(df, doc_id=id_col, text=text_col).filter("text is not null"), sample_rows, "doc_id", "text")
    sample = paragraphs(sample).orderBy(F.xxhash64("paragraph", "doc_id", "paragraph_no"), "paragraph").limit(sample_paragraphs).select("paragraph").distinct()
    own = words(F.col("paragraph"))
    sample = staged(sample.select("paragraph", _onward(own, own, 2).alias("own")))
    notices = F.transform(F.split(F.lit(";".join("|".join(_pairs(t)) for _, t in _NOTICES)), ";"), lambda t: F.split(t, "[|]"))
    sample = sample.withColumn("notice", F.explode(notices)).groupBy("paragraph").agg(F.max(F.size(F.array_intersect("notice", "own")) / F.size("notice")).alias("share")).filter("share < 0.5").select("paragraph", (F.pmod(F.xxhash64("paragraph"), F.lit(3)) == 0).alias("held"))
    known = sorted({w for _, t in _NOTICES for w in _split(t)})
    # A row for each word of the templates at most.
    common = {r["w"]: r["n"] for r in sample.select(F.explode(F.array_intersect(words(F.col("paragraph")), _list(known))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Each notice alone, with words dropped, and with other text around it; copies weigh against the other class.
    # Short ones aren't thinned, so they need fewer copies.
    variants = _templates(spark).withColumn("n", F.explode(F.sequence(F.lit(0), F.when(F.size(F.split("notice", " ")) < 9, F.lit(14)).otherwise(F.lit(44)))))
    kept = F.array_join(F.filter(F.split("notice", " "), lambda w: (F.col("n") < 15) | (F.size(F.split("notice", " ")) < 9) | (F.pmod(F.xxhash64(w, "n"), F.lit(10)) > 0)), " ")
    around = F.when(F.col("n") % 5 == 1, F.concat(F.lit("copyright 2020 the authors "), kept)).when(F.col("n") % 5 == 2, F.concat(kept, F.lit(" see the file for details"))).when(F.col("n") % 5 == 3, F.concat(F.lit("this program is free software "), kept, F.lit(" see the license for more details"))).otherwise(kept)
    variants = variants.select("family", around.alias("paragraph"), (F.col("n") % 3 == 2).alias("held"))
    rows = staged(variants.unionByName(sample.select(F.lit("other").alias("family"), "paragraph", "held")))
    label = F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("family")) - 1
    # A few thousand rows at most, in one sorted partition: sums are added in one order.
    one = lambda d: d.coalesce(1).sortWithinPartitions("family", "paragraph")
    training = _features(one(rows.filter("not held"))).select(label.cast("double").alias("label"), "features")
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=0.0005).fit(training)
    held = _scored(model, _features(one(rows.filter("held")))).select("logit", (F.col("family") != "other").cast("double").alias("label"))
    held = VectorAssembler(inputCols=["logit"], outputCol="features").transform(held)
    scale = LogisticRegression(maxIter=50, regParam=0.001, standardization=False).fit(held)
    slope, shift = (float(f"{x:.9g}") for x in (scale.coefficients[0], scale.intercept))
    wrong = held.select(F.avg(((_calibrated(F.col("logit"), slope, shift) >= least) != (F.col("label") == 1)).cast("int"))).first()[0]
    return LicenseModel(model, slope, shift, least, float(wrong or 0.0), common)


def _split(text: str) -> list[str]:
    return [x for x in re.split(_BREAK, text) if x]


def _needed(common: dict[str, int], confirm: float) -> list[str]:
    """Words of which a paragraph has one at least if ``confirm`` of any template's pairs stand in it: rare ones first, long ones of these."""
    taken: set[str] = set()
    for _, t in _NOTICES:
        pairs = [p.split(" ") for p in _pairs(t)]
        # Likeness is rounded to six digits.
        spare = len(pairs) - math.ceil((confirm - 1e-6) * len(pairs))
        left = [p for p in pairs if not taken & {*p}]
        for w in sorted({w for p in left for w in p}, key=lambda w: (common.get(w, 0), -len(w), w)):
            if len(left) < len(pairs) - spare:
                break
            taken.add(w)
            left = [p for p in left if w not in p]
    return sorted(taken)


def _pairs(text: str) -> list[str]:
    w = _split(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _scored(model: LogisticRegressionModel, features: DataFrame) -> DataFrame:
    """Adds ``logit``, how much more probable some family is than the unknown class, as a logarithm; and ``best``, the most probable family.

    Families in the column ``had``, where there is one, were found before and don't count.
    """
    p = vector_to_array("chances")
    out = model.copy().setProbabilityCol("chances").setPredictionCol("").setRawPredictionCol("").transform(features)
    kept = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    other = kept(F.element_at(p, len(_CLASSES)))
    some, rest = F.slice(p, 1, len(_CLASSES) - 1), 1 - other
    if "had" in features.columns:
        some = F.zip_with(some, F.slice(_list(_CLASSES), 1, len(_CLASSES) - 1), lambda x, k: F.when(F.array_contains("had", k), F.lit(0.0)).otherwise(x))
        rest = kept(F.aggregate(some, F.lit(0.0), lambda t, x: t + x))
    best = F.element_at(_list(_CLASSES), F.array_position(some, F.array_max(some)).cast("int"))
    return out.select(*(c for c in features.columns if c != "features"), F.log(rest / other).alias("logit"), best.alias("best"))


def _calibrated(logit: Column, slope: float, shift: float) -> Column:
    return 1 / (1 + F.exp(-(logit * slope + shift)))


def _list(items: list[str]) -> Column:
    """One literal, so that plans stay small."""
    return F.split(F.lit("|".join(items)), "[|]")


def _named(text: Column, name: str) -> Column:
    hit = F.lit(True)
    for part in name.split("|"):
        hit = hit & F.contains(text, F.lit(f" {part} "))
    return hit


def _confirmed(found: DataFrame, confirm: float) -> DataFrame:
    """Of rows with ``best``, ``pairs`` and ``words``: those whose best family's templates stand in them, with ``likeness``, ``family`` and ``name``.

    Likeness is the greatest share of a template's pairs. ``name`` is the first of the family's names that is there, word by word; without
    one the family is unknown.
    """
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    share, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, some in TEMPLATES.items():
        own = F.greatest(*(F.round(F.size(F.array_intersect(_list(_pairs(t)), "pairs")) / F.lit(float(len(_pairs(t)))), 6) for t in some))
        first = F.coalesce(*(F.when(_named(text, n), F.lit(n)) for n in NAMES[k]))
        share, name = F.when(F.col("best") == k, own).otherwise(share), F.when(F.col("best") == k, first).otherwise(name)
    # Written, since filters on what templates give would be pushed below it and evaluate all of them again.
    out = staged(found.select("row", "doc_id", "block", "line", "paragraph_no", "best", "probability", "paragraph", "words", share.alias("likeness"), name.alias("name"), *(["had"] if "had" in found.columns else [])))
    return out.filter(F.col("likeness") >= confirm).withColumn("family", F.when(F.col("name").isNotNull(), F.col("best")).otherwise(UNKNOWN))


def license_scan(df: DataFrame, model: LicenseModel, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph and licence that it names: doc_id, paragraph_no, family, probability, likeness, paragraph.

    ``paragraph_no`` numbers the paragraph's first line, from 0. The calibrated probability must reach the model's bound, and
    ``likeness``, the greatest share of word pairs that a template of the classifier's best family has in the paragraph, must reach
    ``confirm``; the family is unknown where none of its names is there. A paragraph whose licence is confirmed is scored again without
    the words of that name and for the other families, until nothing more is confirmed. A block of lines counts where none of its lines names the same family
    by itself, and an unknown licence where the block and its lines name no other. Null and empty texts have no paragraphs; texts are read whole, however long. Of families that are as probable the first
    in the alphabet is taken. Repeated rows give repeated results; null ids pass through. An empty table gives an empty
    result; other columns are ignored.
    """
    needed = _list(_needed(model.common, confirm))
    rows = plain(df, doc_id=id_col, text=text_col).filter(F.arrays_overlap(words(F.col("text")), needed))
    units = paragraphs(rows).filter(F.arrays_overlap(words(F.col("paragraph")), needed)).withColumn("shown", F.col("paragraph"))
    parts: list[DataFrame] = []
    while True:
        first = not parts
        scored = _scored(model.model, _features(units)).withColumn("probability", F.round(_calibrated(F.col("logit"), model.slope, model.shift), 6)).filter(F.col("probability") >= model.least)
        found = staged(_confirmed(scored.drop("paragraph").withColumnRenamed("shown", "paragraph"), confirm))
        found = found if first else found.filter("name is not null")
        parts.append(found.select("row", "doc_id", "block", "line", "paragraph_no", "family", "probability", "likeness", "paragraph"))
        again = found.filter("name is not null")
        if again.isEmpty():
            break
        # Each turn finds another family, so turns end.
        had = F.array("best") if first else F.array_append("had", F.col("best"))
        units = staged(again.select("row", "doc_id", "block", "line", "paragraph_no", F.col("paragraph").alias("shown"), _without("words", "name").alias("paragraph"), had.alias("had")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by_line = F.max("line").over(Window.partitionBy("row", "block", "family"))
    by_name = F.max(F.col("family") != UNKNOWN).over(Window.partitionBy("row", "block"))
    out = out.withColumn("by_line", by_line).withColumn("by_name", by_name).filter("line or not by_line").filter(~F.col("by_name") | (F.col("family") != UNKNOWN))
    return out.select("doc_id", "paragraph_no", "family", "probability", "likeness", "paragraph")


def _without(words_col: str, name_col: str) -> Column:
    """The words as a text without the parts of the name."""
    text = F.concat(F.lit(" "), F.array_join(words_col, " "), F.lit(" "))
    return F.aggregate(F.split(F.col(name_col), "[|]"), text, lambda t, part: F.replace(t, F.concat(F.lit(" "), part, F.lit(" ")), F.lit(" ")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs, fit(docs))


SQL: dict[str, str] = {}
QUERIES = {"op3_license_scan": op3_license_scan}
