import math
import re
import textwrap

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from kgloom.llm import license_scan as ls

D = "/root/testdata/sf0.01"
LINES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit"}


@pytest.fixture(scope="module")
def model(spark):
    return ls.fit(spark.read.parquet(f"{D}/documents.parquet"))


def test_whole_table_against_brute_force(spark, model):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = sorted((r.doc_id, i, LINES[line]) for r in docs.collect() for i, line in enumerate(r.text.split("\n")) if line in LINES)
    got = sorted((r.doc_id, r.paragraph_no, r.family) for r in ls.license_scan(docs, model).collect())
    assert got == want


def test_held_out(spark, model):
    said = [
        ("mit", "Copyright (c) 2019 Someone. Released under the MIT License"), ("apache-2.0", "   Licensed under the Apache License, Version 2.0 (the \"License\");"),
        ("bsd", "// Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"), (None, "Public licences are a general question of our work."), (None, "The Apache people released a version under stars."),
        (None, "my license expired"), (None, "Is and retitioning ouen the of, nterti thorreou ndernt."),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(said)], "doc_id long, text string, family string")
    got = {r.doc_id: r.family for r in ls.license_scan(df, model).collect()}
    assert [got.get(i) for i in range(len(said))] == [f for f, _ in said]


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "x\nReleased under the MIT License."), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (6, "word " * 60000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    got = sorted((str(r.doc_id), r.paragraph_no) for r in ls.license_scan(df, model).collect())
    assert got == [("5", 0), ("5", 0), ("6", 1), ("None", 1)]
    assert ls.license_scan(df.limit(0), model).count() == 0


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
FULL = {"mit": MIT, "bsd": BSD, "gpl-3.0": GNU.format("General Public License", "3"), "gpl-2.0": GNU.format("General Public License", "2"), "agpl-3.0": GNU.format("Affero General Public License", "3"), "lgpl": GNU.format("Lesser General Public License", "3"), "isc": ISC, "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'}


def test_wrapped_notices(spark, model):
    """Whole notices wrapped at several widths, bare, behind comment marks, and between other blocks."""
    rows = []
    for family, text in FULL.items():
        for width in (44, 60, 78, 1000):
            lines = textwrap.wrap(text, width)
            forms = ["\n".join(lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main() {}\n", "# Some header\n#\n" + "\n".join(f"# {x}" for x in lines) + "\n#\nimport os", "The house is large.\nThe garden is small.\n\n" + "\n".join(f"   {x}\r" for x in lines) + "\n\nAn afterword."]
            rows += [(len(rows) + i, f, family, width) for i, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string, width int")
    got: dict = {}
    for r in ls.license_scan(df, model).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    wrong = [(i, w, width, got.get(i)) for i, _, w, width in rows if got.get(i) != {w}]
    assert not wrong


def test_prose_names_no_licence(spark, model):
    texts = ["The licence of the driver was valid.\nHe drove home.", "Copyright law differs between countries,\nand permission was not granted.", "The general public was under the terms of the free foundation's license.", "Software without warranty is sold in this shop."]
    assert ls.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).count() == 0


def test_fit_repeats_and_is_calibrated(spark, model):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    again = ls.fit(docs.repartition(7))
    assert (again.slope, again.shift, again.error) == (model.slope, model.shift, model.error)
    assert again.model.coefficientMatrix == model.model.coefficientMatrix
    assert model.slope > 0 and model.error < 0.02
    one, two = (sorted(map(str, ls.license_scan(docs, m).collect())) for m in (model, again))
    assert one == two


def test_classifier_against_recomputation(spark, model):
    """Probability, family and likeness of each finding, recomputed from the model's coefficients and the templates."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    found = ls.license_scan(docs, model).limit(40).collect()
    beta, intercept = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    tf = HashingTF(numFeatures=ls._DIMENSIONS, binary=True)
    for r in found:
        w = [x for x in re.split(ls._BREAK, r.paragraph.lower()) if x]
        n = lambda k: [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]  # noqa: B023, E731
        z = beta[:, sorted({tf.indexOf(t) for t in n(1) + n(2) + n(3)})].sum(axis=1) + intercept
        p = np.exp(z - z.max())
        p /= p.sum()
        other = min(max(p[-1], 1e-9), 1 - 1e-9)
        assert abs(1 / (1 + math.exp(-(math.log((1 - other) / other) * model.slope + model.shift))) - r.probability) < 2e-6
        shares = {k: max(len(set(n(2)) & set(ls._pairs(t))) / len(ls._pairs(t)) for t in some) for k, some in ls.TEMPLATES.items()}
        assert abs(shares[r.family] - r.likeness) < 2e-6 and r.likeness >= 0.6


def test_versions_modifiers_and_several_licences(spark, model):
    """The version and all modifiers decide; what no family has is unknown or nothing; two licences of one text are both named."""
    said = [
        ({"lgpl"}, "Licensed under the GNU Lesser General Public License, version 2.1"), ({"cc-by-nc-sa-4.0"}, "Licensed under CC BY-NC-SA 4.0"), ({"cc-by-nd-4.0"}, "This work is licensed under CC BY-ND 4.0."),
        ({"gpl-2.0"}, "Distributed under the GNU GPL version 2 or later"), ({"cc-by-sa-4.0"}, "This work is CC BY-SA 4.0"), ({"gpl-3.0"}, "released under GPLv3"), ({"epl-2.0"}, "Licensed under the Eclipse Public License, version 2.0."),
        ({"mit", "apache-2.0"}, "Dual licensed under the MIT license or the Apache License, Version 2.0"), ({"bsl-1.0"}, "Distributed under the Boost Software License, Version 1.0."),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(said)], "doc_id long, text string")
    got: dict = {}
    for r in ls.license_scan(df, model).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    assert [got.get(i) for i in range(len(said))] == [f for f, _ in said]
    others = ["Licensed under CC BY-ND 3.0", "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Apache License, Version 1.1."]
    named = {r.family for r in ls.license_scan(spark.createDataFrame(list(enumerate(others)), "doc_id long, text string"), model).collect()}
    assert named <= {ls.UNKNOWN}


def test_family_is_the_best_class(spark, model):
    """Families recomputed from the coefficients: the classifier names, templates only confirm."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    beta, intercept = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    tf = HashingTF(numFeatures=ls._DIMENSIONS, binary=True)
    for r in ls.license_scan(docs, model).limit(60).collect():
        w = [x for x in re.split(ls._BREAK, r.paragraph.lower()) if x]
        n = lambda k: [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]  # noqa: B023, E731
        z = beta[:, sorted({tf.indexOf(t) for t in n(1) + n(2) + n(3)})].sum(axis=1) + intercept
        assert ls._CLASSES[int(np.argmax(z[:-1]))] == r.family
