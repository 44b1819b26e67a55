"""Licence families of paragraphs (operator 3).

On the rows only native DataFrame operations run, and nothing is shuffled.  Each text is
cut into paragraphs at blank lines; line breaks inside a paragraph are blanks, so a wrapped
notice is read whole.  A paragraph is cut into sentences, as it may state several licences.
Sentences with an anchor word (most texts have none and are passed at once) are scored by a sparse
multinomial logistic regression over their word n-grams of one to three words.

The model is fitted on the driver, from the notices below alone (some thousand short texts):
family names in ``FRAMES``, whole notices, sentences that only talk of licences (``none``), and names of licences
that are no family (``unknown``).  L1 shrinkage keeps it sparse.  Names in ``HELD_FRAMES`` and half of the unknown names
are held out; a temperature fitted on some of them calibrates the probabilities, and the rest is for the tests.
Below ``least`` the class is ``unknown`` too.

A prediction is confirmed by comparison with the family's templates: the sentence holds one of its names
word for word, or ``overlap`` of the words of one of its notices.  ``All rights reserved`` in a
paragraph that states another licence belongs to that notice and is set aside.

Null texts count as empty and have no paragraph.  Repeated rows and null ids are rows of
their own.  Of equally probable classes the first counts.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"
UNKNOWN = "unknown"
RESERVED = "Proprietary"

# Family, names it is called by, SPDX identifiers, sentences of its notices.
FAMILIES = {
    "MIT": (
        ["MIT License", "MIT Licence", "Expat License", "MIT"], ["MIT"],
        ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
         "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    ),
    "Apache": (
        ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License", "Apache 2.0"], ["Apache-2.0"],
        ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
         "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind"],
    ),
    "GPL": (
        ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPL version 2", "GPLv3", "GPLv2", "GPL"], ["GPL-3.0-only", "GPL-2.0-or-later"],
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
         "You should have received a copy of the GNU General Public License along with this program"],
    ),
    "LGPL": (
        ["GNU Lesser General Public License", "GNU LGPL", "LGPL version 2.1", "LGPL", "LGPLv3"], ["LGPL-2.1-only", "LGPL-3.0-or-later"],
        ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    ),
    "AGPL": (
        ["GNU Affero General Public License", "GNU AGPL", "AGPL version 3", "AGPL", "AGPLv3"], ["AGPL-3.0-only", "AGPL-3.0-or-later"],
        ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    ),
    "BSD": (
        ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license"], ["BSD-3-Clause", "BSD-2-Clause"],
        ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
         "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
         "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    ),
    "MPL": (
        ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL"], ["MPL-2.0"],
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, you can obtain one"],
    ),
    "ISC": (
        ["ISC License", "ISC licence", "Internet Systems Consortium License"], ["ISC"],
        ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    ),
    "Unlicense": (
        ["Unlicense", "The Unlicense"], ["Unlicense"],
        ["This is free and unencumbered software released into the public domain", "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"],
    ),
    "CC0": (
        ["CC0 1.0", "CC0", "Creative Commons Zero", "CC0 public domain dedication"], ["CC0-1.0"],
        ["has waived all copyright and related rights to this work worldwide under Creative Commons CC0"],
    ),
    "CC-BY": (
        ["CC BY 4.0", "CC BY 3.0", "CC BY", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0", "CC-BY-3.0"],
        ["distributed under a Creative Commons Attribution 4.0 licence, which permits reuse with attribution"],
    ),
    "CC-BY-SA": (
        ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-4.0"],
        ["If you remix this material you must distribute your contributions under the same Attribution-ShareAlike licence"],
    ),
    "CC-BY-NC": (
        ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License"],
        ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"],
        ["You may not use the material for commercial purposes under this Attribution-NonCommercial licence"],
    ),
    RESERVED: (
        ["proprietary license", "commercial license agreement", "proprietary licence agreement"], ["LicenseRef-Proprietary"],
        ["All rights reserved", "Copyright 2019 Lakeside Press. All rights reserved worldwide", "No part of this publication may be reproduced or transmitted without the prior written permission of the publisher",
         "This document is confidential and proprietary to the company", "Unauthorized copying of this file is strictly prohibited"],
    ),
}
# Ways to state a licence by its name, to learn from.
FRAMES = [
    "You may use these files under the terms of the {}", "The source code is available under the {}", "All files here are covered by the {}", "Use of this material is governed by the {}", "License: {}",
    "we publish this data set under the {}", "It is distributed under the {}", "subject to the terms and conditions of the {}", "{}, see the LICENSE file", "The library is licensed to you under {}",
    "provided under {}", "The content is made available under {}, unless noted otherwise", "This package is free to use under {}", "Everything in this folder is licensed under a {}", "Licence: {}", "{}",
    "Copyright 2021 the authors, licensed under {} terms", "the project was released by its authors under the {}", "{} licensed", "Code and data are open under the {} since 2015",
]
# Further ways, held out: every second one calibrates, the others are for tests.
HELD_FRAMES = [
    "This module may be copied under the {}", "Released under the {}.", "The terms of the {} apply to this work", "This work is licensed under the {}.", "Parts of it are offered under the {}", "Licensed under {}.",
    "Published under the {} by the institute", "Licensed under the {}.",
]
# Licences of no known family; every second one is held out.
STRANGE = [
    "Foo License", "Artistic License 2.0", "Acme Public License", "Eclipse Public License", "Example Software License, version 1.2", "European Union Public Licence", "Lakeside Data License", "SIL Open Font License",
    "Open Meadow Licence", "zlib License", "Vendor License Agreement", "Boost Software License", "Community License 3.1", "Open Data Commons License", "Harbour Code License", "Ruby License", "Blue Heron Licence 2",
    "Academic Free License", "Riverside Content Licence", "Python Software Foundation License", "Granite Works License", "Microsoft Public License", "Ninefold Source Licence", "PostgreSQL License",
]
# Sentences with the same words that state no licence; every fourth one is held out.
OTHERS = [
    "His driving license was revoked after the accident", "A fishing license costs ten dollars a year", "The license plate was found near the road", "She applied for a license to sell wine",
    "The debate about copyright law continues in parliament", "They asked for permission to enter the building", "The product comes with a two year warranty", "No warranty claims were filed last month",
    "The ship sailed under a foreign license", "Apache helicopters landed at the base", "The Apache tribe lived in the region", "Mozilla announced a new browser", "The gnu is a large antelope",
    "He got permission from the teacher", "The court ruled on the copyright case", "A license fee is due each year", "Public domain films were shown all night", "CC the manager in your reply",
    "We compared permissive and copyleft licenses in this article", "The license of the pub was renewed", "Creative people met on the commons", "Rights reserved for members were discussed",
    "Researchers at MIT built a robot", "She studied at MIT in Boston", "The MIT professor gave a talk", "MIT and Harvard opened a joint laboratory", "Admission to MIT is competitive",
    "You need a license and registration", "The software license server is down", "Copyright infringement suits rose", "The council granted planning permission", "redistribution of wealth was the topic of the day",
    "The licensed doctor saw forty patients", "A licensed plumber must do the work", "The ISC conference takes place in June", "Permission to land was granted at noon", "They reserved all seats in the front row",
    "The nurse renewed her licence in spring", "Is the Apache server running", "The BSD socket interface is old", "Their copyright expired long ago", "He spoke about the history of the GNU project",
    "The proprietary format is hard to read", "Our commercial agreement ends in May", "The public domain is growing each year", "She sent the file with CC to the board", "A broad warranty covers the engine",
    "The club lost its gaming license", "Many licenses are hard to compare", "Copyright matters to authors", "Is permission needed to film here",
]
# Words one of which a sentence has if it can state a licence; the second row is read in capitals only.
ANCHORS = (
    "licen[sc]\\w*|sublicen[sc]\\w*|unlicen[sc]e\\w*|copyright\\w*|copyleft|spdx|permission|warrant(?:y|ies)|redistribut\\w*|gnu|l?a?gplv?[0-9]*|apache|mozilla|affero|unencumbered|cc0|creative\\s+commons|sharealike"
    "|noncommercial|proprietary|reserved|reproduced|prohibited|public\\s+domain|dedication|unless\\s+required|under\\s+(?:the\\s+)?(?:mit|bsd|mpl|isc|expat)"
)
_ANCHOR = rf"(?<![A-Za-z0-9])(?:(?i:{ANCHORS})|MIT|BSD|MPL|ISC|CC)(?![A-Za-z0-9])"
_BLANKS = r"[ \t\n\x0B\f\r]+"
_PARAGRAPH = r"\n[ \t\x0B\f\r]*\n[ \t\n\x0B\f\r]*"
_SENTENCE = r"(?<=[.!?;])[ \t\n\x0B\f\r]+(?=[A-Z(])"
WORD = r"[a-z0-9]+(?:\.[a-z0-9]+)*"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def features_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


class Model:
    """``weights`` of each class by n-gram (``unknown`` and ``none`` are the last classes)."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float]):
        self.classes, self.weights, self.bias = classes, weights, bias

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for f in features_of(words_of(text)) & self.weights.keys():
            z = z + np.array(self.weights[f])
        p = np.exp(z - z.max())
        return p / p.sum()


def notices() -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[tuple[str, str]]]:
    """``(text, class)`` to learn from, to calibrate by, and to test with."""
    learn, held = [], []
    for family, (names, ids, lines) in FAMILIES.items():
        learn += [(frame.format(n), family) for n in names for frame in FRAMES]
        learn += [(f"SPDX-License-Identifier: {i}", family) for i in ids for _ in range(4)] + [(line, family) for line in lines for _ in range(12)]
        held += [[(frame.format(n), family) for n in names] for frame in HELD_FRAMES]
    learn += [(frame.format(n), UNKNOWN) for n in STRANGE[::2] for frame in FRAMES]
    held += [[(frame.format(n), UNKNOWN) for n in STRANGE[1::2]] for frame in HELD_FRAMES]
    learn += [(t, NONE) for i, t in enumerate(OTHERS) if i % 4 < 3 for _ in range(12)]
    held += [[(t, NONE)] for i, t in enumerate(OTHERS) if i % 4 == 3]
    return learn, [x for own in held[::2] for x in own], [x for own in held[1::2] for x in own]


@functools.cache
def fit(rounds: int = 300, rate: float = 4.0, shrink: float = 2e-4) -> Model:
    classes = [*FAMILIES, UNKNOWN, NONE]
    learn, calibrate, _ = notices()
    found = [features_of(words_of(t)) for t, _ in learn]
    vocabulary = sorted(set().union(*found))
    place = {f: j for j, f in enumerate(vocabulary)}

    def matrix(sets: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
        for i, fs in enumerate(sets):
            x[i, [place[f] for f in fs if f in place]] = 1
        return x

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(found), np.eye(len(classes), dtype=np.float32)[[classes.index(c) for _, c in learn]]
    w, b = np.zeros((len(vocabulary), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    b[-1] = 2.0  # no feature: none
    weight = (1 / y.sum(axis=0) / len(classes))[y.argmax(axis=1)][:, None]
    for _ in range(rounds):
        d = (soft(x @ w + b) - y) * weight
        w -= rate * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * rate, 0)
    z = matrix([features_of(words_of(t)) for t, _ in calibrate]) @ w + b
    right = [classes.index(c) for _, c in calibrate]
    loss = {t: -np.log(np.maximum(soft(z / t)[np.arange(len(right)), right], 1e-9)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    t = min(loss, key=loss.get)
    keep = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    return Model(classes, {vocabulary[j]: [round(float(v), 4) for v in w[j] / t] for j in keep}, [round(float(v), 4) for v in b / t])


def templates() -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
    """``(family, name)`` as words with a blank at each end, and ``(family, distinct words)`` of notices."""
    names = [(f, f" {' '.join(words_of(n))} ") for f, (own, ids, _) in FAMILIES.items() for n in [*own, *(f"identifier: {i}" for i in ids)]]
    names += [(RESERVED, " all rights reserved ")]
    return names, [(f, sorted(set(words_of(line)))) for f, (_, _, lines) in FAMILIES.items() for line in lines if len(words_of(line)) > 5]


FOUND = "array<struct<paragraph:int,family:string,probability:double,overlap:double,confirmed:boolean>>"


def _ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def paragraph_licenses(text: Column, model: Model, least: float, overlap: float) -> Column:
    """The sentences of the paragraphs of ``text`` that a family or ``unknown`` is predicted for."""

    def fixed(value, kind: str) -> Column:  # one literal, read once while the plan is made
        return F.from_json(F.lit(json.dumps(value)), kind)

    vocabulary = fixed(list(model.weights), "array<string>")
    weights = fixed(model.weights, "map<string,array<double>>")
    names = fixed(model.classes, "array<string>")
    named, lines = templates()
    named = fixed([{"family": f, "name": n} for f, n in named], "array<struct<family:string,name:string>>")
    lines = fixed([{"family": f, "w": w} for f, w in lines], "array<struct<family:string,w:array<string>>>")

    def grams(w: Column, k: int) -> Column:
        n = F.size(w) - (k - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))

    def probable(s: Column) -> Column:
        own = F.array_intersect(F.concat(s["w"], grams(s["w"], 2), grams(s["w"], 3)), vocabulary)
        z = F.aggregate(own, fixed(model.bias, "array<double>"), lambda a, f: F.zip_with(a, F.element_at(weights, f), lambda x, y: x + y))
        return F.struct(s["paragraph"], s["w"], z.alias("z"))

    def decided(s: Column) -> Column:
        top = F.array_max(s["z"])
        p = 1.0 / F.aggregate(s["z"], F.lit(0.0), lambda a, v: a + F.exp(v - top))
        name = F.element_at(names, F.array_position(s["z"], top).cast("int"))
        return F.struct(s["paragraph"], s["w"], F.when((p < least) & (name != NONE), F.lit(UNKNOWN)).otherwise(name).alias("family"), F.round(p, 6).alias("probability"))

    def compared(s: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(s["w"], " "), F.lit(" "))
        by_name = F.exists(named, lambda t: (t["family"] == s["family"]) & F.contains(joined, t["name"]))
        shares = F.transform(F.filter(lines, lambda t: t["family"] == s["family"]), lambda t: F.size(F.array_intersect(t["w"], s["w"])) / F.size(t["w"]))
        best = F.when(by_name, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0)))
        return F.struct(s["paragraph"], s["family"], s["probability"], F.round(best, 6).alias("overlap"), (best >= overlap).alias("confirmed"))

    def settled(found: Column) -> Column:
        """Without reserved rights in paragraphs with another confirmed family."""
        other = lambda s: F.exists(found, lambda x: (x["paragraph"] == s["paragraph"]) & x["confirmed"] & (x["family"] != RESERVED))
        return F.filter(found, lambda s: (s["family"] != RESERVED) | ~other(s))

    parts = F.filter(F.transform(F.split(text, _PARAGRAPH, -1), lambda p, i: F.struct(i.alias("paragraph"), p.alias("p"))), lambda s: s["p"].rlike(_ANCHOR))
    sentences = F.flatten(F.transform(parts, lambda s: F.transform(F.split(s["p"], _SENTENCE, -1), lambda t: F.struct(s["paragraph"].alias("paragraph"), t.alias("p")))))
    worded = F.transform(
        F.filter(sentences, lambda s: s["p"].rlike(_ANCHOR)), lambda s: F.struct(s["paragraph"], F.regexp_extract_all(_ascii_lower(s["p"]), F.lit(WORD), F.lit(0)).alias("w"))
    )
    found = F.transform(F.filter(F.transform(F.transform(worded, probable), decided), lambda s: s["family"] != NONE), compared).cast(FOUND)
    once = F.element_at(F.transform(F.array(found), settled), 1)  # an array of one element binds its value, which each use would compute anew
    return F.when(text.rlike(_ANCHOR), once).otherwise(F.array().cast(FOUND)).cast(FOUND)


def scan(docs: DataFrame, model: Model | None = None, least: float = 0.5, overlap: float = 0.75) -> DataFrame:
    """``doc_id, n_paragraphs, found`` for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, _PARAGRAPH, -1))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_paragraphs"), paragraph_licenses(text, model or fit(), least, overlap).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: confirmed families, and all findings as text."""
    sure = F.filter("found", lambda s: s["confirmed"])
    return scanned.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_found"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["paragraph"], s["family"], F.format_number(s["probability"], 3))), ",").alias("findings"),
    )
