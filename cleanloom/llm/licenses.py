"""License scans: a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line that holds one of ANCHORS; where the line alone names no licence, it is the line with its neighbours up to a
blank line (WRAPPED on each side at most), and then the whole block of lines between blank ones, as notices are wrapped. Paragraphs
are turned into the set of their word 1- to 3-grams; a sparse logistic regression over these names a licence family or `unknown`.
The family's probability is calibrated on notices that the fit has not seen, and templates of the named family confirm it: enough
of the shorter side's word pairs must be shared; a family's short names are templates too, so that a short notice is confirmed by
its name. Anchors only say where to look: words and parts of words one of which every notice of the families has.
All of it happens within a document's row, without a shuffle.

The model is trained on the driver from the notices below and from texts that hold anchors without being
licences, each in many variants with words dropped, added and cut; L1 leaves a few hundred n-grams.

Defined results: null and empty texts, and texts without an anchor, have no paragraphs, null licence and probability
0.0; of several confirmed paragraphs the most probable names the licence (ties: the first name in alphabetical
order); paragraphs that aren't confirmed count as unknown, and a document with only such ones has the licence `unknown`; texts of
any length are scanned as a whole, within a row; repeated rows get equal results; an empty table gives an empty result; other columns
aren't looked at.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as sh

#: What every notice of the families holds at least one of: parts of words and whole words in any case, and names in capitals ("mit" is a German word).
ANCHORS = ("licen", "copyright", "rights reserved", "rights are reserved", "public domain", "permission", "redistribut", "creative commons", "spdx")
ANCHOR_WORDS = ("gnu", "gpl", "gplv2", "gplv3", "lgpl", "agpl", "agplv3", "apache", "bsd", "mozilla", "eclipse", "cc0", "cc by", "cc-by")
ANCHOR_NAMES = ("MIT", "ISC", "MPL", "EPL")

#: How the licence families are named in notices.
NAMES = {
    "mit": ("MIT license", "MIT licence", "MIT style license", "Expat license", "MIT"),
    "apache-2.0": ("Apache License", "Apache License version 2.0", "Apache 2.0 license", "Apache 2.0"),
    "gpl": ("GNU General Public License", "GNU General Public License version 2", "GNU GPL", "GNU GPL version 3", "GPL version 2", "GPL v3", "GPLv3", "GPL 2.0 or later"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "GNU LGPL", "LGPL version 3", "LGPL v2", "LGPL 2.1"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU AGPL", "AGPL version 3", "AGPL v3", "AGPL 3.0"),
    "bsd-2-clause": ("BSD 2 clause license", "2 clause BSD license", "simplified BSD license", "BSD 2 clause"),
    "bsd-3-clause": ("BSD 3 clause license", "3 clause BSD license", "modified BSD license", "BSD style license", "BSD license", "BSD 3 clause"),
    "isc": ("ISC license", "ISC licence", "ISC"),
    "mpl-2.0": ("Mozilla Public License", "Mozilla Public License version 2.0", "MPL version 2", "MPL 2.0"),
    "epl": ("Eclipse Public License", "Eclipse Public License version 1.0", "EPL version 2", "EPL 2.0"),
    "cc-by": ("Creative Commons Attribution license", "Creative Commons Attribution 4.0 International license", "CC BY 3.0", "CC BY 4.0", "CC BY license", "CC BY"),
    "cc-by-sa": ("Creative Commons Attribution ShareAlike license", "Creative Commons Attribution ShareAlike 4.0 International license", "CC BY SA 3.0", "CC BY SA 4.0", "CC BY SA license", "CC BY SA"),
    "cc-by-nc": ("Creative Commons Attribution NonCommercial license", "Creative Commons Attribution NonCommercial 4.0 International license", "CC BY NC 3.0", "CC BY NC 2.0", "CC BY NC license", "CC BY NC"),
    "public-domain": ("public domain", "CC0 1.0", "CC0", "Unlicense", "CC0 public domain dedication"),
    "all-rights-reserved": ("all rights reserved", "all rights are reserved"),
}
#: What stands around the names: the classifier learns from the first ones and is calibrated on the others.
CARRIERS = (
    "{}", "distributed under the {}", "available under the terms of the {}", "this file is covered by the {}", "you may use it under {}", "the code comes with the {} see the file for details",
    "made available by its authors under a {}", "this project uses the {}", "subject to the {} as published", "copyright 2019 by the authors {}", "SPDX license identifier {}", "the text falls under {} unless noted otherwise",
)
HELD_CARRIERS = ("published under {} by the maintainers", "the software is provided under the {}", "its license is the {}", "shared under the terms of {}")
#: Longer notices, which don't name their family, or not first.
NOTICES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the Apache License at the address of the Apache Software Foundation.",
    ),
    "gpl": (
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one from Mozilla.",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "The author places this file in the public domain.",
    ),
    "all-rights-reserved": (
        "No part of this publication may be reproduced without prior written permission of the publisher; all rights reserved by the author.",
        "Copyright 2019 Example Press, all rights reserved.",
    ),
}
#: Short phrases that confirm families whose names are one word.
PHRASES = {
    "gpl": ("under GPLv3", "the GPLv3", "GPLv3 license", "GPL 3.0"),
    "mit": ("identifier MIT", "license MIT", "under MIT"),
    "isc": ("identifier ISC", "license ISC", "under ISC"),
    "public-domain": ("under CC0", "the CC0", "under Unlicense", "the Unlicense"),
}
#: What confirms a family: its longer notices, its names of several words, and its phrases.
TEMPLATES = {f: (*NOTICES.get(f, ()), *(n for n in NAMES[f] if " " in n), *PHRASES.get(f, ())) for f in NAMES}

#: Texts that hold anchors and are no licences.
OTHERS = (
    "She renewed her driving licence at the city office last week.",
    "The licensed premises close at eleven on weekdays.",
    "A fishing license is required on this lake from May to October.",
    "He asked for permission to leave the room before the end of the lesson.",
    "The committee discussed a reform of copyright and its exceptions for libraries.",
    "Redistribution of income was the subject of the second lecture.",
    "The story had long passed into the public domain and was told everywhere.",
    "Without written permission from the parents nobody may join the trip.",
    "The state licenses doctors, teachers and plumbers.",
    "The lawyer explained which license would be best for a small company.",
    "Copyright law protects authors of books, films and songs.",
    "The redistribution of seats in parliament took two years.",
    "She studied physics at MIT before she moved to the coast.",
    "The Apache helicopter landed near the old bridge.",
    "A solar eclipse was seen over the general assembly hall.",
    "The gnu is a large antelope of the African plains.",
    "Public transport in the city is free on Sundays.",
    "Version 2 of the report was sent to the members of the foundation.",
    "Software for the source code of the project may be used by any person.",
    "The terms of the contract were published in the general newspaper.",
)

UNKNOWN = "unknown"
WORD = r"[\p{L}\p{N}]+"
#: A family is named from this calibrated probability on.
LEAST_PROBABILITY = 0.5
#: Of the word pairs of the shorter side, a template that confirms shares so many.
LEAST_SHARED = 0.6
#: Lines on each side that a wrapped notice is looked for in before the whole block.
WRAPPED = 1
_SALT = ("page", "see", "the", "2024", "notes", "and", "of", "file", "document", "for", "this", "in", "by", "author", "text")


def words(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


def grams(w: list[str], upto: int = 3) -> set[str]:
    return {" ".join(w[i : i + n]) for n in range(1, upto + 1) for i in range(len(w) - n + 1)}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # by word and family
    bias: np.ndarray
    temperature: float


def _variants(text: str, rng: np.random.Generator, many: int) -> list[set[str]]:
    """Sets of n-grams of the text with words dropped, and words before and after it."""
    w, out = words(text), [grams(words(text))]
    for _ in range(many - 1):
        kept = [x for x in w if rng.random() > 0.08] or w
        around = [[str(x) for x in rng.choice(_SALT, rng.integers(0, 6))] for _ in range(2)]
        out.append(grams([*around[0], *kept, *around[1]]))
    return out


@functools.cache
def trained(seed: int = 11, variants: int = 24, features: int = 4000, steps: int = 200, sparsity: float = 1e-3) -> Model:
    """Fits by proximal gradient descent on names in CARRIERS and on variants of longer notices, then the temperature on names in HELD_CARRIERS, which the fit hasn't seen."""
    rng = np.random.default_rng(seed)
    families = (*NAMES, UNKNOWN)
    samples = [(k, grams(words(c.format(n))), c in HELD_CARRIERS) for k, f in enumerate(NAMES) for n in NAMES[f] for c in (*CARRIERS, *HELD_CARRIERS)]
    longer = [(k, t, i % 4 == 3) for k, f in enumerate(families) for i, t in enumerate(NOTICES.get(f, () if f in NAMES else OTHERS))]
    samples += [(k, v, held) for k, t, held in longer for v in _variants(t, rng, variants)]
    # Carriers alone name nothing.
    samples += [(len(NAMES), grams(words(c.format(x))), c in HELD_CARRIERS) for c in (*CARRIERS[1:], *HELD_CARRIERS) for x in ("", "license", "terms of the contract", "version 2", "public school", "general assembly")]
    often: dict[str, int] = {}
    for _, v, held in samples:
        if not held:
            for g in v:
                often[g] = often.get(g, 0) + 1
    vocabulary = sorted(sorted(often, key=lambda g: (-often[g], g))[:features])
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(samples), len(vocabulary)), np.float32)
    for row, (_, v, _) in enumerate(samples):
        x[row, [place[g] for g in v if g in place]] = 1
    y = np.eye(len(families), dtype=np.float32)[[k for k, _, _ in samples]]
    held = np.array([h for *_, h in samples])
    share = y[~held] / y[~held].sum(0) * len(y[~held]) / len(families)  # families count alike
    row_weight = share.sum(1, keepdims=True)
    w, b, rate = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32), 0.5
    for _ in range(steps):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - y[~held]) * row_weight / len(row_weight)
        w -= rate * (x[~held].T @ p)
        b -= rate * p.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
    z = x[held] @ w + b

    def loss(t: float) -> float:
        q = z / t - (z / t).max(1, keepdims=True)
        return float(-((q - np.log(np.exp(q).sum(1, keepdims=True))) * y[held]).sum())

    temperature = min(np.linspace(0.5, 3, 51), key=loss)
    used = np.flatnonzero(np.abs(w).max(1) > 0)
    return Model(families, tuple(vocabulary[i] for i in used), np.round(w[used].astype(float), 6), np.round(b.astype(float), 6), float(temperature))


def _constant(value, kind: str) -> Column:
    """A literal of any depth; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once: within a lambda's body, an expression would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _paragraph(line: Column, model: Model) -> Column:
    """struct(probability, family, confirmed) of a line."""
    vocabulary = _constant(model.vocabulary, "array<string>")
    rows = _constant(model.weights.tolist(), "array<array<double>>")
    pairs_of = lambda t: sorted({" ".join(p) for p in zip(words(t), words(t)[1:])})
    templates = _constant([[pairs_of(t) for t in TEMPLATES.get(f, ())] for f in model.families], "array<array<array<string>>>")

    def of_words(w: Column) -> Column:
        # Each run of words with the word after it; a single word is its own pair.
        longer = lambda runs, k: F.zip_with(F.slice(runs, 1, F.size(w) - k), F.slice(w, k + 1, F.size(w) - k), lambda a, b: F.concat(a, F.lit(" "), b))
        triples = lambda pairs: F.when(F.size(w) > 2, longer(pairs, 2)).otherwise(pairs)
        return _let(F.when(F.size(w) > 1, longer(w, 1)).otherwise(w), lambda pairs: _let(F.array_intersect(F.flatten(F.array(w, pairs, triples(pairs))), vocabulary), lambda hits: of_hits(hits, pairs)))

    def of_hits(hits: Column, pairs: Column) -> Column:
        add = lambda acc, h: F.zip_with(acc, F.element_at(rows, F.array_position(vocabulary, h).cast("int")), lambda a, b: a + b)
        return _let(F.aggregate(hits, _constant(model.bias.tolist(), "array<double>"), add), lambda logits: of_logits(logits, F.array_distinct(pairs)))

    def of_logits(logits: Column, pairs: Column) -> Column:
        return _let(F.array_max(logits), lambda top: _let(F.array_position(logits, top).cast("int"), lambda best: of_best(logits, top, best, pairs)))

    def of_best(logits: Column, top: Column, best: Column, pairs: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp((z - top) / model.temperature))
        family = F.element_at(_constant(model.families, "array<string>"), best)
        agree = lambda own: F.exists(F.element_at(templates, best), lambda t: F.size(F.array_intersect(own, t)) >= LEAST_SHARED * F.least(F.size(t), F.size(own)))
        sure = (1 / total >= LEAST_PROBABILITY) & (family != UNKNOWN) & _let(pairs, agree)
        return F.struct((1 / total).alias("probability"), family.alias("family"), sure.alias("confirmed"))

    return _let(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)), of_words)


def anchor_pattern() -> str:
    """Where an anchor stands in a text."""
    return f"(?i:{'|'.join(map(re.escape, ANCHORS))}|\\b(?:{'|'.join(map(re.escape, ANCHOR_WORDS))})\\b)|\\b(?:{'|'.join(ANCHOR_NAMES)})\\b"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, licence, probability, families (confirmed ones, sorted), n_paragraphs (with anchors), n_confirmed."""
    model = trained()
    holds = lambda x: F.rlike(x, F.lit(anchor_pattern()))
    # Most texts lack the letters of any anchor, which is found faster than the pattern.
    any_of = lambda x, parts: functools.reduce(lambda a, b: a | b, (F.contains(x, F.lit(a)) for a in parts))
    anchored = (any_of(F.col(text_col), ANCHOR_NAMES) | any_of(sh.ascii_lower(F.col(text_col)), (*ANCHORS, *ANCHOR_WORDS))) & holds(F.col(text_col))

    def of_block(block: Column) -> Column:
        """The results of the lines of a block with an anchor."""
        around = lambda ls, i: F.array_join(F.slice(ls, F.greatest(i + 1 - WRAPPED, F.lit(1)), i + 1 + WRAPPED - F.greatest(i + 1 - WRAPPED, F.lit(1)) + 1), " ")
        lines = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(holds(x), F.struct(x.alias("line"), around(ls, i).alias("near")))), lambda x: x.isNotNull())
        return _let(F.split(block, "\n"), lambda ls: _let(F.transform(lines(ls), of_line), lambda found: F.when((F.size(ls) == 1) | F.forall(found, lambda r: r["confirmed"]), found).otherwise(_let(_paragraph(block, model), lambda w: with_block(found, w)))))

    def of_line(x: Column) -> Column:
        """The line's result; where that isn't confirmed and the line's with its neighbours is, that one."""
        return _let(_paragraph(x["line"], model), lambda alone: F.when(alone["confirmed"] | (x["near"] == x["line"]), alone).otherwise(_let(_paragraph(x["near"], model), lambda w: F.when(w["confirmed"], w).otherwise(alone))))

    def with_block(found: Column, whole: Column) -> Column:
        """The results, those that aren't confirmed replaced by the whole block's where that is."""
        return F.when(whole["confirmed"], F.transform(found, lambda r: F.when(r["confirmed"], r).otherwise(whole))).otherwise(found)

    blocks = F.filter(F.split(F.col(text_col), r"\n[ \t\r]*\n"), holds)
    none = F.array().cast("array<struct<probability:double,family:string,confirmed:boolean>>")
    # Most rows have no anchor; what follows is worked out for the rest.
    base = docs.select(F.col(id_col).alias("doc_id"), F.when(anchored, F.flatten(F.transform(blocks, of_block))).otherwise(none).alias("__found"))
    sure = F.filter("__found", lambda x: x["confirmed"])
    ordered = F.array_sort(F.transform(sure, lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("f"))))
    first = F.try_element_at(ordered, F.lit(1))
    licence = F.when(F.size(sure) > 0, first["f"]).when(F.size("__found") > 0, F.lit(UNKNOWN))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return base.select("doc_id", licence.alias("licence"), F.coalesce(-first["p"], F.lit(0.0)).alias("probability"), families.alias("families"), F.size("__found").cast("long").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_confirmed"))
