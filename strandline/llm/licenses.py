"""Licence scans: a trained classifier of paragraphs, in one projection of built-in functions.

A paragraph's words are read in windows, over line ends, around those with a cue (a stem that notices have). A
window becomes hashed runs of one to three words, and a multinomial logistic regression over them gives each
family's probability, or that of `unknown`. It is fitted on notices in many frames, on other licences, on
sentences that only sound like notices, and on the corpus's own windows that no template confirms. A third of the
rows is kept out of the fit and calibrates it: their likelihood sets the temperature of the probabilities,
and their unknown rows the threshold. A family counts where its probability reaches that threshold and its own
templates confirm it: the window has one of its names, or shares enough runs of three words with one of its notices.
A window that states other versions of the licence only, or says that something is not under it, confirms nothing.
"""

from __future__ import annotations

import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .sampling import least_hashed

#: Notices as their publishers word them.
NOTICES = {
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "cc-by-nc-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd-2-clause": (),  # its sentences are those of bsd-3-clause too
    "all-rights-reserved": (
        "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
        "Unauthorized copying of this file is prohibited under copyright law.",
    ),
}
#: Names and identifiers by which notices call them.
NAMES = {
    "apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache License", "Apache 2.0", "Apache-2.0"),
    "mit": ("MIT License", "MIT Licence", "MIT licensed", "MIT"),
    "gpl-2.0": ("GNU General Public License version 2", "General Public License v2", "GNU GPL version 2", "GPL version 2", "GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "gpl-3.0": ("GNU General Public License version 3", "General Public License v3", "GNU GPL version 3", "GPL version 3", "GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl-3.0": ("Lesser General Public License", "GNU LGPL", "LGPL version 3", "LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-or-later"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC-BY-NC 4.0", "CC BY-NC"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0", "CC-BY 4.0", "CC-BY"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC-BY-SA 4.0", "CC BY-SA"),
    "cc0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause", "BSD-3-Clause", "New BSD License", "BSD License"),
    "mpl-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPLv2"),
    "agpl-3.0": ("GNU Affero General Public License version 3", "Affero General Public License", "GNU AGPL version 3", "GNU AGPL", "AGPL version 3", "AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "isc": ("ISC License", "ISC Licence", "ISC licensed", "ISC"),
    "bsd-2-clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause", "BSD-2-Clause", "Simplified BSD License"),
    "all-rights-reserved": ("All rights reserved",),
}
_NUMBER = r"(\d+(?:\.\d+)*)"
_AS_OF = r"(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?"
_GPL = rf"(?:(?<!lesser )(?<!affero )(?<!library )general public licen[cs]e{_AS_OF}|(?<![al])gpl(?: version| v)?[ -]?v?){_NUMBER}"
#: Where a window's words state a version of a family's licence, and the versions that are the family's.
VERSIONS = {
    "apache-2.0": (rf"(?:apache(?: software)? licen[cs]e(?: version| v)? v?|apache-|under (?:the )?apache v?){_NUMBER}", ("2", "2.0")),
    "gpl-2.0": (_GPL, ("2", "2.0")),
    "gpl-3.0": (_GPL, ("3", "3.0")),
    "lgpl-3.0": (rf"(?:(?:lesser|library) general public licen[cs]e{_AS_OF}|lgpl(?: version| v)?[ -]?v?){_NUMBER}", ("3", "3.0")),
    "agpl-3.0": (rf"(?:affero general public licen[cs]e{_AS_OF}|agpl(?: version| v)?[ -]?v?){_NUMBER}", ("3", "3.0")),
    "cc-by-nc-4.0": (rf"(?:attribution-noncommercial|by-nc)[ -]{_NUMBER}", ("4", "4.0")),
    "cc-by-4.0": (rf"(?:creative commons attribution|cc[ -]by)[ -]{_NUMBER}", ("4", "4.0")),
    "cc-by-sa-4.0": (rf"(?:attribution-sharealike|by-sa)[ -]{_NUMBER}", ("4", "4.0")),
    "cc0-1.0": (rf"cc0[ -]{_NUMBER}", ("1", "1.0")),
    "mpl-2.0": (rf"(?:mozilla public licen[cs]e(?: version| v)? v?|mpl(?: version| v)?[ -]?v?){_NUMBER}", ("2", "2.0")),
    "bsd-3-clause": (r"(\d)-clause", ("3",)),
    "bsd-2-clause": (r"(\d)-clause", ("2",)),
}
#: Sentences around a name. {} is the name; of the family all-rights-reserved the name stands alone.
FRAMES = (
    "SPDX-License-Identifier: {}", "License: {}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.",
    "This project is licensed under the {}, see the LICENSE file.", "This work is licensed under the {}.", "The library is made available, as licensed software, under the {}.",
    "Code is {} licensed.", "You may use it under the license terms of the {}.", "Published under a {} license.", "license = {}", "The data are licensed {}.",
)
#: Around the name of a family that notices claim without a licence.
CLAIMS = ("{}.", "Copyright 2019 Example Corp. {}.", "Copyright (c) the authors. {}.", "(c) 2021 Some Publisher, {}")
#: Other licences, which are unknown here.
OTHERS = ("Eclipse Public License", "EPL-2.0", "European Union Public Licence", "Artistic License", "Zlib", "Unlicense", "Boost Software License", "GFDL", "Open Font License", "commercial", "Example Corp end user agreement", "proprietary", "site", "trial", "master services agreement")
#: Sentences that only sound like notices; {} is a word.
PROSE = (
    "You need a driving licence to rent a {}.", "She asked for permission to leave the {}.", "The fishing license costs ten {}.", "Copyright law is a branch of {} law.", "He is a licensed {}.",
    "Permission denied: {}", "The licence fee for the {} rose this year.", "The table was reserved for a {}.", "It came with a warranty of two {}.", "Parking is permitted on {} only.", "The commons of the {} were open to all.",
    "Students at MIT asked for permission to use the {}.", "The apache helicopter needs a licensed {}.", "They redistributed the {} among the poor.", "The {} reserved all rights to the field.", "Copyright infringement suits about the {} continued.",
)
#: Stems that words of notices have.
CUES = ("licen", "lizen", "copyright", "permission", "permitted", "redistribut", "reserved", "warrant", "spdx", "gpl", "cc0", "cc-by", "mozilla", "apache", "released", "commons")

SLOTS = 1 << 13
CONFIRMED = 0.5
#: Most windows of the corpus that the unknown class is learnt from.
MOST_WINDOWS = 4_000
#: Words of a window: the block that has a cue, and its surroundings on either side.
BLOCK, AROUND = 8, 8
#: Words behind a window in which the version of a name at its end may stand.
BEHIND = 12
#: How often the unknown class weighs as much as a family in the fit; what passes is up to the threshold.
UNKNOWN = 4
#: Share of unknown rows that calibration lets pass as a family.
WRONG = 0.005


class Scanner(NamedTuple):
    families: tuple[str, ...]
    weights: np.ndarray  # unknown first, then the families; slots in rows. Divided by the temperature, as is the bias.
    bias: np.ndarray
    threshold: float


def words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def runs(found: Column, n: int) -> Column:
    last = F.size(found) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(found, i, F.lit(n)), " ")))


def slots(found: Column) -> Column:
    """The distinct slots of a window's runs of one to three words."""
    return F.array_distinct(F.transform(F.concat(*[runs(found, n) for n in (1, 2, 3)]), lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int")))


def has_cue(lowered: Column) -> Column:
    test = lowered.contains(CUES[0])
    for cue in CUES[1:]:
        test = test | lowered.contains(cue)
    return test


def windows(text: Column) -> Column:
    """(paragraph, block, words, behind) of each block of a paragraph's words that has a cue; blank lines part paragraphs.

    The words are the block's and AROUND more on either side, so every cue stands among as many at least; behind are the next ones.
    """

    def of_words(at: Column, found: Column) -> Column:
        blocks = F.filter(F.sequence(F.lit(0), F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.exists(F.slice(found, b * BLOCK + 1, F.lit(BLOCK)), has_cue))

        def cut(b: Column) -> Column:
            first = F.greatest(b * BLOCK + 1 - AROUND, F.lit(1))
            after = b * BLOCK + BLOCK + AROUND + 1
            return F.struct(at.alias("paragraph"), b.alias("block"), F.slice(found, first, after - first).alias("words"), F.slice(found, after, F.lit(BEHIND)).alias("behind"))

        return F.transform(blocks, cut)

    numbered = F.filter(F.transform(F.split(text, r"\n[^\S\n]*\n"), lambda x, i: F.struct(i.alias("at"), x.alias("text"))), lambda x: has_cue(F.lower(x["text"])))
    return F.flatten(F.transform(numbered, lambda x: let(words(x["text"]), lambda found: of_words(x["at"], found))))


def _padded(text: str) -> str:
    """A name's words as they stand in a window: lower case, parted by one blank, with one on either side."""
    return " " + " ".join(text.lower().replace(",", "").split()) + " "


def likeness(found: Column, family: str) -> Column:
    """1 if the window has one of the family's names, else the largest share of runs of three words in common with a notice."""
    joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    named = F.lit(False)
    for name in NAMES[family]:
        named = named | joined.contains(_padded(name))

    def shared(threes: Column) -> Column:
        shares = [F.lit(0.0)]  # and of a family without notices
        for notice in NOTICES[family]:
            theirs = F.array_distinct(runs(words(F.lit(notice)), 3))
            common = F.size(F.array_intersect(threes, theirs)).cast("double")
            shares.append(F.greatest(common / F.greatest(F.size(threes), F.lit(1)), common / F.greatest(F.size(theirs), F.lit(1))))
        return F.greatest(*shares, F.lit(0.0))

    return F.when(named, F.lit(1.0)).otherwise(let(F.array_distinct(runs(found, 3)), shared))


def stated(found: Column, behind: Column, family: str) -> Column:
    """The versions of a family's licence that a window states, as an array; a name at its end may have its version behind it."""
    if family not in VERSIONS:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.array_join(F.concat(found, behind), " "), F.lit(VERSIONS[family][0]), F.lit(1))


def denial(family: str) -> str:
    """A pattern of words that say that something is not under a licence, in English, German, French and Spanish."""
    names = "|".join(_padded(n).strip().replace(".", r"\.") for n in NAMES[family])
    return rf" (?:not|never|no longer|nicht|pas|plus|no)(?: \S+){{0,2}} (?:under|unter|sous|bajo)(?: \S+){{0,3}}? (?:{names}) "


def contradicted(found: Column, behind: Column, family: str) -> Column:
    """Whether a window states versions of the licence, none of them the family's, or denies the licence."""
    joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    denied = joined.rlike(denial(family)) if family != "all-rights-reserved" else F.lit(False)
    if family not in VERSIONS:
        return denied
    own = F.array(*[F.lit(v) for v in VERSIONS[family][1]])
    return let(stated(found, behind, family), lambda x: (F.size(x) > 0) & ~F.arrays_overlap(x, own)) | denied


def _around(rng: random.Random, text: str) -> str:
    """The text among other words, as a window may hold it: invented ones and common ones; and without a word in fourteen."""

    def filler() -> list[str]:
        invented = lambda: "".join(rng.choices(("ba", "ent", "ing", "or", "la", "the", "s", "ti", "er", "ou", "m", "ré"), k=rng.randint(2, 5)))
        common = ("see", "file", "note", "this", "the", "project", "code", "by", "2021", "author", "works", "and", "data", "of", "for", "in", "readme", "source", "all", "to", "is", "la", "de", "et", "der", "und", "el", "en")
        return [invented() if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.choice((0, 3, AROUND, 2 * AROUND)))]

    kept = [w for w in text.split() if rng.random() > 0.07]
    return " ".join([*filler(), *kept, *filler()])


def examples(seed: int = 1) -> list[tuple[int, str]]:
    """(label, text): 0 for unknown, else the family's number from 1. Every family has as many."""
    rng = random.Random(seed)
    rows = []
    for i, (family, names) in enumerate(NAMES.items()):
        for turn in range(240):
            frames = CLAIMS if family == "all-rights-reserved" else FRAMES
            text = rng.choice(NOTICES[family]) if turn % 4 == 0 and NOTICES[family] else rng.choice(frames).format(names[turn % len(names)])
            rows.append((i + 1, text if turn % 5 == 0 else text.upper() if turn % 15 == 1 else _around(rng, text)))
    pool = [w for ts in NOTICES.values() for t in ts for w in t.split()]
    things = ("car", "boat", "lake", "tree", "market", "garden", "plumber", "house", "years", "days", "weekends", "dollars", "family", "film", "song", "port")
    for turn in range(500):
        rows.append((0, _around(rng, rng.choice(PROSE).format(rng.choice(things)))))
        rows.append((0, _around(rng, rng.choice(FRAMES).format(rng.choice(OTHERS)))))
        rows.append((0, _around(rng, " ".join(rng.sample(pool, rng.randint(3, 25))))))
        if turn % 5 == 0:  # a family's name, but not as a notice
            rows.append((0, _around(rng, "the " + rng.choice(things) + " of " + rng.choice(("apache", "mit", "bsd", "mozilla", "gnu", "creative commons")) + " " + rng.choice(things) + " without permission")))
    return rows


def train(spark: SparkSession, docs: DataFrame | None = None, most_windows: int = MOST_WINDOWS, seed: int = 1) -> Scanner:
    """Fits the scanner on `examples` and, as unknown, on windows of `docs` that no template confirms.

    Of these, distinct ones, at most `most_windows` of least hash; everything else in the fit has a fixed size.
    """
    families = tuple(NAMES)
    rows = examples(seed)
    if docs is not None:
        own = docs.filter(has_cue(F.lower("text"))).select(F.explode(windows(F.col("text"))).alias("w")).select(F.col("w.words").alias("words"))
        unlike = own.filter(F.greatest(*[likeness(F.col("words"), f) for f in families]) < CONFIRMED)
        rows += [(0, " ".join(r["words"])) for r in least_hashed(unlike, most_windows, "words", distinct=True).collect()]
    table = spark.createDataFrame(rows, "label int, text string").select("label", slots(words(F.col("text"))).alias("slots")).collect()
    table = [r for r in table if r["slots"]]
    kept_out = np.random.default_rng(seed).random(len(table)) < 1 / 3
    w, b = _fitted([r for r, out in zip(table, kept_out, strict=True) if not out], len(families) + 1)
    held = [r for r, out in zip(table, kept_out, strict=True) if out]
    z = np.array([w[r["slots"]].sum(axis=0) / np.sqrt(len(r["slots"])) + b for r in held])
    y = np.array([r["label"] for r in held])

    def chances(heat: float) -> np.ndarray:
        e = np.exp(z / heat - (z / heat).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    heat = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(chances(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = chances(heat)
    # The least threshold, a half or more, at which all but WRONG of the unknown rows stay unknown.
    wrong = np.where(p.argmax(axis=1) > 0, p.max(axis=1), 0.0)[y == 0]
    return Scanner(families, w / heat, b / heat, float(np.clip(np.quantile(wrong, 1 - WRONG, method="higher"), 0.5, 0.99)))


def _fitted(table: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of k classes by descent with momentum on the mean loss, each class weighing the same."""
    y = np.array([r["label"] for r in table])
    size = np.array([len(r["slots"]) for r in table])
    at, first = np.repeat(np.arange(len(y)), size), np.cumsum(size) - size
    slot = np.concatenate([np.array(r["slots"], dtype="int64") for r in table])
    by_slot = np.argsort(slot, kind="stable")
    used, used_first = np.unique(slot[by_slot], return_index=True)
    scale = 1 / np.sqrt(size)
    truth = np.eye(k)[y]
    balance = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y]
    balance[y == 0] *= UNKNOWN
    balance /= balance.mean()
    w, b = np.zeros((SLOTS, k)), np.zeros(k)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        z = np.add.reduceat(w[slot], first) * scale[:, None] + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - truth) * balance[:, None] / len(y)
        gw = np.zeros_like(w)
        gw[used] = np.add.reduceat((g * scale[:, None])[at[by_slot]], used_first)
        speed_w, speed_b = 0.9 * speed_w - 20 * (gw + 1e-5 * w), 0.9 * speed_b - 2 * g.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return w, b


def _literal(values: np.ndarray) -> Column:
    """A constant array of doubles; one literal in the plan."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values.tolist())), ",").cast("array<double>")


def judged(found: Column, behind: Column, scanner: Scanner) -> Column:
    """A struct of family, probability and likeness for a window's words; unknown where nothing is sure.

    The likeness of a family that the window contradicts is 0.
    """
    names = ("unknown", *scanner.families)

    def with_slots(own: Column) -> Column:
        scale = 1 / F.sqrt(F.greatest(F.size(own), F.lit(1)).cast("double"))

        def logits(i: int) -> Column:
            table = _literal(scanner.weights[:, i])
            return F.aggregate(own, F.lit(0.0), lambda a, s: a + F.get(table, s)) * scale + F.lit(float(scanner.bias[i]))

        def chosen(z: Column) -> Column:
            top = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
            return let(F.struct(F.array_position(z, top).cast("int").alias("at"), (1 / total).alias("p")), confirmed)

        return let(F.array(*[logits(i) for i in range(len(names))]), chosen)

    def confirmed(best: Column) -> Column:
        like = None
        for i, f in enumerate(scanner.families):
            agrees = F.when(contradicted(found, behind, f), 0.0).otherwise(likeness(found, f))
            like = F.when(best["at"] == i + 2, agrees) if like is None else like.when(best["at"] == i + 2, agrees)

        def verdict(x: Column) -> Column:
            sure = (best["at"] > 1) & (best["p"] >= F.lit(scanner.threshold)) & (x >= F.lit(CONFIRMED))
            family = F.when(sure, F.element_at(F.array(*[F.lit(n) for n in names]), best["at"])).otherwise(F.lit("unknown"))
            return F.struct(family.alias("family"), best["p"].alias("probability"), x.alias("likeness"))

        return let(F.coalesce(like, F.lit(0.0)), verdict)

    return let(slots(found), with_slots)


def license_scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """`docs` and the column licenses: for each window its paragraph and block from 0, family, probability and likeness.

    A notice that states no version counts for the family of its name; one that states another is unknown. A notice of
    many words can fill more than one window. Null and empty texts, and texts without a cue, have none;
    a text of any length is read whole. All other columns stay, but one already named licenses is replaced. Repeated
    rows are judged alike; an empty table stays empty.
    """
    kind = "array<struct<paragraph:int,block:int,family:string,probability:double,likeness:double>>"
    body = F.col("text")
    fields = lambda x, j: F.struct(x["paragraph"].alias("paragraph"), x["block"].alias("block"), *[j[f].alias(f) for f in ("family", "probability", "likeness")])
    found = F.transform(windows(body), lambda x: let(judged(x["words"], x["behind"], scanner), lambda j: fields(x, j)))
    value = F.when(has_cue(F.lower(body)), found).otherwise(F.array().cast(kind))
    return docs.withColumn("licenses", F.coalesce(value, F.array().cast(kind)))
