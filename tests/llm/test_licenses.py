import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import licenses
from strandline.llm.common import documents

#: Wordings that no example of the training has as a whole.
UNSEEN = {
    "apache-2.0": ("SPDX-License-Identifier: Apache-2.0 OR whatever", "Licensed under Apache 2.0", "This tool is distributed under the Apache License, Version 2.0.", "Our code is covered by the Apache License 2.0; see NOTICE.", "licensed, as ever,\nunder the Apache\nLicense, version 2.0"),
    "mit": ("SPDX-License-Identifier: MIT and more", "MIT licensed. Written 2020 by Jane Roe.", "The package is free to use under the MIT license", 'The software is provided "as is", without warranty of any kind, express or implied', "permission is granted, free of charge,\nto any person obtaining a copy\nof this software"),
    "gpl-3.0": ("licensed under the GNU GPL v3", "This is GPL-3.0-or-later licensed", "you can copy it under the terms of the GNU General Public License version 3 license"),
    "gpl-2.0": ("Distributed under the GPL v2 license", "licensed under GPLv2, no later", "It is under the terms of the GNU GPL version 2"),
    "lgpl-3.0": ("distributed under the GNU Lesser General Public License", "Licensed under LGPLv3, like the rest", "made available with the LGPL-3.0 license"),
    "cc-by-nc-4.0": ("Images are licensed CC-BY-NC-4.0", "text available under a Creative Commons Attribution-NonCommercial 4.0 license", "all photos licensed under CC BY-NC 4.0 here"),
    "cc-by-4.0": ("code is CC-BY-4.0 licensed", "Content is available under CC BY 4.0 license", "Text under Creative Commons Attribution 4.0 license"),
    "cc-by-sa-4.0": ("Text is licensed under CC BY-SA 4.0", "Dieses Werk steht unter der Lizenz CC BY-SA 4.0", "shared under a Creative Commons Attribution-ShareAlike 4.0 license", "our license: CC-BY-SA-4.0"),
    "cc0-1.0": ("Dedicated under CC0 1.0 Universal", "data are released under CC0", "license of all data: CC0-1.0"),
    "bsd-3-clause": ("Distributed under the BSD license", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met", "see the terms of the BSD-3-Clause license"),
    "mpl-2.0": ("subject to the Mozilla Public License 2.0", "under license MPL 2.0", "This file is subject to the terms of the\nMozilla Public License, v. 2.0"),
    "agpl-3.0": ("This server is licensed under the GNU Affero General Public License version 3.", "AGPL-3.0-or-later license", "you can redistribute it under the terms of the GNU AGPL v3"),
    "isc": ("Our small tool is ISC licensed.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "bsd-2-clause": ("Distributed under the BSD-2-Clause license", "license: 2-Clause BSD License"),
    "all-rights-reserved": ("All rights reserved.", "Copyright 2022 by the publisher. All rights reserved.", "(c) A. Body -- all rights reserved"),
    "unknown": (
        "The licensed driver had a permission slip.", "License\nlicence and copyright", "SPDX-License-Identifier: EPL-2.0", "Distributed under the Artistic License 2.0",
        "Licensed under the terms of the customer agreement", "MIT granted permission to the students", "the museum reserved a room without permission", "warranty of two years", "The driver license was renewed in May",
        "under the GNU Lesser General Public License version 2.1", "Licensed under the Apache License, Version 1.1", "subject to the Mozilla Public License 1.1", "Images are licensed CC BY-NC 2.5", "license: LGPL-2.1-or-later",
        "Not licensed under the MIT License.", "It is not released under Apache 2.0 any more.", "Diese Bibliothek steht nicht unter der MIT License.",
        "one two three four five licensed eleven twelve a b c d e the Mozilla Public License version 1.1",
        "He holds a pilot licence and a copyright on his song.", "The room was reserved; no permission needed.", "Apache helicopters are not permitted here", "x" * 20_000 + " license", "Licensed under the " * 3000,
    ),
}


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.train(spark, documents(spark, "/root/testdata/sf0.001"))


def test_unseen_wordings(spark, scanner):
    rows = [(family, text) for family, texts in UNSEEN.items() for text in texts]
    docs = spark.createDataFrame(rows, "family string, text string").coalesce(2)
    right = claimed = 0
    for r in licenses.license_scan(docs, scanner).collect():
        found = {x.family for x in r.licenses} - {"unknown"}
        if found != {r.family} - {"unknown"}:
            print(r.family, found, r.text[:80], [(x.probability, x.likeness) for x in r.licenses][:2])
        claimed += len(found)
        right += r.family in found
    known = sum(family != "unknown" for family, _ in rows)
    assert right >= 0.9 * known and right >= 0.95 * claimed, (right, claimed, known)


def test_every_notice_and_name_can_be_found(spark):
    notices = [t for ts in licenses.NOTICES.values() for t in ts]
    framed = [f.format(n) for family, names in licenses.NAMES.items() for n in names for f in (licenses.CLAIMS if family == "all-rights-reserved" else licenses.FRAMES)]
    assert all(any(c in t.lower() for c in licenses.CUES) for t in [*notices, *framed])


def brute_windows(text):
    for at, paragraph in enumerate(re.split(r"\n[^\S\n]*\n", text)):
        found = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", paragraph.lower())
        for b in range(-(-len(found) // licenses.BLOCK)):
            own = found[b * licenses.BLOCK : (b + 1) * licenses.BLOCK]
            if any(c in w for w in own for c in licenses.CUES):
                after = (b + 1) * licenses.BLOCK + licenses.AROUND
                yield at, b, found[after : after + licenses.BEHIND], found[max(b * licenses.BLOCK - licenses.AROUND, 0) : after]


def grams(found, n):
    return [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]


def brute_contradicted(found, behind, family):
    pattern, own = licenses.VERSIONS.get(family, (None, ()))
    numbers = re.findall(pattern, " ".join([*found, *behind])) if pattern else []
    denied = family != "all-rights-reserved" and re.search(licenses.denial(family), f" {' '.join(found)} ")
    return bool((numbers and not set(numbers) & set(own)) or denied)


def brute_likeness(found, family):
    if any(" " + " ".join(n.lower().replace(",", "").split()) + " " in " " + " ".join(found) + " " for n in licenses.NAMES[family]):
        return 1.0
    own, best = set(grams(found, 3)), 0.0
    for notice in licenses.NOTICES[family]:
        theirs = set(grams(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", notice.lower()), 3))
        best = max(best, len(own & theirs) / max(len(own), 1), len(own & theirs) / max(len(theirs), 1))
    return best


def test_scan_equals_brute_force(spark, scanner):
    """Windows, the sums of the weights, the softmax and the confirmation anew in Python; only the slots' hash is Spark's."""
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    more = [(10_000 + i, t) for i, ts in enumerate(UNSEEN.values()) for t in ts if len(t) < 1000]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string").coalesce(1))
    rows = [(r.text, r.licenses) for r in licenses.license_scan(docs, scanner).collect()]
    every = {tuple(w) for t, _ in rows for *_, w in brute_windows(t or "")}
    all_grams = sorted({g for w in every for n in (1, 2, 3) for g in grams(list(w), n)})
    slot = {r.g: r.s for r in spark.createDataFrame([(g,) for g in all_grams], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(licenses.SLOTS)).cast("int").alias("s")).collect()}
    assert every
    for text, found in rows:
        want = []
        for at, b, behind, w in brute_windows(text or ""):
            own = sorted({slot[g] for n in (1, 2, 3) for g in grams(w, n)})
            z = scanner.weights[own].sum(axis=0) / np.sqrt(max(len(own), 1)) + scanner.bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            best = ("unknown", *scanner.families)[int(p.argmax())]
            like = 0.0 if best == "unknown" or brute_contradicted(w, behind, best) else brute_likeness(w, best)
            sure = p.max() >= scanner.threshold and like >= licenses.CONFIRMED
            want.append((at, b, best if sure else "unknown", float(p.max()), like))
        assert [(x.paragraph, x.block, x.family) for x in found] == [x[:3] for x in want]
        assert np.allclose([(x.probability, x.likeness) for x in found], [x[3:] for x in want], atol=1e-6) if want else not found


def test_odd_rows(spark, scanner):
    rows = [(1, None), (2, ""), (3, "no such stem"), (None, "Released under the MIT License."), (4, "word " * 100_000 + "\n\nReleased under the MIT License."), (5, "Released under the MIT License."), (5, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(1))
    found = {}
    for r in licenses.license_scan(docs, scanner).collect():
        found.setdefault(r.doc_id, []).append([x.family for x in r.licenses])
    assert found == {1: [[]], 2: [[]], 3: [[]], None: [["mit"]], 4: [["mit"]], 5: [["mit"], ["mit"]]}
    assert licenses.license_scan(docs.limit(0), scanner).count() == 0


def test_training_sample_is_distinct_and_bounded(spark):
    texts = ["The fishing licence of the king"] * 500 + [f"The copyright of number {i} is disputed" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, two = licenses.train(spark, docs, most_windows=20), licenses.train(spark, docs, most_windows=20)
    assert zlib.crc32(one.weights.tobytes()) == zlib.crc32(two.weights.tobytes()) and 0.5 <= one.threshold < 1


def test_versions_and_denials(spark):
    cases = {
        ("lgpl-3.0", "the gnu lesser general public license version 2.1"): True,
        ("lgpl-3.0", "the gnu lesser general public license"): False,
        ("lgpl-3.0", "gpl-2.0 and lgpl-3.0-only"): False,
        ("apache-2.0", "apache license version 1.1"): True,
        ("apache-2.0", "apache license version 1.1 or apache license version 2.0"): False,
        ("apache-2.0", "a module of apache 2.4 under the apache license"): False,
        ("gpl-3.0", "general public license as published by the free software foundation either version 2 of the license"): True,
        ("gpl-2.0", "general public license as published by the free software foundation either version 2 of the license"): False,
        ("gpl-3.0", "lgpl-2.1 and gplv3"): False,
        ("mpl-2.0", "mozilla public license v 2.0"): False,
        ("cc-by-4.0", "cc by 3.0"): True,
        ("cc-by-4.0", "cc by-sa 3.0 and cc-by"): False,
        ("bsd-3-clause", "bsd-2-clause"): True,
        ("mit", "not licensed under the mit license"): True,
        ("mit", "not under apache 2.0 at all the rest is mit licensed"): False,
        ("mit", "ne sont pas sous licence mit"): True,
    }
    rows = [(f, t.split()) for f, t in cases]
    df = spark.createDataFrame(rows, "family string, words array<string>")
    for family in {f for f, _ in cases}:
        got = df.filter(F.col("family") == family).select("words", licenses.contradicted(F.col("words"), F.array().cast("array<string>"), family).alias("x")).collect()
        for r in got:
            assert r.x is cases[family, " ".join(r.words)], (family, r.words)
            assert brute_contradicted(r.words, [], family) is r.x
