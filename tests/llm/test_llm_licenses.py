"""Headers, identifiers, titles and whole texts of licences, versions, and the exactness of anchors."""

import math
import random
import re

import pytest

from tillscope.llm import license_notices as notices
from tillscope.llm import licenses

GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
import os"""

CASES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: Zlib": None,
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n": "GPL-2.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1",
    GPL_HEADER.format(2): "GPL-2.0",
    GPL_HEADER.format(3): "GPL-3.0",
    GPL_HEADER.format(3).replace("General", "Affero General"): "AGPL-3.0",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause",
    "The code came from elsewhere long ago and was mended often. Released under the MIT License. Ask before any use.": "MIT",
    "Licensed under CC BY 3.0": "CC-BY-3.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
    "Der Weg mit dem Rad ist weit, und mit dem Zug ist er kurz.": None,
    "mit.": None,
    "All rights reserved.": None,
    "": None,
}


def found(spark, texts, path="src/x.py"):
    files = spark.createDataFrame([(i, f"{i}/{path}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return {r["doc_id"]: r["license"] for r in licenses.scan_licenses(files).collect()}


def test_headers_identifiers_and_titles(spark):
    got = found(spark, CASES)
    assert {text: got[i] for i, text in enumerate(CASES)} == CASES


def wrapped(text):
    return "\n".join(re.findall(r".{1,70}(?: |$)", text))


@pytest.mark.parametrize("path", ["src/x.py", "LICENSE.txt"])
def test_bodies_in_files_and_headers(spark, path):
    bodies = {
        "MIT": "MIT License\n\nCopyright (c) 2020 A. Nother\n\n" + wrapped(notices.MIT_GRANT) + "\n\n" + wrapped(notices.MIT_REST),
        "ISC": "Copyright 2020 A. Nother\n\n" + wrapped(notices.ISC) + "\n\n" + wrapped(notices.ISC_REST),
        "Apache-2.0": "Copyright 2020 A. Nother\n\n" + wrapped(notices.APACHE) + "\n\n" + wrapped(notices.APACHE_REST),
        "BSD-2-Clause": wrapped(notices.BSD_GRANT) + "\n" + wrapped(notices.BSD_REST),
        "BSD-3-Clause": wrapped(notices.BSD_GRANT) + "\n" + wrapped(notices.BSD_NAMES) + "\n" + wrapped(notices.BSD_REST),
        "MPL-2.0": wrapped(notices.MPL),
    }
    got = found(spark, bodies.values(), path)
    assert [got[i] for i in range(len(bodies))] == list(bodies)


def test_very_long_texts_and_ties(spark):
    long = "word and another " * 60_000
    got = found(spark, [f"{long}\nReleased under the MIT License", f"{long}. Released under the MIT License. {long}", long])
    assert got == {0: "MIT", 1: "MIT", 2: None}
    # Templates with the same words: the earlier one.
    twins = [("first", "alpha beta gamma", ()), ("second", "gamma beta alpha", ())]
    files = spark.createDataFrame([(1, "a/x", "alpha beta gamma")], "doc_id long, path string, text string")
    assert licenses.scan_licenses(files, twins).first()["license"] == "first"
    assert licenses.scan_licenses(files, []).first()["license"] is None


def plain_cosines(text):
    """Cosine to each template, by its definition."""
    rarity, vectors = licenses.template_weights(licenses.TEMPLATES)
    unknown = math.log(1 + len(licenses.TEMPLATES)) + 1
    own = {t: (1 + math.log(n)) * rarity.get(t, unknown) for t, n in licenses.terms_of(text).items()}
    norm = math.sqrt(sum(w * w for w in own.values())) or 1
    return [sum(w * vector.get(t, 0) for t, w in own.items()) / norm for vector in vectors]


def test_passages_without_anchors_are_like_no_template():
    draw = random.Random(5)
    pattern = re.compile(licenses.anchor_pattern(licenses.TEMPLATES))
    like = 0
    for _ in range(4000):
        name, text, needs = draw.choice(licenses.TEMPLATES)
        words = [w for w in text.lower().split() if draw.random() < draw.choice((0.3, 0.6, 0.9))]
        passage = " ".join(words + ["xyzzy"] * draw.randrange(2))
        terms = set(licenses.terms_of(passage))
        hits = [
            cosine >= licenses.LIKE and all(terms & set(group) for group in template[2])
            for cosine, template in zip(plain_cosines(passage), licenses.TEMPLATES, strict=True)
        ]
        like += any(hits)
        assert pattern.search(passage) or not any(hits)
    assert like > 500


def test_cosines_equal_the_plain_ones(spark):
    texts = [t for t in CASES if t]
    files = spark.createDataFrame([(i, f"{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    for row in licenses.scan_licenses(files).where("license is not null").collect():
        text = texts[row["doc_id"]].lower()
        blocks = re.split(licenses.EMPTY_LINES, text)
        parts = [p for b in blocks for p in (b, *b.split("\n"), *re.sub(licenses.SENTENCE_END, "\\1\x01\\2", b).split("\x01"))]
        named = [i for i, t in enumerate(licenses.TEMPLATES) if t[0] == row["license"]]
        assert any(abs(plain_cosines(p)[i] - row["cosine"]) < 2e-6 for p in parts for i in named)
