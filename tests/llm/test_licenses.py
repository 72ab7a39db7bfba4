"""Verbatim licence texts, licence lines of the tables, and the scan against brute force."""

import random
import re
import textwrap

from brindle.llm import licenses

GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
GPL2 = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
)
NC = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
VERBATIM = [
    ("MIT", GRANT),
    ("MIT", "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."),
    ("GPL-2.0", GPL2 + "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."),
    ("GPL-3.0", GPL2.replace(";", ":", 1).replace("version 2", "version 3")),
    ("LGPL-2.1", GPL2.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC-BY-NC-4.0", NC),
    ("CC-BY-NC-SA-4.0", NC.replace("Commercial", "Commercial-ShareAlike")),
    ("CC-BY-ND-4.0", NC.replace("NonCommercial", "NoDerivatives")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", NC + " To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/"),
    # As they stand in the documents.
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (None, "All rights reserved."),
]


def wrapped(text):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), 60) for p in text.split("\n\n"))


def test_verbatim_texts(spark):
    rows = [(i, f"Some words before.\n\n{form(text)}\n\nsome words after") for i, (_, text) in enumerate(VERBATIM) for form in (str, wrapped)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert [(VERBATIM[r["doc_id"]], r["best_license"]) for r in found if r["best_license"] != VERBATIM[r["doc_id"]][0]] == []


def test_every_template_is_found_whole_and_altered(spark):
    rng = random.Random(1)
    known = [(name, set(licenses.template_bigrams(text))) for name, text in licenses.TEMPLATES]
    rows = []
    for _, text in licenses.TEMPLATES:
        for odds in (0, 0.04, 0.08, 0.12):
            words = text.split()
            rows.append((len(rows), " ".join(rng.choice(("zz", w + " yy", "")) if rng.random() < odds else w for w in words)))
    want = {}
    for i, text in rows:
        w = re.sub(r"[\W_]+", " ", text.lower()).split()
        own = {f"{a} {b}" for a, b in zip(w, w[1:])}
        scores = [(2.0 * len(own & b) / (len(own) + len(b)), name) for name, b in known]
        hits = [s for s in scores if s[0] >= licenses.THRESHOLD]
        top = max(hits, default=(None,))[0]
        want[i] = (",".join(sorted({n for _, n in hits})), min((n for d, n in hits if d == top), default=None), top)
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["licenses"], r["best_license"], r["best_dice"]) for r in found} == want
    assert sum(w[1] is None for w in want.values()) > 5
