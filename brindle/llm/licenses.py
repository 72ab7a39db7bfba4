"""Licence scan, in DataFrame functions only.

Texts are normalised (lower case, anything but letters, digits and line ends as one blank) and cut
into lines, and where a paragraph has several lines, paragraphs too. A unit matches a licence
template if the Dice coefficient of their sets of word bigrams is at least THRESHOLD. Only templates
of a size that can reach it are compared: with t the threshold, a template of b bigrams needs a unit
of b*t/(2-t) to b*(2-t)/t. The templates are constants; nothing is shuffled.

Defined cases: a null or empty text has no units and no match. Units of a single word have no
bigrams and match nothing. Of equal coefficients the first licence by name is the best. Repeated
rows are reported one by one. A statement whose coefficient reaches the threshold for several
licences lists them all (one of CC-BY-NC-4.0 lists CC-BY-4.0 too); the best is the one it states.
'All rights reserved.' places a work under no licence and matches none. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

CC = "Creative Commons Attribution"
CC_KINDS = [("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")]


def creative_commons(kind: str, title: str) -> list[tuple[str, str]]:
    """Short, long and whole notices of one of the 4.0 licences, and the first paragraph of its legal code."""
    url = f"http://creativecommons.org/licenses/{kind.lower()}/4.0/"
    long = f"This work is licensed under a {CC}{title} 4.0 International License."
    forms = [
        f"Licensed under CC {kind} 4.0.",
        f"This work is licensed under CC {kind} 4.0.",
        f"Licensed under a {CC}{title} 4.0 International License.",
        long,
        f"{long} To view a copy of this license, visit {url}.",
        f"{long} To view a copy of this license, visit {url} or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {CC}{title} 4.0 International Public License (\"Public License\"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of such terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions.",
    ]
    return [(f"CC-{kind}-4.0", text) for text in forms]


def gnu(kind: str, work: str, version: str, stop: str = ";") -> str:
    return f"This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


# Statements by which works are placed under a licence, and its grant and notice paragraphs.
# BSD-2-Clause's paragraphs are all BSD-3-Clause's too and are reported as that; what both versions of
# the GPL say is GPL-3.0's, so that it never outranks a version 2 statement of the same text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", gnu("Affero General Public License", "program", "3", ":")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC0-1.0", "2. Waiver. To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action, whether now known or unknown (including existing as well as future claims and causes of action), in the Work (i) in all territories worldwide, (ii) for the maximum duration provided by applicable law or treaty (including future time extensions), (iii) in any current or future medium and for any number of copies, and (iv) for any purpose whatsoever, including without limitation commercial, advertising or promotional purposes (the \"Waiver\")."),
    ("GPL-2.0", gnu("General Public License", "program", "2")),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", gnu("Lesser General Public License", "library", "2.1")),
    ("LGPL-3.0", gnu("Lesser General Public License", "library", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]
TEMPLATES += [t for kind in CC_KINDS for t in creative_commons(*kind) if t not in TEMPLATES]


COMMON = frozenset("a all an and any are as at be by can following for from has have if in including is it may not obtain of on one or our other provided public see so such source that the these this to under use version view visit with without work you your".split())


def template_bigrams(text: str) -> list[str]:
    kept = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return sorted({f"{a} {b}" for a, b in zip(kept, kept[1:])})


def needed_words(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that matches a template holds one.

    A match shares b*t/(2-t) of a template's b bigrams at least. So if the bigrams without any of some
    words are fewer, a unit without these words can't match. COMMON words are taken last.
    """
    picked: list[str] = []
    while True:
        gains: dict[str, int] = {}
        for own in {tuple(b) for _, b in known}:
            free = [g for g in own if not any(w in picked for w in g.split())]
            if own and len(free) >= len(own) * threshold / (2 - threshold):
                for g in free:
                    for w in set(g.split()):
                        gains[w] = gains.get(w, 0) + 1
        if not gains:
            return picked
        picked.append(max(gains, key=lambda w: (w not in COMMON and not w.isdigit(), gains[w], w)))


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_matches, licenses (names, sorted, comma-joined), best_license and best_dice of each row of docs."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    low = min(len(b) for _, b in known) * threshold / (2 - threshold)
    high = max(len(b) for _, b in known) * (2 - threshold) / threshold
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    paragraphs = F.transform(F.filter(F.split("norm", r"\n ?\n"), lambda p: F.contains(F.btrim(p, F.lit(" \n")), F.lit("\n"))), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    units = F.transform(F.concat(F.split("norm", "\n"), paragraphs), lambda u: F.split(F.btrim(u, F.lit(" ")), " +"))
    # A unit of at most so many distinct bigrams has at least one word more, and cannot be shorter than low.
    # Most units hold none of the words that a match needs; these have no bigrams made.
    needed = F.array(*map(F.lit, needed_words(known, threshold)))
    fitting = F.filter(units, lambda w: (F.size(w) > F.lit(low)) & F.arrays_overlap(w, needed))

    def dice(bigrams: Column, own: list[str]) -> Column:
        n = F.size(bigrams)
        within = (n >= len(own) * threshold / (2 - threshold)) & (n <= len(own) * (2 - threshold) / threshold)
        return F.when(within, 2.0 * F.size(F.array_intersect(bigrams, F.array(*map(F.lit, own)))) / (n + len(own)))

    def scored(bigrams: Column) -> Column:
        best = F.array(*(F.struct(dice(bigrams, own).alias("dice"), F.lit(name).alias("name")) for name, own in known))
        return F.when(F.size(bigrams) <= F.lit(high), F.filter(best, lambda s: s["dice"] >= threshold))

    def matches(words: Column) -> Column:
        pairs = F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
        return let(pairs, scored)

    found = docs.select("doc_id", text.alias("norm")).select("doc_id", F.filter(F.transform(fitting, matches), lambda m: F.size(m) > 0).alias("found"))
    every = F.flatten("found")
    best = F.array_max(F.transform(every, lambda s: s["dice"]))
    name = F.array_min(F.transform(F.filter(every, lambda s: s["dice"] == F.col("best_dice")), lambda s: s["name"]))
    listed = F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda s: s["name"]))), ",")
    return found.withColumn("best_dice", best).select("doc_id", F.size("found").cast("long").alias("n_matches"), listed.alias("licenses"), name.alias("best_license"), "best_dice")
