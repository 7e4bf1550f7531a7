"""Licence scan: lines and whole texts against licence templates, by Dice coefficient over word bigrams.

Only DataFrame functions. Letters A-Z are lower-cased; everything in ASCII but letters and digits
separates words. A unit (each line, and the whole text) is compared only with templates of a size
that can reach the threshold. A licence that no unit matches is also looked for in runs of consecutive
lines or sentences of a template's length, with the bodies and headers of BODIES too, where the whole
text has so many of a template's bigrams that some run can reach the threshold; so notices may be
wrapped, stand within a paragraph, or be whole texts. Defined cases: a null or empty text, or a unit of fewer than two words,
has no bigrams and matches nothing; repeated rows give repeated results; ties between templates go to
the first by name; very long texts are whole units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which works refer to public licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the 2-Clause BSD License.",
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software "
    "Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{1} for more details. You should have received a copy of the GNU {1} along with this {0}."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. {} "
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Bodies and standard headers, looked for in runs only.
BODIES = {
    "AGPL-3.0": _GNU.format("program", "Affero General Public License", "3"),
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "GPL-2.0": _GNU.format("program", "General Public License", "2"),
    "GPL-3.0": _GNU.format("program", "General Public License", "3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES '
    "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": _GNU.format("library", "Lesser General Public License", "3"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Where a line or sentence ends. X marks these places once the letters are lower-case, and separates no words there.
ENDS = r"\n|(?<=[.!?;:])\s+"
BETWEEN_OR_MARK = r"[\x00-\x2F\x3A-\x57\x59-\x60\x7B-\x7F]+"
#: A match needs a coefficient of at least this share.
NUMERATOR, DENOMINATOR = 8, 10


def words(text: Column) -> Column:
    pieces = F.split(F.translate(text, UPPER, LOWER), BETWEEN)
    return F.filter(pieces, lambda word: word != "")


def bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def template_bigrams(text: str) -> list[str]:
    clean = "".join(c if c in LOWER + "0123456789" or ord(c) > 127 else " " for c in text.translate(str.maketrans(UPPER, LOWER)))
    parts = clean.split()
    return sorted({f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)})


def _template_column(templates: list[tuple[str, str]]) -> Column:
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.array(*[F.lit(x) for x in grams]).alias("grams"),
            F.lit(len(grams)).alias("n"),
        )
        for name, text in sorted(templates)
        if (grams := template_bigrams(text))
    ]
    return F.array(*rows)


def _marked(text: Column) -> Column:
    """The words with an X at every end of a line or sentence."""
    return F.filter(F.split(F.regexp_replace(F.translate(text, UPPER, LOWER), ENDS, " X "), BETWEEN_OR_MARK), lambda word: word != "")


def _best_runs(near: Column, pairs: Column, places: Column) -> Column:
    """(minus, name) of each template in `near` that a run from one of `places` to a later one reaches, by its best run."""

    def best(t: Column) -> Column:
        # A run of n bigrams has n + 1 words at least; as places differ, no more places than words are within reach.
        most = F.floor(t["n"] * 3 / 2).cast("int")

        def from_place(a: Column, k: Column) -> Column:
            later = F.slice(places, k + 2, most + 1)
            reach = F.filter(later, lambda e: ((e - a - 1) <= most) & (3 * (e - a - 1) >= 2 * t["n"]))

            def dice(e: Column) -> Column:
                grams = F.array_distinct(F.slice(pairs, a + 1, e - a - 1))
                return F.struct(F.size(F.array_intersect(grams, t["grams"])).alias("common"), (F.size(grams) + t["n"]).alias("sizes"))

            good = F.filter(F.transform(reach, dice), lambda p: 2 * DENOMINATOR * p["common"] >= NUMERATOR * p["sizes"])
            return F.transform(good, lambda p: -2.0 * p["common"] / p["sizes"])

        return F.struct(F.array_min(F.flatten(F.transform(places, from_place))).alias("minus"), t["name"].alias("name"))

    return F.filter(F.transform(near, best), lambda b: b["minus"].isNotNull())


def scan(documents: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None, bodies: dict[str, str] | None = None) -> DataFrame:
    """(keep, n_units, n_candidates, n_matches, licenses, best_license, best_dice) for each row.

    n_units and n_candidates count lines and whole texts, and the comparisons of these that the size
    bounds leave. n_matches counts the comparisons that reach the threshold and, for licences without one,
    the templates that some run reaches. `bodies` are looked for in runs only; BODIES unless templates are given. `licenses` is the sorted list of matched names; the best match is null where none is.
    """
    if bodies is None:
        bodies = {} if templates else BODIES
    notices = list((templates or TEMPLATES).items())
    known, wanted = _template_column(notices), _template_column(notices + list(bodies.items()))
    all_grams = sorted({g for _, t in notices + list(bodies.items()) for g in template_bigrams(t)})
    fewest = min((len(g) for _, t in notices + list(bodies.items()) if (g := template_bigrams(t))), default=1)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    counted = documents.select(*keep, F.col(text).alias("__text"), F.transform(lines, words).alias("__lines"))
    counted = counted.select("*", bigrams(F.flatten("__lines")).alias("__whole"))
    # The whole text is a unit of its own where it has more than one line with words.
    whole = F.when(F.size(F.filter(F.col("__lines"), lambda w: F.size(w) > 0)) > 1, F.array("__whole")).otherwise(F.array().cast("array<array<string>>"))
    grams = counted.select(
        *keep,
        "__text",
        F.filter(F.concat(F.transform("__lines", bigrams), whole), lambda g: F.size(g) > 0).alias("__units"),
        F.array_intersect("__whole", F.array(*[F.lit(g) for g in all_grams])).alias("__shared"),
    )

    def compared(unit: Column) -> Column:
        n = F.size(unit)
        # 2 min(n, m) / (n + m) bounds the coefficient from above.
        near = F.filter(known, lambda t: 2 * DENOMINATOR * F.least(n, t["n"]) >= NUMERATOR * (n + t["n"]))
        return F.transform(
            near,
            lambda t: F.struct(
                F.size(F.array_intersect(unit, t["grams"])).alias("common"), (n + t["n"]).alias("sizes"), t["name"].alias("name")
            ),
        )

    pairs = grams.select(
        *keep, "__text", "__shared", F.size("__units").alias("n_units"), F.flatten(F.transform(F.col("__units"), compared)).alias("__pairs")
    )
    good = F.filter(F.col("__pairs"), lambda p: 2 * DENOMINATOR * p["common"] >= NUMERATOR * p["sizes"])
    found = pairs.select(
        *keep,
        "__text",
        "__shared",
        F.col("n_units").cast("bigint").alias("n_units"),
        F.size("__pairs").cast("bigint").alias("n_candidates"),
        F.transform(good, lambda p: F.struct((-2.0 * p["common"] / p["sizes"]).alias("minus"), p["name"].alias("name"))).alias("__in_units"),
    )
    # Any run has a part of the whole text's bigrams, and needs two thirds of the template's.
    near = F.filter(
        wanted,
        lambda t: (3 * F.size(F.array_intersect(t["grams"], F.col("__shared"))) >= 2 * t["n"])
        & ~F.exists(F.col("__in_units"), lambda g: g["name"] == t["name"]),
    )
    found = found.select("*", F.when(3 * F.size("__shared") >= 2 * fewest, near).alias("__near"))
    found = found.select("*", F.when(F.size("__near") > 0, _marked(F.col("__text"))).alias("__marked"))
    marks = F.filter(F.transform("__marked", lambda w, i: F.when(w == "X", i)), lambda i: i.isNotNull())
    plain = F.filter("__marked", lambda w: w != "X")
    found = found.select("*", marks.alias("__marks"), plain.alias("__plain"))
    places = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("__marks", lambda i, k: i - k), F.array(F.size("__plain"))))
    n = F.size("__plain")
    ordered = F.zip_with(F.slice("__plain", 1, F.greatest(n - 1, F.lit(0))), F.slice("__plain", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    found = found.select("*", F.when(F.size("__near") > 0, places).alias("__places"), F.when(F.size("__near") > 0, ordered).alias("__ordered"))
    in_runs = F.when(F.size("__near") > 0, _best_runs(F.col("__near"), F.col("__ordered"), F.col("__places")))
    nothing = F.array().cast("array<struct<minus:double,name:string>>")
    found = found.select(*keep, "n_units", "n_candidates", F.concat("__in_units", F.coalesce(in_runs, nothing)).alias("__good"))
    best = F.get(F.array_sort(F.col("__good")), 0)
    return found.select(
        *keep,
        "n_units",
        "n_candidates",
        F.size("__good").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.col("__good"), lambda g: g["name"]))), ",").alias("licenses"),
        best["name"].alias("best_license"),
        (-best["minus"]).alias("best_dice"),
    )
