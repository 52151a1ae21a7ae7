"""Licence scanning by canonical digest.

A text is normalised (A-Z lower-cased, copyright lines dropped, equivalent spellings made one, punctuation and white
space runs to one space) and its SHA-256 is looked up among the digests of known licence texts. The whole text must be a
licence; a licence quoted inside other text has another digest. All of it is DataFrame expressions; the known digests
are a small table given by the caller, joined by broadcast (``LIMIT`` rows at most, else by shuffle).

Null text counts as empty. An empty canonical form matches nothing. Where known texts share a canonical form, the
alphabetically first name is given. A very long text is normalised whole, by one task. Repeated rows get equal results,
empty tables give empty results; input columns that have the name of an output are replaced and all others returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .license_texts import TEXTS

LIMIT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Patterns of both engines' common regular-expression dialect, applied in order.
STEPS = [
    (r"(?m)^[^\n]*copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[)[^\n]*$", " "),
    (r"(?m)^[ \t]*(\(c\)|©)[ \t]*[0-9]{4}[^\n]*$", " "),
    (r"(?m)^[ \t]*all rights reserved[.]?[ \t]*$", " "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"acknowledgement", "acknowledgment"),
    (r"favour", "favor"),
    (r"authoris", "authoriz"),
    (r"organis", "organiz"),
    (r"merchantibility", "merchantability"),
    (r"per cent", "percent"),
    (r"&", " and "),
    (r"http://", "https://"),
    (r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f©·–—‘’“”…•]+", " "),
]


def canonical(text: Column) -> Column:
    x = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    for pattern, to in STEPS:
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    x = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, to in STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x}, ' ')"


def scan_licenses(docs: DataFrame, known: dict[str, str], *, text: str = "text") -> DataFrame:
    """``docs`` with digest, license (null if none) and is_license. ``known``: texts by licence name."""
    keyed, (own,) = C.with_helpers(docs, ("digest", "license", "is_license"), _own=F.sha2(canonical(F.col(f"`{text}`")), 256))
    (theirs,) = C.apart([*keyed.columns, "digest", "license", "is_license"], "_digest")
    table = docs.sparkSession.createDataFrame(list(known.items()), "license string, body string")
    table = table.withColumn("_c", canonical(F.col("body"))).where("_c <> ''").groupBy(F.sha2("_c", 256).alias(theirs)).agg(F.min("license").alias("license"))
    table = F.broadcast(table) if len(known) <= LIMIT else table
    joined = keyed.join(table, F.col(own) == F.col(theirs), "left")
    kept = keyed.drop(own).columns
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col(own).alias("digest"), "license", F.col("license").isNotNull().alias("is_license"))


#: Public licence texts and notices by name.
KNOWN = {
    **TEXTS,
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}
