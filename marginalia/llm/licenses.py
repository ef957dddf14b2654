"""Licence scan by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .license_texts import TEXTS

#: Published licence texts and notices by SPDX identifier.
LICENSES = {
    "MIT": [
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "0BSD": [
        """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-2-Clause": [
        """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0-or-later": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
}
_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS"""
LICENSES["BSD-3-Clause"] = [LICENSES["BSD-2-Clause"][0].replace("THIS SOFTWARE IS", _CLAUSE, 1)]
_END = "END OF TERMS AND CONDITIONS"
for _name, _text in TEXTS.items():
    LICENSES.setdefault(_name, []).append(_text)
    if _END in _text:  # many copies leave out what follows the terms: how to apply them
        LICENSES[_name].append(_text[: _text.index(_END) + len(_END)])
#: Spellings that count as equal, each with the one that stands for both.
SPELLINGS = [
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authoris", "authoriz"),
    ("colour", "color"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("organis", "organiz"),
    ("percent", "per cent"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\‘’“”–—·•"
COPYRIGHT_LINE = "(^|\n)[ \t]*(copyright[ \t]*(\\(c\\)|©|[0-9]|[\\[<{])|\\(c\\)[ \t]*[0-9\\[<{]|©|all rights reserved)[^\n]*"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, no punctuation, one spelling, single blanks; null is empty."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    plain = F.translate(F.regexp_replace(low, COPYRIGHT_LINE, "$1"), PUNCTUATION, " " * len(PUNCTUATION))
    for other, one in SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(plain, BLANKS, " "))


def digests(spark, licenses: dict[str, list[str]] | None = None) -> DataFrame:
    """(license_id, license_sha256) of the known texts: as many rows as `licenses` has texts. The least identifier stands for equal ones."""
    rows = [(name, text) for name, texts in (licenses or LICENSES).items() for text in texts]
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.groupBy(F.sha2(canonical(F.col("text")), 256).alias("license_sha256")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which documents are, as a whole, a known licence text.

    Returns doc_id, n_chars of the canonical text, canonical_sha256, license_id (null if unknown), is_license. `known`
    comes from digests(); it has a row for each text of the list that was given and so is bounded by it, and is
    broadcast: one pass over the documents, without a shuffle, whatever texts repeat. Null and empty texts, and those of
    copyright lines only, have an empty canonical text, which is no licence. Repeated rows each get their row; an
    empty table gives none. Other columns are ignored, whatever their names.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), canonical(text_or_empty(text_col)).alias("canonical"))
    found = text.select("doc_id", F.length("canonical").cast("long").alias("n_chars"), F.sha2("canonical", 256).alias("canonical_sha256"))
    joined = found.join(F.broadcast(known), (F.col("canonical_sha256") == F.col("license_sha256")) & (F.col("n_chars") > 0), "left")
    return joined.select("doc_id", "n_chars", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op10_license_digests(spark, sf_dir) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), digests(spark))


def _sql(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    low = f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"
    plain = f"translate(regexp_replace({low}, {quote(COPYRIGHT_LINE)}, '\\1', 'g'), {quote(PUNCTUATION)}, {quote(' ' * len(PUNCTUATION))})"
    for other, one in SPELLINGS:
        plain = f"replace({plain}, '{other}', '{one}')"
    return f"trim(regexp_replace({plain}, '{BLANKS}', ' ', 'g'), ' ')"


def oracle() -> str:
    texts = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in LICENSES.items() for text in texts)
    return f"""
WITH known AS (SELECT sha256({_sql('column1')}) AS digest, min(column0) AS license_id FROM (VALUES {texts}) v(column0, column1) GROUP BY 1),
d AS (SELECT doc_id, {_sql('text')} AS canonical FROM documents)
SELECT doc_id, length(canonical)::BIGINT AS n_chars, sha256(canonical) AS canonical_sha256, license_id, license_id IS NOT NULL AS is_license
FROM d LEFT JOIN known ON sha256(canonical) = digest AND length(canonical) > 0
"""
