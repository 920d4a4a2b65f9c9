"""Licence scan by canonical digests, with DataFrame functions only.

Texts are brought to a canonical form (lower case, copyright lines out, equivalent spellings made one, every run of
characters that are neither letters nor digits one blank) and joined by the MD5 of that form to the digests of known
licences. Units are the whole text and each of its lines, since a notice is a text of its own that stands on a line. Each
line is brought to its form once; the whole text's form is its lines' forms joined.

Known are the whole texts of MIT, ISC, 0BSD, BSD-2-Clause and BSD-3-Clause, the header of Apache-2.0, and the usual one-line
notices of these, GPL, MPL and Creative Commons. Whole texts of others (GPL, MPL, Apache, CC) aren't kept in this module:
``extra`` takes them as a table (license, text). A licence of several lines inside a longer document isn't a unit.

Defined cases: null and empty texts match nothing; a very long text is one row's work; equal texts match alike; rows of one
id, null included, share their union of matches; other columns, whatever their names, are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

# Public licence texts and the usual one-line notices, by SPDX identifier.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"ISC License\n\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AUTHOR}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_ISC}.\n\n{_AUTHOR}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
]
# Equivalent spellings, after lower-casing; the left one becomes the right one.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("https://", "http://"),
    ("non-infringement", "noninfringement"),
    ("sub-license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("v. 2.0", "version 2.0"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("wilful", "willful"),
]
#: Valid in Java's, RE2's and (with the letters spelled out) Python's syntax, after lower-casing.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright([ \t]+(\(c\)|©|[0-9]{4}))|\(c\)|©)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text):
    """The canonical form of a string column, as a column."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _OTHER, " "))


def canonical_text(text: str) -> str:
    """``canonical`` for one Python string."""
    out = re.sub(COPYRIGHT_LINE, " ", text.lower())
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return re.sub(r"[\W_]+", " ", out).strip()


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    import hashlib

    rows = sorted({(hashlib.md5(canonical_text(text).encode()).hexdigest(), name) for name, text in known})
    return spark.createDataFrame(rows, "digest string, license string")


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] = KNOWN, extra: DataFrame | None = None) -> DataFrame:
    """A row for each row of ``df``: doc_id, whole_text (the licence that the text as a whole is, or null), licenses
    (those of the text and its lines, sorted and joined by blanks; empty if none).

    Only matches are grouped. The digest table, broadcast, is a constant of this module or the caller's list; ``extra``
    (license, text), a table of any size, is joined as Spark chooses.
    """
    spark = df.sparkSession
    lines = df.select(col(id_col).alias("doc_id"), F.filter(F.transform(F.split(col(text_col), "\n"), canonical), lambda x: x != "").alias("lines"))
    digests = lines.select("doc_id", F.concat(F.array(F.md5(F.array_join("lines", " "))), F.transform("lines", lambda x: F.md5(x))).alias("digests"))
    # Outer, since a plain explode puts a filter on the array below it, which would work out every form again.
    units = digests.select("doc_id", F.posexplode_outer("digests").alias("at", "digest"))
    listed = F.broadcast(known_digests(spark, known))
    found = units.join(listed, "digest")
    if extra is not None:
        more = extra.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").distinct()
        found = found.unionByName(units.join(more, "digest"))
    per_doc = found.groupBy("doc_id").agg(F.min(F.when(F.col("at") == 0, F.col("license"))).alias("whole_text"), F.array_join(F.array_sort(F.collect_set("license")), " ").alias("licenses"))
    per_doc = per_doc.withColumnRenamed("doc_id", "of")
    ids = df.select(col(id_col).alias("doc_id"))
    return ids.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "whole_text", F.coalesce("licenses", F.lit("")).alias("licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op9_sql() -> str:
    form = f"regexp_replace(lower(unit), {_quote(COPYRIGHT_LINE)}, ' ', 'g')"
    for a, b in SPELLINGS:
        form = f"replace({form}, {_quote(a)}, {_quote(b)})"
    form = f"trim(regexp_replace({form}, {_quote(_OTHER)}, ' ', 'g'))"
    import hashlib

    known = ", ".join(f"({_quote(hashlib.md5(canonical_text(t).encode()).hexdigest())}, {_quote(n)})" for n, t in KNOWN)
    return f"""WITH known AS (SELECT DISTINCT * FROM (VALUES {known}) AS k(digest, license)),
units AS (SELECT doc_id, true AS whole, text AS unit FROM documents UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents),
forms AS (SELECT doc_id, whole, {form} AS form FROM units),
digests AS (SELECT doc_id, whole, md5(form) AS digest FROM forms WHERE form <> ''),
found AS (SELECT doc_id, min(CASE WHEN whole THEN license END) AS whole_text, string_agg(DISTINCT license, ' ' ORDER BY license) AS licenses FROM digests JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, whole_text, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id"""
