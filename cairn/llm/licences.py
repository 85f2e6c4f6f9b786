"""License scan: canonical texts' digests, joined with the digests of known licences. Native: DataFrame functions only.

A text is put into a canonical form (lower case, copyright lines dropped, equivalent spellings made one, everything but letters and
digits turned into single spaces), and the SHA-256 of the whole of it is looked up. The units looked up are the entire text of a
document and each of its lines as an entire text, so that a notice that stands on a line of its own is found as well.

A unit can only match if its canonical form holds one of the words that every known text holds (ANCHORS, checked by the tests), so
others aren't hashed. The digests of known texts are a fixed list of this module, and so may be broadcast: short texts stand here in
full, of long ones (the GNU, Apache, Mozilla, Creative Commons and Artistic licences) only the digest of the canonical form. Texts are read
once; what is looked up of them is staged.

Defined results: a null or empty text has no licence; rows that repeat an id each report their own text's licence and, in lines, those of
all rows of that id; null ids report lines as none; further columns of the input are not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import staged

#: Fixed values: (pattern, replacement) of the canonical form, applied in this order to lower-cased text. Java and RE2 read them alike.
STEPS = [
    (r"(^|\n)[ \t*#/;>-]*(copyright|\(c\)|©)[^\n]*", "\n"),
    (r"(^|\n)[ \t*#/;>-]*all rights reserved\.?[ \t]*", "\n"),
    (r"https://", "http://"),
    (r"sub-license", "sublicense"),
    (r"licence", "license"),
    (r"non-infringement", "noninfringement"),
    (r"per cent", "percent"),
    (r"favour", "favor"),
    (r"organisation", "organization"),
    (r"authoris", "authoriz"),
    (r"judgement", "judgment"),
    (r"acknowledgement", "acknowledgment"),
    (r"fulfil([^l])", r"fulfill\1"),
    (r"merchantibility", "merchantability"),
    (r"[^a-z0-9]+", " "),
]
#: Words of which each known canonical text holds one.
ANCHORS = ["license", "permission", "redistribution", "public domain"]

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""

#: Fixed values: (licence, text). Licence texts with and without their title, and the usual one-line notices.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_WARRANTY}"),
    ("0BSD", f"{_ISC}.\n{_WARRANTY}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    *[(f"{n}-4.0", f"{verb}{s} 4.0.") for n in ("CC-BY", "CC-BY-SA", "CC-BY-ND", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND") for verb in ("Licensed under ", "This work is licensed under ") for s in ("CC " + n[3:],)],
    *[(n, f"SPDX-License-Identifier: {n}") for n in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "Unlicense")],
]

#: Fixed values: (licence, SHA-256 of the canonical form) of whole licence texts as their publishers distribute them.
DIGESTS = [
    ("Apache-2.0", "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e"),
    ("Artistic-1.0-Perl", "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f"),
    ("GFDL-1.3", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, with_ in STEPS:
        out = F.regexp_replace(out, pattern, with_.replace("\\1", "$1"))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"lower({text})"
    for pattern, with_ in STEPS:
        literal = with_.replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{literal}', 'g')"
    return f"trim({out})"


def known_digests(spark: SparkSession) -> DataFrame:
    """digest and license of every known text."""
    known = spark.createDataFrame(KNOWN, "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    known = known.union(spark.createDataFrame(DIGESTS, "license string, digest string").select("digest", "license"))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def may_match(text: Column) -> Column:
    """Whether the canonical form of text can hold an anchor."""
    return F.coalesce(text.rlike("(?i)licen[cs]e|permission|redistribution|public[^a-z0-9]+domain"), F.lit(False))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (of the entire text, or null), line_licenses (of entire lines: sorted, distinct, comma-joined, or empty) and n_license_lines."""
    known = F.broadcast(known_digests(docs.sparkSession))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = lambda x: F.sha2(canonical(x), 256)
    may = may_match(F.col("text"))
    lines = F.when(may, F.transform(F.filter(F.split("text", "\n"), may_match), digest))
    units = staged(base.select("doc_id", F.when(may, digest(F.col("text"))).alias("whole"), lines.alias("lines")), "digests")
    whole = units.select("doc_id", "whole").join(known.select(F.col("digest").alias("whole"), "license"), "whole", "left").select("doc_id", "license")
    hits = units.where("lines IS NOT NULL").select("doc_id", F.explode("lines").alias("digest")).join(known.select("digest", F.col("license").alias("line_license")), "digest")
    found = hits.groupBy(F.col("doc_id").alias("found_id")).agg(F.array_join(F.array_sort(F.collect_set("line_license")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    out = whole.join(found, F.col("doc_id") == F.col("found_id"), "left")
    return out.select("doc_id", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def oracle_sql() -> str:
    """license_scan over `documents`, for DuckDB."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    may = "coalesce(regexp_matches({}, '(?i)licen[cs]e|permission|redistribution|public[^a-z0-9]+domain'), false)"
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({canonical_sql('t')}) AS digest, l AS license FROM (VALUES {values}) v(l, t)
  UNION ALL SELECT d, l FROM (VALUES {digests}) v(l, d)) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE {may.format('text')}),
found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM
  (SELECT doc_id, sha256({canonical_sql('line')}) AS digest FROM lines WHERE {may.format('line')}) h JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, k.license, coalesce(f.line_licenses, '') AS line_licenses, coalesce(f.n, 0) AS n_license_lines
FROM (SELECT doc_id, CASE WHEN {may.format('text')} THEN sha256({canonical_sql('text')}) END AS digest FROM documents) d
LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id = d.doc_id"""
