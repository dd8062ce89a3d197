"""Licence scan by canonical digests. DataFrame functions only.

A text is made canonical: lower case, copyright lines dropped, equivalent
spellings unified, everything but letters and digits one space. Its SHA-256
is looked up among the digests of known licences by a hash join. Whole texts
are looked up, and single lines, which catches one-line notices and
identifiers. Of a licence that spans lines inside a longer text nothing is
found but such lines.

Null and empty texts, and texts that are empty once canonical, match nothing.
Rows are kept as they come, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence texts as published, without their copyright lines.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _GRANT + ". " + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("BSD-2-Clause", _BSD + _BSD_TWO + " " + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
)
#: SHA-256 of the canonical form of longer licence texts as published, terms and appendix.
DIGESTS = (
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
#: One-line identifiers of every licence named here, as headers of source files have them.
IDENTIFIERS = tuple((name, f"SPDX-License-Identifier: {name}{tail}") for name in dict.fromkeys(n for n, _ in (*KNOWN, *DIGESTS) if not n.startswith("LicenseRef")) for tail in (("", "-only", "-or-later") if "GPL" in name else ("",)))
#: Spellings that count as the same.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("https", "http"))
#: A line that names a holder: the word with a sign or a year, or a sign alone.
COPYRIGHT = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    """Null where nothing is left."""
    made = canonical(text)
    return F.when(made != "", F.sha2(made.cast("binary"), 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(digest, license): as many rows as there are texts, digests and identifiers above."""
    texts = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("body")) for k, t in (*KNOWN, *IDENTIFIERS)])
    rows = spark.range(1).select(F.explode(texts).alias("x")).select(digest(F.col("x.body")).alias("digest"), F.col("x.license").alias("license"))
    made = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license")) for k, d in DIGESTS])
    rows = rows.unionByName(spark.range(1).select(F.explode(made).alias("x")).select("x.digest", "x.license"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, license (of the whole text), line_licenses (sorted, distinct), n_lines."""
    known = F.broadcast(known_licenses(docs.sparkSession))  # a fixed number of rows
    text = F.col(text_col).cast("string")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), digest(text).alias("digest"), text.alias("text"))
    whole = base.join(known, "digest", "left").withColumnRenamed("license", "whole")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    split = whole.select("row", "doc_id", "digest", "whole", F.explode_outer(lines).alias("line")).select("row", "doc_id", F.col("digest").alias("whole_digest"), "whole", digest(F.col("line")).alias("digest"))
    found = split.join(known, "digest", "left")
    return (
        found.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("whole_digest").alias("digest"), F.first("whole").alias("license"), F.array_sort(F.collect_set("license")).alias("line_licenses"), F.count("license").alias("n_lines"))
        .drop("row")
    )
