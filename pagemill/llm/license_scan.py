"""Licence scan by canonical digest: texts that are, as a whole, a known licence text, notice or identifier.

Case, punctuation, white space, copyright lines and equivalent spellings are
normalised away, and the SHA-256 of what is left is hash-joined to the digests
of known texts.  A whole document is looked up, and so is each of its lines, for
licence lines stand alone within longer documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._common import numbered

# Known licence texts and notices, as (licence id, kind, text).
KNOWN = [
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", "text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", "text", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""),
    ("BSL-1.0", "text", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL-3.0", "notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0", "notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", "notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Headings that a whole text may carry, and the names by which a line refers to a licence.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
}
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "MIT": ("the MIT License", "MIT"),
    "ISC": ("the ISC License",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the MPL 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2",),
    "GPL-3.0": ("the GNU General Public License, version 3",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "Unlicense": ("the Unlicense",),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
}
FORMS = ("Licensed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "Released under {}.", "Distributed under {}.", "License: {}")

# Digests of the canonical forms of whole licences too long to be kept here as text.
LONG_TEXTS = [
    ("Apache-2.0", "text", "37c54c9e3a268aecfee87cd125bfe90fa8cc5bf28b7eda7c3fb645ea70e92e15"),
    ("Artistic-1.0-Perl", "text", "93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0"),
    ("CC0-1.0", "text", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("GFDL-1.2", "text", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", "text", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0", "text", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "text", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "text", "1368b610356d98a8c46b121d129e8c15e265ad1924b43009b00f05509cdd93d8"),
    ("LGPL-2.0", "text", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1", "text", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0", "text", "af4f466bab5554afad60c219ff8bf29eddb00df6ef0f1fcf73fa05ad4b3289f5"),
    ("MPL-1.1", "text", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "text", "97a9447d30c5bcd9d582eb44e62b0a9b4b83e9e4225fc5a26b313c8b023e7137"),
]

# A line of any known text holds one of these; a test says so.
HINT = r"(?i)licen[sc]|released under|distributed under|permission|redistribution|free and unencumbered|source code form|apache|provided .as.is."


def known_texts() -> list[tuple[str, str, str]]:
    """(licence id, kind, text) of all short texts: as they are, under each heading, and each form of line and identifier by rule."""
    out = [*KNOWN]
    out += [(i, k, f"{h}\n{t}") for i, k, t in KNOWN if k == "text" for h in HEADINGS.get(i, ())]
    out += [(i, "line", form.format(name)) for i, names in NAMES.items() for name in names for form in FORMS]
    out += [(i, "identifier", f"SPDX-License-Identifier: {x}") for i in sorted({i for i, _, _ in KNOWN} | set(NAMES)) for x in ((i, f"{i}-only", f"{i}-or-later") if "GPL" in i else (i,))]
    return out


# Spellings that mean the same, applied in this order to folded text between single spaces.
SPELLINGS = [
    (" licence ", " license "),
    (" licences ", " licenses "),
    (" licenced ", " licensed "),
    (" sublicence ", " sublicense "),
    (" v ", " version "),
    (" gnu gpl ", " gnu general public license "),
    (" favour ", " favor "),
    (" organisation ", " organization "),
    (" non infringement ", " noninfringement "),
    (" merchantibility ", " merchantability "),
    (" creative commons attribution noncommercial ", " cc by nc "),
    (" version 2 0 ", " version 2 "),
    (" http ", " https "),
]

COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Null as empty; ASCII case folded; copyright lines dropped; everything but a-z and 0-9 a single space; equivalent spellings made one."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(t)


def digest_of(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(digest, license_id, kind) of the known texts; a digest that two licences share keeps the first by name."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license_id string, kind string, text string").select(digest_of(F.col("text")).alias("digest"), "license_id", "kind")
    if known is None:
        rows = rows.union(spark.createDataFrame(LONG_TEXTS, "license_id string, kind string, digest string").select("digest", "license_id", "kind"))
    return rows.groupBy("digest").agg(F.min(F.struct("license_id", "kind")).alias("k")).select("digest", "k.license_id", "k.kind")


def scan_licenses(docs: DataFrame, known: list[tuple[str, str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: row_id, doc_id, digest, license_id and kind (of the whole text, else null), line_licenses (sorted ids), n_license_lines.

    Null and empty texts, and texts of copyright lines or punctuation only, have
    the digest of the empty text and no licence.  Repeated rows stay.  The known
    texts are part of the program (a broadcast of fixed size).  Texts and lines
    of all lengths are looked up.  Only the two named columns are read.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known_digests(spark, known).where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).collect(), "digest string, license_id string, kind string")
    own = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "row_id")
    whole = own.withColumn("digest", digest_of(F.col("text"))).join(F.broadcast(table), "digest", "left")
    # The lines' lookup stays within the row: the same fixed table as a map literal, in parts by the digest's first digit.
    parts: dict[str, list] = {}
    for r in table.collect():
        parts.setdefault(r["digest"][0], []).extend((F.lit(r["digest"]), F.lit(r["license_id"])))

    def looked_up(digest: Column) -> Column:
        out = F.lit(None).cast("string")
        for digit, pairs in sorted(parts.items()):
            out = F.when(F.substring(digest, 1, 1) == digit, F.try_element_at(F.create_map(*pairs), digest)).otherwise(out)
        return out

    lines = F.split("text", "\n")
    if known is None:
        hint = lambda x: x.rlike(HINT)
        lines = F.when(hint(F.col("text")), F.filter(lines, hint)).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.transform(F.transform(lines, digest_of), looked_up), lambda x: x.isNotNull())
    out = whole.withColumn("found", found)
    return out.select("row_id", "doc_id", "digest", "license_id", "kind", F.array_sort(F.array_distinct("found")).alias("line_licenses"), F.size("found").cast("long").alias("n_license_lines"))


def license_report(docs: DataFrame) -> DataFrame:
    """scan_licenses() in the columns doc_id, digest, license_id, line_licenses (comma-joined), n_license_lines; its rules for nulls, empty and long texts, repeated rows, empty tables and other columns hold."""
    s = scan_licenses(docs)
    return s.select("doc_id", "digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"), "n_license_lines")
