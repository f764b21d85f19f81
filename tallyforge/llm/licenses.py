"""License scans by canonical digest: whole texts are normalised and looked up among known licence texts."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, after lower-casing, and the texts of well-known licences and notices.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("http://", "https://"),
    ("&", " and "),
    ("©", " (c) "),
    ("‘", " "),
    ("’", " "),
    ("“", " "),
    ("”", " "),
    ("–", " "),
    ("—", " "),
)
#: Where a notice ends on its line at the latest: the first words of a licence. What may stand before a notice on its line.
BODIES = (
    "permission is hereby granted", "permission to use, copy", "redistribution and use in", "this software is provided",
    "this is free and unencumbered", "licensed under", "this program is free", "this work is licensed", "released under",
)
TITLES = r"(?:the )?(?:mit|isc|zlib|bsd zero clause|bsd [23]-clause) licen[cs]e(?: \(mit\))?"
#: A real notice: copyright with a sign or a year (or where a template asks for one). A body's line that begins with copyright is none.
NOTICE = (
    rf"^([\t #*/;-]*(?:{TITLES})?)[\t #*/;-]*"
    r"(?:copyright[\t ]*(?:\(c\)|©|[\[<{]?(?:[0-9]{4}|yyyy|year))|(?:\(c\)|©)[\t ]*[0-9]{4})"
)
#: Steps after lower-casing: what a pattern matches becomes a text, with groups. Lines end before a line feed only.
STEPS = (
    (rf"{NOTICE}[^\n]*?({'|'.join(BODIES)})", r"\1 \2"),
    (rf"{NOTICE}[^\n]*$", r"\1 "),
    (r"^[\t #*/;-]*all rights reserved[\t .#*/;-]*", ""),
    # blanks, and what stands before the words of a comment's next line: spellings of two words are found across it
    (r"[\t ]*\n[\t\n #*/;-]*|[\t ]+", " "),
)
NOT_WORD = r"[^a-z0-9\x{80}-\x{10ffff}]+"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
ISC_CONDITION = """, provided that the above copyright notice and this permission notice appear in all copies"""
ISC_WARRANTY = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THREE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
KNOWN = {
    "MIT": (MIT, "MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT),
    "ISC": (ISC_GRANT + ISC_CONDITION + ISC_WARRANTY, "ISC License\n\n" + ISC_GRANT + ISC_CONDITION + ISC_WARRANTY),
    "0BSD": (ISC_GRANT + ISC_WARRANTY, "BSD Zero Clause License\n\n" + ISC_GRANT + ISC_WARRANTY),
    "BSD-2-Clause": (BSD_TWO + BSD_WARRANTY, "BSD 2-Clause License\n\n" + BSD_TWO + BSD_WARRANTY),
    "BSD-3-Clause": (BSD_TWO + BSD_THREE + BSD_WARRANTY, "BSD 3-Clause License\n\n" + BSD_TWO + BSD_THREE + BSD_WARRANTY),
    "Unlicense": (UNLICENSE,),
    "Zlib": (ZLIB, "zlib License\n\n" + ZLIB),
    "Apache-2.0": (APACHE_NOTICE,),
    "GPL-3.0-or-later": (GPL_NOTICE,),
}
# Digests of the canonical forms of long licences as their authors publish them; the second, where there are two, is
# of the text up to the end of its terms, without the appendix on how to apply it.
DIGESTS = {
    "Apache-2.0": (
        "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c",
        "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84",
    ),
    "GPL-1.0": (
        "ecede0ce378cc2fefec4431f4cf508af5338dc8a3e44b5c5a3a7867070db5798",
        "6c07dfb5e6ddc39fe93ae803d39b67367c21b50207b645111c04cd08cb283d70",
    ),
    "GPL-2.0": (
        "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f",
        "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632",
    ),
    "GPL-3.0": (
        "3a6f6de49cd56a0a453ad94bd5ca976bda893ddceb419833aab39af7bbb91c1c",
        "2f5326aa8a00f9aaec5990337239231da07ca0fa219229d7bd0c79afd3cfbe60",
    ),
    "LGPL-2.0": (
        "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e",
        "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389",
    ),
    "LGPL-2.1": (
        "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
        "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    ),
    "MPL-2.0": (
        "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "Artistic-1.0-Perl": (
        "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",
    ),
    "GFDL-1.2": (
        "f490b9a0ee194b2afc97a09d9e54d699936337efc6fbb57dc8675171ab1d18d3",
    ),
    "GFDL-1.3": (
        "b66b2d6c8267f57ea3f6cd5318832fecb9cd453d95411d4dbd65be7f9936fada",
    ),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PY_NOT_WORD = re.compile("[^a-z0-9\x80-\U0010ffff]+")


def canonical_text(text: str) -> str:
    """What a text is compared by, wherever its lines end: case, copyright notices, spellings and punctuation made equal."""
    text = text.translate(str.maketrans(UPPER, LOWER)).replace("\r", "\n")
    for pattern, to in STEPS:
        text = re.sub("(?m)" + pattern, to, text)
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return PY_NOT_WORD.sub(" ", text).strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known_digests() -> dict[str, str]:
    held = {digest(t): name for name, texts in KNOWN.items() for t in texts}
    return held | {d: name for name, digests in DIGESTS.items() for d in digests}


def canonical(text: Column) -> Column:
    """``canonical_text`` as Spark functions."""
    text = F.translate(text, UPPER + "\r", LOWER + "\n")
    for pattern, to in STEPS:
        text = F.regexp_replace(text, "(?md)" + pattern, to.replace("\\", "$"))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, digest, license): the digest of every whole text and the licence whose text it is, else null.

    One row per input row. A null text counts as empty, with the digest of nothing and no licence. Texts of any length are
    read whole; an empty table gives an empty one. Null ids, repeated rows and other columns of any name are harmless. The known
    digests are a fixed list of a few dozen, and so are broadcast.
    """
    known = docs.sparkSession.createDataFrame(sorted(known_digests().items()), "digest string, license string")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.sha2(canonical(body), 256).alias("digest"))
    return rows.join(F.broadcast(known), "digest", "left").select(id_col, "digest", "license")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    text = f"translate(coalesce(text, ''), {_quoted(UPPER)} || chr(13), {_quoted(LOWER)} || chr(10))"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {_quoted('(?m)' + pattern)}, {_quoted(to)}, 'g')"
    for a, b in SPELLINGS:
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    text = f"trim(regexp_replace({text}, {_quoted(NOT_WORD)}, ' ', 'g'), ' ')"
    known = ", ".join(f"({_quoted(d)}, {_quoted(n)})" for d, n in sorted(known_digests().items()))
    return (
        f"WITH known(digest, license) AS (VALUES {known}), rows AS (SELECT doc_id, sha256({text}) AS digest FROM documents) "
        "SELECT doc_id, digest, license FROM rows LEFT JOIN known USING (digest)"
    )
