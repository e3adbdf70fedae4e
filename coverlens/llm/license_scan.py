"""Known licences by the digest of their canonical text.

A text is made canonical: lower case, lines with a copyright mark dropped,
marks and blanks one space, equivalent spellings one spelling.  Its SHA-256 is
looked up by a hash join in the table of known digests, which is as long as the
list of notices below and therefore always small enough to broadcast.  Texts
are known with and without their title and the line 'All rights reserved'.  Two
units are looked up: each whole text, and each of its lines, so that a document
that is a licence and one that ends in a notice are both found.

Defined cases: null and empty texts give no finding; equal rows give equal
findings, one for each row; lines that repeat give one finding each; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm.common import pick

#: Names under which licences are cited, by SPDX id.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
#: Sentences that cite a licence by name.
NOTICES = (
    "{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is released under the {}",
)
#: Whole texts of short licences.
TEXTS: dict[str, str] = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}
#: Spellings that count as one, replaced in this order in canonical text (words apart by one space, one space at either end).
SPELLINGS = (
    ("licence", "license"), (" licenced ", " licensed "), (" sub license ", " sublicense "), ("organisation", "organization"), ("merchantibility", "merchantability"),
    (" non infringement ", " noninfringement "), (" non commercial ", " noncommercial "), (" share alike ", " sharealike "), (" no derivatives ", " noderivatives "),
    (" creative commons attribution ", " cc by "), (" by noncommercial ", " by nc "), (" by sharealike ", " by sa "), (" by noderivatives ", " by nd "),
    (" international license ", " "), (" v1 ", " version 1 "), (" v2 ", " version 2 "), (" v3 ", " version 3 "), (" v4 ", " version 4 "),
    (" gplv2 ", " gpl version 2 "), (" gplv3 ", " gpl version 3 "), (" gnu general public license ", " gnu gpl "), (" gnu lesser general public license ", " gnu lgpl "),
    (" gnu affero general public license ", " gnu agpl "),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: ",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)


def _bsd(clauses: int) -> tuple[str, ...]:
    """With numbers or other marks before the clauses, and either word for the holder."""
    mark = lambda numbered, i: f"{i}. " if numbered else "* "
    return tuple(
        _BSD[0] + "".join(mark(numbered, i) + _BSD[i] for i in range(1, clauses + 1)) + _BSD[4].format(holder)
        for numbered in (True, False) for holder in ("HOLDER", "OWNER", "HOLDERS")
    )


#: Further whole texts.
MORE_TEXTS: dict[str, tuple[str, ...]] = {
    "BSD-2-Clause": _bsd(2),
    "BSD-3-Clause": _bsd(3),
    "MIT-0": (
        TEXTS["MIT"].replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."),
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") '
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
        "in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, '
        "TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
}
#: Titles that stand above the texts.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
}
#: A line with a notice: a mark, or the word with a year or holder after it; no line of a text that only begins with the word.
NOTICE_LINE = (
    r"(?m)^[ \t]*(\(c\)|©|&copy;|copyrights?(?![a-z])[ \t:,]*+(?=[^\s])"
    r"(?!(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|and|or|in|of|to|on|is|are|shall|may|must)(?![a-z])|[.;)\"']))[^\n]*$"
)


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, marks and blanks one space, spellings unified, one space at either end."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE_LINE, " "), r"[^a-z0-9]+", " "), F.lit(" "))
    out = F.regexp_replace(out, r" +", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def notices() -> list[tuple[str, str]]:
    """(SPDX id, text) of every known notice."""
    cited = [(spdx, n.format(name)) for spdx, names in NAMES.items() for name in names for n in NOTICES]
    tags = [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in NAMES]
    return cited + tags + list(TEXTS.items())


def whole_texts() -> list[tuple[str, str]]:
    """(SPDX id, text) of every whole text, as it stands and below its titles."""
    texts = {spdx: (text,) for spdx, text in TEXTS.items()} | MORE_TEXTS
    heads = lambda spdx: [(t, a) for t in ("", *TITLES[spdx]) for a in ("", "All rights reserved.")]
    return [(spdx, f"{title}\n{rights}\n{text}") for spdx, own in texts.items() for text in own for title, rights in heads(spdx)]


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest`` and ``spdx``; of notices with one canonical text the first id stays."""
    rows = [(i, spdx, text) for i, (spdx, text) in enumerate(texts or notices() + whole_texts())]
    table = spark.createDataFrame(rows, "i int, spdx string, text string").select("i", "spdx", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return table.groupBy("digest").agg(F.min_by("spdx", "i").alias("spdx"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, unit ('text' or 'line'), line (0 for texts, else from 1), spdx, digest of every finding."""
    d = pick(docs, "doc_id", "text").where("text IS NOT NULL AND text <> ''")
    unit = lambda kind, n, t: F.struct(F.lit(kind).alias("unit"), n.cast("long").alias("line"), t.alias("t"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: unit("line", i + 1, x))
    units = d.select("doc_id", F.explode(F.concat(F.array(unit("text", F.lit(0), F.col("text"))), lines)).alias("u")).select("doc_id", "u.*")
    units = units.select("doc_id", "unit", "line", F.sha2(canonical(F.col("t")), 256).alias("digest"))
    return units.join(F.broadcast(known(docs.sparkSession, texts)), "digest").select("doc_id", "unit", "line", "spdx", "digest")
