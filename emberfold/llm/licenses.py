"""Licences by the canonical digests of their texts.

A text is made canonical (letters lower-cased, copyright lines dropped, equivalent spellings made one, punctuation and
white space reduced to single blanks) and known by the digest of what is left. Known licences are a table of texts that
goes through the same steps, and both meet by a hash join. Each document is looked up as a whole, and so is each
paragraph and each line of it, as licences and notices are often put before or after other text. A known text of several
paragraphs is found between other text by the digests of its paragraphs in a row: documents meet it at any of them, and
the row is then compared.

The full texts of Apache-2.0, MPL, GPL, LGPL, AGPL and Creative Commons are not shipped, only their notices and names;
``digests_of`` makes what ``scan`` takes of a table of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm.columns import let
from emberfold.llm.common import LOWER, UPPER, among, settle, small

#: Pattern and replacement, applied in this order to lower-cased text; read alike by Java and RE2.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    (r"https?://", ""),
    (r"[^a-z0-9]+", " "),
    (r"\b(licence|licences|licenses)\b", "license"),
    (r"\blicenced\b", "licensed"),
    (r"\b(sub ?licence|sub ?license)\b", "sublicense"),
    (r"\b(non commercial|noncommercial)\b", "non commercial"),
    (r"\bcopyright owner\b", "copyright holder"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\b(version|v|ver) ?([0-9])", "version $2"),
    (r"\b([0-9]) 0\b", "$1"),
    (r"\b(gnu general public license|gnu gpl)\b", "gpl"),
    (r"\bcreative commons\b", "cc"),
    (r"\bsoftwares\b", "software"),
    (r"^ ?(this |the )?(work|software|file|project|program|code|document|text)? ?(is |are )?(licensed|released|distributed|available|published|provided) under (the )?(terms of (the )?)?", "under "),
    (r"^ | $", ""),
)

#: The licences' published texts, copyright lines left out.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.

You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."""
GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
#: MIT without its condition, ISC without its condition.
MIT_0 = MIT.split("\n\n")[0].replace(", subject to the following conditions:", ".") + "\n\n" + MIT.split("\n\n")[2]
BSD_0 = ISC.split("\n\n")[0].replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + "\n\n" + ISC.split("\n\n")[1]
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (MIT, "The MIT License\n\n" + MIT, "MIT License\n\n" + MIT),
    "MIT-0": (MIT_0, "MIT No Attribution\n\n" + MIT_0),
    "ISC": (ISC, "ISC License\n\n" + ISC),
    "0BSD": (BSD_0, "BSD Zero Clause License\n\n" + BSD_0),
    "Unlicense": (UNLICENSE, UNLICENSE.replace("https", "http")),
    "BSL-1.0": (BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST),
    "MPL-2.0": (MPL_HEADER,),
    **{k: (GNU_HEADER.format(name, version, name, name),) for k, (name, version) in GNU.items()},
    "BSD-2-Clause": ("\n\n".join((BSD_START, BSD_END)),),
    "BSD-3-Clause": ("\n\n".join((BSD_START, BSD_THIRD, BSD_END)),),
    "Zlib": (ZLIB,),
    "Apache-2.0": (APACHE_HEADER,),
}
#: The names by which notices call a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU General Public License, Version 2", "GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, Version 3", "GPL v3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, Version 3", "LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, Version 3", "AGPL v3", "AGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, Version 2.1", "LGPL v2.1", "LGPLv2.1"),
    "MIT-0": ("MIT No Attribution License", "MIT-0"),
    "0BSD": ("BSD Zero Clause License", "0BSD"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"),
    "Zlib": ("zlib License", "Zlib"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0",),
}
#: Creative Commons licences: short form of the terms and their names.
TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the published texts, and the notices that a rule makes of the names."""
    out = [(name, t) for name, texts in TEXTS.items() for t in texts]
    names = [(k, n) for k, ns in NAMES.items() for n in ns]
    for short, long in TERMS.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            names += [(f"CC-{short}-{v}", f"{start} {v}{end}") for start in (f"CC {short}", f"Creative Commons {long}") for end in ("", " International License")]
    keys = {k: [k] for k in sorted({k for k, _ in names} | set(TEXTS))}
    for k in keys:
        if "GPL-" in k:  # the current and the older spellings of one licence's identifiers
            keys[k] += [f"{k}-only", f"{k}-or-later", f"{k}+"]
    return out + [(k, f"Licensed under {n}") for k, n in names] + [(k, f"SPDX-License-Identifier: {x}") for k, xs in keys.items() for x in xs]


def _can_be_known(x: Column) -> Column:
    """Necessary for one of ``known_texts``, so that other parts need no canonical form.

    Texts and SPDX lines hold one of the first words, a notice also "under" and its licence's name. Only the step that
    takes URL schemes out can join letters into a word, so that parts with one always pass.
    """
    notice = x.rlike("(?i)(^|[^a-z0-9])under($|[^a-z0-9])") & x.rlike("(?i)mit|isc|bsd|apache|gpl|cc|creative|bsl|zlib")
    return x.rlike("(?i)licen[cs]|SPDX|warrant|permission|https?://") | notice


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for one without letters and digits."""
    out = F.translate(text, UPPER, LOWER)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license, paragraphs) of a table (license, text): digests of the whole canonical text and of its paragraphs in a row.

    Of two licences with one canonical form, the first by name.
    """
    whole = F.md5(canonical(F.col("text")).cast("binary"))
    return texts.select(whole.alias("digest"), "license", _paragraphs(F.col("text")).alias("paragraphs")).groupBy("digest").agg(F.min_by("license", F.struct("license", "paragraphs")).alias("license"), F.min_by("paragraphs", F.struct("license", "paragraphs")).alias("paragraphs"))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digests_of`` the shipped texts, or of a list of (license, text)."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in (texts or known_texts())])
    return digests_of(spark.range(1).select(F.inline(rows)))


BLANK_LINE = "\n[\\x20\\x09\\x0D]*\n"
NOTHING = "d41d8cd98f00b204e9800998ecf8427e"


def _paragraphs(text: Column) -> Column:
    """The digests of a text's paragraphs, in order, without those of which nothing is left."""
    return F.filter(F.transform(F.split(text, BLANK_LINE, -1), lambda x: F.md5(canonical(x).cast("binary"))), lambda d: d != NOTHING)


def _parts(text: Column, every: bool) -> Column:
    """The digests of a text's paragraphs and lines that can be a licence or a part of one, or of every one of them."""
    all_ = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, BLANK_LINE, -1)))
    return F.transform(all_ if every else F.filter(all_, _can_be_known), lambda x: F.md5(canonical(x).cast("binary")))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (of the whole text, or null), licenses (all that were found, sorted) for each row of ``docs``.

    A null or empty text has the digest of nothing and no licence. Rows that repeat each have their own result, null ids
    and other columns change nothing, an empty table gives an empty table. ``known`` (of ``digests_of``) is broadcast up
    to a size that is checked; with a table of one's own every line and paragraph is looked up.
    """
    spark = docs.sparkSession
    every = known is not None
    known = settle(known_digests(spark) if known is None else known)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    rows = docs.select("doc_id", key.alias("key"), F.md5(canonical(text).cast("binary")).alias("digest"), let(text, lambda t: F.when(F.lit(True) if every else _can_be_known(t), _parts(t, every))).alias("parts"))
    rows = settle(rows)
    # rows with equal parts have equal results
    asked = rows.where("size(parts) > 0").select("parts").distinct().select("parts", F.explode("parts").alias("part"))
    lone = known.select(F.col("digest").alias("part"), "license")
    found = asked.join(small(lone), "part").groupBy("parts").agg(F.sort_array(F.collect_set("license")).alias("found"))
    # texts that share a paragraph with a known text of several
    several = known.where(F.size("paragraphs") > 1).select("license", "paragraphs")
    meet = several.select("license", "paragraphs", F.explode(F.array_distinct("paragraphs")).alias("part"))
    near = settle(rows.where("size(parts) > 0").select("key", F.explode("parts").alias("part")).distinct().join(small(meet), "part").select("key", "license", "paragraphs").distinct())
    near_keys = near.select("key").distinct()
    full = among(docs.select(key.alias("key"), text.alias("text")), near_keys, "key").dropDuplicates(["key"]).select("key", _paragraphs(F.col("text")).alias("own"))
    n = F.size("paragraphs")
    within = F.exists(F.sequence(F.lit(1), F.size("own") - n + 1), lambda i: F.slice("own", i, n) == F.col("paragraphs"))
    rowed = near.join(full, "key").where(F.size("own") >= n).where(within).groupBy("key").agg(F.collect_set("license").alias("rowed"))
    whole = known.select("digest", F.col("license").alias("whole"))
    out = rows.join(small(whole), "digest", "left").join(small(settle(found), weigh=F.size("parts") * 48 + F.size("found") * 32 + 64), "parts", "left")
    out = out.join(small(settle(rowed), weigh=F.size("rowed") * 32 + 64), "key", "left")
    none = F.array().cast("array<string>")
    mine = F.when(F.col("whole").isNull(), none).otherwise(F.array("whole"))
    licenses = F.sort_array(F.array_union(F.array_union(mine, F.coalesce("found", none)), F.coalesce("rowed", none)))
    return out.select("doc_id", "digest", F.col("whole").alias("license"), licenses.alias("licenses"))


def oracle() -> str:
    """DuckDB SQL of the query's columns."""

    def form(x: str) -> str:
        out = f"translate({x}, '{UPPER}', '{LOWER}')"
        for pattern, to in STEPS:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')".replace("\\n", "\n") if "\\n" in pattern or to == "\n" else f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return out

    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in known_texts())
    digest = lambda x: f"md5({form(x)})"
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(t, '\n[\\x20\\x09\\x0D]*\n'), lambda x: {digest('x')}), lambda x: x <> '{NOTHING}')"
    return f"""WITH k AS MATERIALIZED (SELECT digest, license, paragraphs FROM (SELECT {digest('t')} AS digest, license, {paragraphs} AS paragraphs FROM (VALUES {values}) v(license, t)) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY license, paragraphs) = 1),
    d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    q AS MATERIALIZED (SELECT rid, {paragraphs} AS own FROM d),
    p AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
    f AS (SELECT rid, license FROM (SELECT rid, {digest('x')} AS digest FROM p UNION ALL SELECT rid, unnest(own) FROM q) JOIN k USING (digest)),
    r AS (SELECT rid, license FROM (SELECT rid, own, unnest(range(1, len(own) + 1)) AS i FROM q) JOIN k ON len(paragraphs) > 1 AND own[i] = paragraphs[1] WHERE own[i : i + len(paragraphs) - 1] = paragraphs),
    w AS (SELECT rid, doc_id, digest, license FROM (SELECT rid, doc_id, {digest('t')} AS digest FROM d) LEFT JOIN k USING (digest)),
    a AS (SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS ids FROM (SELECT rid, license FROM f UNION SELECT rid, license FROM r UNION SELECT rid, license FROM w WHERE license IS NOT NULL) GROUP BY rid)
    SELECT doc_id, digest, license, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(ids, '') AS licenses FROM w LEFT JOIN a USING (rid)"""
