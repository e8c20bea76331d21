"""License scan by canonical digests.

A text is brought to a canonical form (case, spellings, copyright lines, punctuation and white space unified), digested
whole, and joined by hash to the digests of known licence texts. Lines are looked up in the same way against known
one-line notices.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that mean the same, as pattern and canonical form, in this order.
SPELLINGS = {
    r"https?://|[\u2013\u2014\u2018\u2019\u201c\u201d\u00a0\ufeff]": " ",
    r"licence": "license",
    r"licenced": "licensed",
    r"copyright holder": "copyright owner",
    r"sub-license|sub license": "sublicense",
    r"non-commercial|non commercial": "noncommercial",
    r"merchantibility": "merchantability",
    r"wilful": "willful",
    r"organisation": "organization",
    r"acknowledgement": "acknowledgment",
    r"favour": "favor",
    r"judgement": "judgment",
    r"&": " and ",
    r"\(c\)|©": " copyright ",
    r"version |ver\. ?|v\. ?(?=[0-9])": "v",
    r"gnu general public license": "gnu gpl",
}
#: What differs from holder to holder, as pattern in the folded form and its one form, in this order.
FILLS = {
    r" [0-9a-c] (?=redistributions (?:of|in) |neither the name)": " ",
    r"neither the names? of .{1,200}? n?or the names of (?:its|their|the|any) ?contributors": "neither the name of the copyright owner nor the names of its contributors",
    r"this software is provided by .{1,200}? as is": "this software is provided by the copyright owner as is",
    r"software is provided as is and .{1,200}? disclaims?": "software is provided as is and the author disclaims",
    r"in no event shall .{1,200}? be liable": "in no event shall the author be liable",
}
#: Whole licence texts by SPDX name, without their title and copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and
changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
}
#: Title and version lines that may stand before a text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
#: Digests of long texts, with and without their title lines and the appendix after their terms, and of the
#: short form of WTFPL.
DIGESTS = {
    "Apache-2.0": (
        "87677d887984af2a9933ae46a048a683308f26af0b5fb6c0f79d7c55b4e8f31d",
        "b71a36e457b31f2788bdfa99ae0af709db0fb1c74a44cd67047065915332d888",
        "ea2a2722183372f33bd3464b80a701c3b2afbda8f22b13844471003eae2b7e05",
        "7b42c3a1e8863f8777d789a86ed0cd9c54a060a11a045530a5e7783f2f81de02",
        "6e41791578d69f1a99828499e714338682a8c4cad374424bc816f7e37d0783f5",
    ),
    "CC0-1.0": (
        "e0b4a4b2f47fe2c4693426b369084863b9e46bea3bc82e30c8e672c77e970fd3",
        "02da8894e285a80d22670f473cc8dc422df43dd344864a76a6d33f33591b1529",
        "0b13d7ae070d2f516605c096d05a0ddb213faaf202a4fe93e3aa4107c51af990",
    ),
    "GFDL-1.3": (
        "3de4c910277ed5d9ddb16a75c483a5a894fd0e24751b9991cea8c17104956c87",
        "d040194d8cb9c0f0ca823c48694f31c90016b9cc677c7539bd67aee1d17710c6",
    ),
    "GPL-2.0": (
        "16540efe233911b3a80c66e962bba446a972a26e726af6bdf29f5881a79204ec",
        "6d288c246bf869abb88f66a83a1d9a6d8f2e29b0df11e789252ed2537b4fcc78",
        "7ac81bfccaae9fa3a719e4b12916796610fc7cbdd28b3b01154b790e4472efce",
        "fe96eec6fa461e1a045de7c5372abb14ec788ef8a7961d04a8c1ba8576b39cdb",
    ),
    "GPL-3.0": (
        "3e369bfc5635ae00ac4408c011d113198e3cdb04eb9f72aa71eddfaf4faa4172",
        "1322453c970cbdaa80d72abc2d5698d78eb7bdc21d6d2431f2b100f8e6705f1a",
        "2c2e78baeb73055b4f1c3a8bff9f1dc116c95635e96d786f9896e42cfcea3372",
        "d650a0c89c87964f2b313b37d9aee54a2d141667a68159db14102aa74ff6ba4e",
    ),
    "LGPL-2.1": (
        "55a37cab594ee20fd796b91daccdbfe6ea9ae91ede86ef2c87fb92df05c31870",
        "e14f43940fd8f498d9e256be62adea238a4ec83590fa80aa53a418b2d478d351",
        "039e8d108db3f182a3a9a6cd5f3ffc347643f96578e5a71a72423365f5ed6c0f",
        "e41b71f726d21c9e18260e580ddc410ab9db00184f4af2ed46058999edf84fe1",
    ),
    "LGPL-3.0": (
        "8dcb115be483b896d0638deff7ce79bc76531c5ce7dce489d8c3b5b0549a2f58",
        "c8687ec339cf01a58d6625ef335c3884392d56c2a46e499e336e7430a7ab1c49",
    ),
    "MPL-2.0": (
        "cf6ec78da87d1dc6817b6cbcc32e2ba734aa75dd59b20d208635535cd91ee831",
        "203056b3ee8d6f5b2748c5536d4ca97bd98ad6485c7f251beedbca4585c3fad4",
    ),
    "WTFPL": (
        "5757ac9cdd42713ed24f9dc174585ad1f3d214a70f8b5a6bc83ea39768bbe195",
    ),
}
#: One-line notices by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
}
_YEAR = r"(?:[0-9]{4}|[<\[{(]+(?:yyyy|year|dates?)\b)"
#: Lines that only say who holds the rights, in lower case. Prose that a wrapped line begins with is none.
_COPYRIGHT = (
    rf"(?m)^[\x20\t#*/;-]*(?:copyright:?[\x20\t]*(?:\(c\)|©|{_YEAR}|by\b)|(?:\(c\)|©)[\x20\t]*(?:copyright\b|{_YEAR})"
    r"|spdx-filecopyrighttext)[^\n]*$|(?m)^[\x20\t#*/;-]*all rights reserved[\x20\t\r.*/#-]*$"
)
#: White space, with what begins a line of a comment.
_BREAK = r"[\x00-\x20]*\n[\x00-\x20#*/;-]*|[\x00-\x20]+"


def lower(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, and runs of ASCII letters, digits and other scripts' characters.

    Case is folded for A-Z only, so that every engine folds alike. Lines are joined before spellings are unified, so the
    form does not depend on where a text is wrapped. Null is empty.
    """
    out = lower(text)
    out = F.regexp_replace(out, _COPYRIGHT, "")
    out = F.regexp_replace(out, _BREAK, " ")
    for pattern, form in SPELLINGS.items():
        out = F.regexp_replace(out, pattern, form)
    out = F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    for pattern, form in FILLS.items():
        out = F.regexp_replace(out, pattern, form)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(
    spark,
    texts: dict[str, str],
    notices: dict[str, str],
    titles: dict[str, tuple[str, ...]] = TITLES,
    digests: dict[str, tuple[str, ...]] = DIGESTS,
) -> DataFrame:
    """``(digest, whole, license, form)`` of the given texts, with and without each title, notices and digests.

    Of equal forms the first name counts. Digests have no ``form``.
    """
    rows = [(True, k, f"{title}\n{v}", None) for k, v in texts.items() for title in ("", *titles.get(k, ()))]
    rows += [(False, k, v, None) for k, v in notices.items()]
    rows += [(True, k, None, x) for k, v in digests.items() for x in v]
    named = spark.createDataFrame(rows, "whole boolean, license string, text string, given string")
    form = F.when(F.col("given").isNull(), canonical(F.col("text")))
    return named.groupBy(F.coalesce("given", digest(F.col("text"))).alias("digest"), "whole").agg(
        F.min("license").alias("license"), F.min(form).alias("form")
    )


def _may_be(line: Column, forms: list[str]) -> Column:
    """Whether a line in lower case has all words of one of the forms that no unified spelling touches.

    Such words stand in the line as they do in its form, so no line that is one of the forms is left out.
    """
    made = [x.strip() for x in (*SPELLINGS.values(), *FILLS.values()) if x.strip()]
    out = F.lit(False)
    for form in forms:
        words = sorted({w for w in form.split() if not any(w in x or x in w for x in made)}, key=lambda w: (-len(w), w))
        out = out | reduce(Column.__and__, [F.contains(line, F.lit(w)) for w in words], F.lit(True))
    return out


def license_scan(
    docs: DataFrame,
    texts: dict[str, str] = TEXTS,
    notices: dict[str, str] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
    titles: dict[str, tuple[str, ...]] = TITLES,
    digests: dict[str, tuple[str, ...]] = DIGESTS,
) -> DataFrame:
    """For every row its id, the canonical ``digest``, ``license`` and ``notices``.

    ``license`` names the known licence that the whole text is, else null. ``notices`` lists, in order and joined by
    commas, the licences whose one-line notice is a line of the text. Null and empty texts have the digest of the empty
    text and no licence. Repeated rows come back as often as given. The known texts are some sixty rows, whatever the
    table; lines are looked up where they lie, so no document is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    marks = known(docs.sparkSession, texts, notices, titles, digests)
    named = marks.where("NOT whole").collect()
    lines = {r["digest"]: r["license"] for r in named}
    # Canonical forms are digested for lines alone that have the words of a notice.
    likely = F.filter(F.split(lower(F.col("text")), "\n"), lambda x: _may_be(x, [r["form"] for r in named]))
    found = F.transform(likely, lambda x: F.create_map(*(F.lit(y) for kv in lines.items() for y in kv))[digest(x)]) if lines else F.array().cast("array<string>")
    whole = F.broadcast(marks.where("whole").select("digest", "license"))
    return (
        rows.select("id", digest(F.col("text")).alias("digest"), F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("n"))
        .join(whole, "digest", "left")
        .select(F.col("id").alias(id_col), "digest", "license", F.array_join("n", ",").alias("notices"))
    )
