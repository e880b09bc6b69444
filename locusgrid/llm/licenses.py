"""License scans: Dice coefficient over word bigrams between units of a text and license templates.

Units are the whole text, its paragraphs and its lines. Expressions only, inside a document's row.
Two tests prune without loss. With a coefficient of ``t`` or more, the number of a unit's bigrams is
between t / (2 - t) times a template's and (2 - t) / t times. And a unit has at least t / (2 - t) of a
template's bigrams, so if some words' bigrams are more than the rest of them, it has one of the words:
texts without any such word of any template are passed over.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that most texts have, so they are taken as signals last.
FREQUENT = frozenset("a an and any by for from in is it of on or that the this to under with work".split())
# Parts of templates.
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction")
_MIT_GRANT = (_MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
              "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
              "do so, subject to the following conditions:")
_MIT_NOTICE = ("The above copyright notice and this permission notice shall be included in all copies or substantial "
               "portions of the Software.")
_MIT_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
                 "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
                 "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                 "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
                 "THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
              "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
                 "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
                 "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
                 "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
                 "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_0BSD_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
               "hereby granted.")
_BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
              "that the following conditions are met:")
_BSD_TWO = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
            "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution.")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission.")
_BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                 "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                 "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
                 "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
                 "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
                 "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
                 "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
                 "POSSIBILITY OF SUCH DAMAGE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
           "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_WARRANTY = ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                    "implied. See the License for the specific language governing permissions and limitations under the "
                    "License.")
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def _gnu(name: str, kind: str, version: str, dated: str, opening: str) -> tuple[tuple[str, str], ...]:
    """The notice of a GNU license, its heading and short variants."""
    return (
        (name, f"{opening} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the "
               f"Free Software Foundation, either version {version} of the License, or (at your option) any later "
               "version."),
        (name, f"GNU {kind} Version {version}, {dated}"),
        (name, f"This work is licensed under the GNU {kind}, version {version}."),
        (name, f"Licensed under the GNU {kind}, version {version}."),
    )


def _creative(name: str, short: str, long: str) -> tuple[tuple[str, str], ...]:
    return ((name, f"Licensed under CC {short} 4.0."), (name, f"This work is licensed under CC {short} 4.0."),
            (name, f"This work is licensed under a Creative Commons {long} 4.0 International License."))


# Fixed values by SPDX name: the texts of the short licenses, whole and by paragraphs, and the notices, headings
# and short variants of all. A paragraph that licenses share (a disclaimer, BSD's first clause) names none.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE_WARRANTY),
    ("Apache-2.0", f"{_APACHE} {_APACHE_WARRANTY}"),
    *_gnu("GPL-3.0", "General Public License", "3", "29 June 2007", "This program is free software:"),
    *_gnu("GPL-2.0", "General Public License", "2", "June 1991", "This program is free software;"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007", "This library is free software:"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999", "This library is free software;"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3", "19 November 2007", "This program is free software:"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "ISC License"),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("0BSD", _0BSD_GRANT),
    ("0BSD", f"{_0BSD_GRANT} {_ISC_WARRANTY}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE "
                     "file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TWO}"),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_WARRANTY}"),
    *_creative("CC-BY-4.0", "BY", "Attribution"),
    *_creative("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"),
    *_creative("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"),
    *_creative("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"),
    *_creative("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    *_creative("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", f"{_MPL} If a copy of the MPL was not distributed with this file, You can obtain one at "
                "http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
)


def word_list(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def bigram_list(text: str) -> list[str]:
    words = word_list(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def signal_words(template: str, least: float) -> list[str]:
    """Words whose bigrams are more of a template's than a match may lack: rare ones, then longest first."""
    bigrams = bigram_list(template)
    chosen: list[str] = []
    for word in sorted(set(word_list(template)), key=lambda w: (w in FREQUENT, -len(w), w)):
        chosen.append(word)
        if sum(any(c in b.split() for c in chosen) for b in bigrams) > len(bigrams) * (2 - 2 * least) / (2 - least):
            break
    return chosen


def bigrams(text: Column) -> Column:
    """The distinct word bigrams of a text; other characters than ASCII letters and digits part words."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))
    return let(F.split(plain, " "), lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1),
                                    lambda a, b: F.concat(a, F.lit(" "), b)))))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, n_units) for each row of ``docs``: the license of the highest coefficient
    that any unit has with any template (of equal ones the first name), and the number of different units
    that match a template.

    Without a match, as for null and empty texts, license and dice are null. A repeated row is repeated, a
    null doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """
    known = [(name, b) for name, text in templates if (b := bigram_list(text))]
    words = sorted({w for _, text in templates for w in signal_words(text, least)})
    signal = f"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])" if words else "a^"
    text = F.coalesce(F.col(text_col), F.lit(""))

    def similarities(unit: Column) -> Column:
        def against(own: Column) -> Column:
            found = []
            for name, b in known:
                fits = F.size(own).between(math.ceil(len(b) * least / (2 - least) - 1e-9),
                                           math.floor(len(b) * (2 - least) / least + 1e-9))
                shared = F.size(F.array_intersect(own, F.split(F.lit("|".join(b)), r"\|")))
                dice = shared.cast("double") * 2.0 / (F.size(own) + len(b))
                found.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
            return F.filter(F.array(*found), lambda s: s["dice"] >= least)

        return let(bigrams(unit), against)

    units = F.filter(F.concat(F.array(text), F.split(text, r"\n\s*\n", -1), F.split(text, "\n", -1)),
                     lambda u: u.rlike(signal))
    none = F.array().cast("array<array<struct<dice:double,license:string>>>")
    matched = none if not known else F.when(text.rlike(signal), F.filter(
        F.transform(F.array_distinct(units), similarities), lambda s: F.size(s) > 0)).otherwise(none)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), matched.alias("m"))
    best = F.array_max(F.flatten("m"))["dice"]
    names = F.transform(F.filter(F.flatten("m"), lambda s: s["dice"] == best), lambda s: s["license"])
    return picked.select("doc_id", F.array_min(names).alias("license"), best.alias("dice"),
                         F.size("m").cast("long").alias("n_units"))


def oracle(templates=TEMPLATES, least: float = LEAST) -> str:
    """The same in SQL for the table ``documents``, without pruning."""
    rows = ", ".join("('{}', {}, [{}])".format(name, len(b), ", ".join(f"'{x}'" for x in b))
                     for name, text in templates if (b := bigram_list(text)))
    return f"""
with templates(license, n, bigrams) as (values {rows}),
units as (
    select distinct doc_id, unit from (
        select doc_id, unnest(list_concat([coalesce(text, '')], regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'),
                              string_split(coalesce(text, ''), chr(10)))) as unit from documents)),
words as (
    select doc_id, unit, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'),
        '[^a-z0-9]+', ' ', 'g')), ' ') as w from units),
own as (
    select doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as b from words),
scored as (
    select doc_id, unit, license, 2.0::double * len(list_intersect(b, bigrams)) / (len(b) + n) as dice
    from own cross join templates where len(b) > 0),
good as (select * from scored where dice >= {least}),
best as (select doc_id, max(dice) as dice, count(distinct unit) as n_units from good group by doc_id)
select d.doc_id, min(g.license) as license, any_value(b.dice) as dice, coalesce(any_value(b.n_units), 0) as n_units
from documents d left join best b on b.doc_id = d.doc_id
left join good g on g.doc_id = d.doc_id and g.dice = b.dice
group by d.doc_id
"""
