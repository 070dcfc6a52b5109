"""Licence scans by canonical digest lookup, with DataFrame functions only.

A text is made canonical: capitals become small, statements of a copyright at the beginning of a line go, up
to the end of the line or the words a licence begins with, and "all rights reserved" goes wherever it stands,
so that the digest does not depend on where the lines of the licence break; everything but letters and digits
of any script becomes one space, and words with several accepted spellings get one. Texts that
agree in all this are the same licence; the SHA-256 of the canonical text is joined with the digests of
known licences. The list of known licences is part of the call and small, whatever the corpus holds.

A NULL or empty text has the digest of the empty text and no licence; known licences whose canonical
text is empty or NULL match nothing. Of known licences with equal canonical texts the first by name
counts. Repeated rows are looked up each, other columns are not used, an empty table stays empty.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.operators.staging import staged

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Words that end a copyright statement, as the text of a licence begins with them.
BODY_STARTS = ["licensed", "permission", "redistribution", "this"]
#: Words after "copyright" or "(c)" without a year that belong to the text of a licence: no holder begins with them.
NOT_HOLDERS = [
    *BODY_STARTS, "act", "and", "are", "as", "c", "claim", "claims", "disclaimer", "for", "holder", "holders", "in", "infringement",
    "interest", "interests", "is", "law", "laws", "license", "licence", "licenses", "licences", "licensor", "licensors", "notice",
    "notices", "of", "on", "or", "owner", "owners", "ownership", "protection", "right", "rights", "statement", "statements",
    "that", "to", "treaty", "under", "which", "with", "you", "your",
]
#: Words that begin the text of a list item "(c)" as well.
NOT_MARKED = [*NOT_HOLDERS, "a", "accompany", "all", "an", "any", "each", "if", "it", "must", "no", "not", "the"]
#: Most words of a copyright statement behind its year or the holder's first word.
STATEMENT_WORDS = 30


def _other_than(words: list[str]) -> str:
    """An expression for the words of small letters that are none of ``words`` (RE2 has no look-ahead).

    What follows must not be a letter, and has to be matched behind it.
    """
    def rest(ends: set[str]) -> str:
        begins = sorted({w[0] for w in ends if w})
        if not begins:
            return f"[{LETTERS}]+" if "" in ends else f"[{LETTERS}]*"
        free = LETTERS.translate({ord(c): None for c in begins})
        ways = [f"[{free}][{LETTERS}]*"] + [c + rest({w[1:] for w in ends if w[:1] == c}) for c in begins]
        return f"(?:{'|'.join(ways)})" + ("" if "" in ends else "?")

    return rest(set(words) | {""})


def _statement() -> str:
    """A copyright statement at the beginning of a line: marks with a year or a holder, and the words behind them."""
    blank, mark, line_end = r"[^a-z0-9\n]", r"(?:copyright|\(c\)|©)", "(?m:$)"
    first, marked, word = (_other_than(words) for words in (NOT_HOLDERS, NOT_MARKED, BODY_STARTS))
    begins = [rf"{mark}(?:{blank}{{0,4}}{mark}){{0,2}}{blank}{{0,4}}(?:19|20)[0-9][0-9]",
              rf"copyright(?:{blank}{{0,4}}(?:\(c\)|©))?{blank}{{1,4}}{first}", rf"(?:\(c\)|©){blank}{{0,4}}{marked}"]
    words = rf"[^a-z\n]+(?:{word}[^a-z\n]+){{0,{STATEMENT_WORDS}}}(?:{word}{line_end})?"
    return rf"(?:^|\n){blank}*(?:{'|'.join(begins)})(?:{words}|{line_end})"


COPYRIGHT_LINE = _statement() + r"|(?:^|[^a-z0-9])all[^a-z0-9]{1,20}rights[^a-z0-9]{1,20}reserved"
NOT_WORD = r"[^a-z0-9\p{L}\p{M}\p{N}]+"

#: Words that licence texts spell in several ways, and the spelling that stands for all (fixed values).
SPELLINGS = {
    "acknowledgment": "acknowledgement", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgment": "judgement",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}

#: Known licences and notices (fixed values, public texts).
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
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
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}

#: Longer public texts, one file each, named by licence.
TEXTS = Path(__file__).parent / "licence_texts"

#: Title lines that licence files begin with, each also behind "The".
TITLES = {
    "MIT": ["MIT License", "MIT License (MIT)"],
    "ISC": ["ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD", "Zero-Clause BSD License"],
    "BSD-2-Clause": ["BSD License", "BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD License", "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                     "Revised BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "zlib License (Zlib)", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0", "Boost Software License"],
    "Unlicense": ["Unlicense"],
}

#: The clause that the BSD licence of three clauses has more than that of two.
THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

"""


#: The notice that programs under a licence of the GNU family carry (fixed value), for "{name}".
GNU_NOTICE = """{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published
by the Free Software Foundation, {versions}.

{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with {end}. If not, see <https://www.gnu.org/licenses/>."""
GNU_NAMES = {"AGPL-3.0": "Affero General Public License", "GPL-3.0": "General Public License", "LGPL-3.0": "Lesser General Public License"}
GNU_VERSIONS = {"or-later": "either version 3 of the License, or (at your option) any later version", "only": "version 3 of the License"}

#: Notices of works under a Creative Commons licence (fixed values).
COMMONS_NOTICES = [
    "This work is licensed under {article} Creative Commons {name} 4.0 International License.",
    """This work is licensed under {article} Creative Commons {name} 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/{code}/4.0/.""",
    """This work is licensed under {article} Creative Commons {name} 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
]
COMMONS_NAMES = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def notices() -> list[tuple[str, str]]:
    """(licence, text) of the notices that refer to a licence, in all their usual forms."""
    gnu = [(f"{code}-{which} notice", GNU_NOTICE.format(name=name, versions=versions, subject=subject, end=subject[0].lower() + subject[1:]))
           for code, name in GNU_NAMES.items() for which, versions in GNU_VERSIONS.items() for subject in ("This file", "This program")]
    commons = [(f"CC-{code.upper()}-4.0 notice", form.format(article=article, name=name, code=code))
               for code, name in COMMONS_NAMES.items() for form in COMMONS_NOTICES for article in ("a", "the")]
    return gnu + commons


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all known licences: as they are, on one line, behind titles, without numbers, without what follows their terms."""
    whole = list(KNOWN.items()) + notices() + [(f.stem, f.read_text("utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    whole.append(("BSD-3-Clause", KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS", THIRD_CLAUSE + "THIS SOFTWARE IS")))
    whole += [(n, t.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")) for n, t in whole if n.startswith("BSD-")]
    whole += [(n, re.sub(r"(?m)^\d\. ", "", t)) for n, t in whole if n in ("BSD-2-Clause", "BSD-3-Clause", "Zlib")]
    terms = [(n, re.split(r"\n *END OF TERMS AND CONDITIONS", t)) for n, t in whole]
    whole += [(n, parts[0] + end) for n, parts in terms if len(parts) > 1 for end in ("", "\nEND OF TERMS AND CONDITIONS")]
    whole += [(n, f"{the}{title}\n\n{t}") for n, t in whole for title in TITLES.get(n, []) for the in ("", "The ")]
    # A statement in the middle of a line stays, so a text with statements of its own has another digest on one line.
    return list(dict.fromkeys(whole + [(n, " ".join(t.split())) for n, t in whole]))


def canonical(text: Column) -> Column:
    """The canonical form: small words, one space between them."""
    small = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_replace(F.regexp_replace(small, COPYRIGHT_LINE, "\n"), NOT_WORD, " ")
    # Two spaces between words, so that neighbours can both be replaced.
    spaced = F.concat(F.lit(" "), F.replace(F.trim(words), F.lit(" "), F.lit("  ")), F.lit(" "))
    for given, used in SPELLINGS.items():
        spaced = F.replace(spaced, F.lit(f" {given} "), F.lit(f" {used} "))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "licence string, licence_text string")


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest and licence (NULL: none known) of every document; ``known`` has licence and licence_text.

    The digests of the known licences are written first: then their true size decides whether they go to all
    tasks or documents are shuffled.
    """
    digests = staged(known.where(canonical(F.col("licence_text")) != "").groupBy(
        digest(F.col("licence_text")).alias("known_digest")).agg(F.min("licence").alias("licence")), "licence-digests")
    return docs.select("doc_id", digest(F.col("text")).alias("digest")).join(
        digests, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "licence")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    small = f"lower(coalesce({text}, ''))"
    words = (f"regexp_replace(regexp_replace({small}, {_sql_text(COPYRIGHT_LINE)}, chr(10), 'g'), "
             f"{_sql_text(NOT_WORD)}, ' ', 'g')")
    spaced = f"' ' || replace(trim({words}), ' ', '  ') || ' '"
    for given, used in SPELLINGS.items():
        spaced = f"replace({spaced}, ' {given} ', ' {used} ')"
    return f"trim(replace({spaced}, '  ', ' '))"


ORACLE = f"""
WITH known(licence, body) AS (VALUES {', '.join(f'({_sql_text(n)}, {_sql_text(t)})' for n, t in known_texts())}),
digests AS (SELECT sha256({_sql_canonical('body')}) AS digest, min(licence) AS licence FROM known GROUP BY 1),
scanned AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT doc_id, scanned.digest, licence FROM scanned LEFT JOIN digests ON digests.digest = scanned.digest"""
