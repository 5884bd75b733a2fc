"""License scan by sentence rules, in DataFrame functions only.

A text is cut into lines at line feeds and after . ! ? ; before white space,
and each line is normalised (lower case, every run of other signs than a-z and
0-9 is one space).  A sentence is a line or several of them, as licenses are
hard-wrapped, with indentation and comment signs: it goes over single line
feeds, not over a stop or a line without letters and digits.  A normalised
sentence that is known has an identifier, the longest one first where several
begin with a line; the identifiers of a text, in order, are matched against ordered
rules: a rule names a license and the sequence of identifiers that states it,
unknown sentences in between left out.  Rules are tried in order, longer
statements first; identifiers that a rule has used are not used again, and what
no rule uses is reported.

Nothing is shuffled and nothing joined: sentences and rules are fixed tables of
this module, held as literals.

Before that the holder's name in "Neither the name of ... nor the names of its
contributors" is replaced, stops and all, and list marks such as (1) or a) are
left out.  A line ``SPDX-License-Identifier: NAME`` is a sentence of its own.

``n_sentences`` counts the lines.

Defined cases: a null or empty text has no sentence and no license; repeated
rows and ids each give a row; a null id is returned as null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses and of their notices, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-REF",
    "licensed under the mit license": "MIT-REF",
    "the mit license mit": "MIT-TITLE",
    "mit license": "MIT-TITLE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-WARRANTY",
    "licensed under the apache license version 2 0": "APACHE2-REF",
    "licensed under the apache license version 2 0 the license": "APACHE2-REF",
    "you may not use this file except in compliance with the license": "APACHE-USE",
    "you may obtain a copy of the license at": "APACHE-COPY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE-COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
    "as is basis without warranties or conditions of any kind either express or implied": "APACHE-WARRANTY",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE-SEE",
    "this work is licensed under the gnu general public license version 3": "GPL3-REF",
    "licensed under the gnu general public license version 3": "GPL3-REF",
    "this work is licensed under the gnu general public license version 2": "GPL2-REF",
    "licensed under the gnu general public license version 2": "GPL2-REF",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "GPL3-LATER",
    "this program is free software": "GPL-FREE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation": "GPL-TERMS",
    "either version 3 of the license or at your option any later version": "GPL-V3-LATER",
    "either version 2 of the license or at your option any later version": "GPL-V2-LATER",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL-WARRANTY",
    "you should have received a copy of the gnu general public license along with this program": "GPL-COPY",
    "licensed under cc by nc 4 0": "CC-BY-NC-4-REF",
    "licensed under cc by 4 0": "CC-BY-4-REF",
    "licensed under cc by sa 4 0": "CC-BY-SA-4-REF",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "all rights reserved": "RIGHTS-RESERVED",
}
# Rules in the order in which they are tried.
RULES = [
    ("Apache-2.0", "APACHE2-REF APACHE-USE APACHE-COPY APACHE-WARRANTY APACHE-SEE"),
    ("MIT", "MIT-TITLE MIT-GRANT MIT-NOTICE MIT-WARRANTY"),
    ("MIT", "MIT-GRANT MIT-NOTICE MIT-WARRANTY"),
    ("GPL-3.0-or-later", "GPL-FREE GPL-TERMS GPL-V3-LATER GPL-WARRANTY GPL-COPY"),
    ("GPL-2.0-or-later", "GPL-FREE GPL-TERMS GPL-V2-LATER GPL-WARRANTY GPL-COPY"),
    ("GPL-3.0-or-later", "GPL3-LATER GPL-WARRANTY GPL-COPY"),
    ("BSD-2-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY"),
    ("GPL-3.0-or-later", "GPL-FREE GPL-TERMS GPL-V3-LATER"),
    ("GPL-2.0-or-later", "GPL-FREE GPL-TERMS GPL-V2-LATER"),
    ("GPL-3.0-or-later", "GPL3-LATER"),
    ("Apache-2.0", "APACHE2-REF"),
    ("MIT", "MIT-REF"),
    ("MIT", "MIT-TITLE"),
    ("GPL-3.0-only", "GPL3-REF"),
    ("GPL-2.0-only", "GPL2-REF"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4-REF"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4-REF"),
    ("CC-BY-4.0", "CC-BY-4-REF"),
]
# Sentences and rules of further licenses.
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
MORE_SENTENCES = {
    f"neither the name of the copyright holder nor the names of its contributors {_ENDORSE}": "BSD-ENDORSE",
    f"the name of the author {_ENDORSE.replace('may be', 'may not be')}": "BSD-ENDORSE",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-GRANT",
    "isc license": "ISC-TITLE",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2-TERMS",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2-COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2-COPY",
    "mozilla public license version 2 0": "MPL2-TITLE",
    "this library is free software": "LGPL-FREE",
    _GNU.format("lesser"): "LGPL-TERMS",
    _GNU.format("affero"): "AGPL-TERMS",
    _LATER.format("2 1"): "GPL-V21-LATER",
    f"this library is free software {_GNU.format('lesser')} {_LATER.format('2 1')}": "LGPL21-LATER",
    f"this program is free software {_GNU.format('lesser')} {_LATER.format('3')}": "LGPL3-LATER",
    f"this library is free software {_GNU.format('lesser')} {_LATER.format('3')}": "LGPL3-LATER",
    f"this program is free software {_GNU.format('affero')} {_LATER.format('3')}": "AGPL3-LATER",
    "cc0 1 0 universal": "CC0-TITLE",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to "
    "the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "CC0-WAIVER",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-FREE",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
    "binary for any purpose commercial or non commercial and by any means": "UNLICENSE-GRANT",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available "
    "at https www eclipse org legal epl 2 0": "EPL2-REF",
    "eclipse public license v 2 0": "EPL2-TITLE",
    "boost software license version 1 0": "BSL-TITLE",
    "distributed under the boost software license version 1 0": "BSL-REF",
    "this software is provided as is without any express or implied warranty": "ZLIB-WARRANTY",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZLIB-LIABLE",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
}
MORE_RULES = [
    ("ISC", "ISC-TITLE ISC-GRANT"),
    ("ISC", "ISC-GRANT"),
    ("0BSD", "0BSD-GRANT"),
    ("MPL-2.0", "MPL2-TERMS MPL2-COPY"),
    ("MPL-2.0", "MPL2-TERMS"),
    ("MPL-2.0", "MPL2-TITLE"),
    ("LGPL-2.1-or-later", "LGPL-FREE LGPL-TERMS GPL-V21-LATER"),
    ("LGPL-3.0-or-later", "LGPL-FREE LGPL-TERMS GPL-V3-LATER"),
    ("LGPL-3.0-or-later", "GPL-FREE LGPL-TERMS GPL-V3-LATER"),
    ("AGPL-3.0-or-later", "GPL-FREE AGPL-TERMS GPL-V3-LATER"),
    ("LGPL-2.1-or-later", "LGPL21-LATER"),
    ("LGPL-3.0-or-later", "LGPL3-LATER"),
    ("AGPL-3.0-or-later", "AGPL3-LATER"),
    ("CC0-1.0", "CC0-TITLE CC0-WAIVER"),
    ("CC0-1.0", "CC0-TITLE"),
    ("CC0-1.0", "CC0-WAIVER"),
    ("Unlicense", "UNLICENSE-FREE UNLICENSE-GRANT"),
    ("Unlicense", "UNLICENSE-FREE"),
    ("EPL-2.0", "EPL2-REF"),
    ("EPL-2.0", "EPL2-TITLE"),
    ("BSL-1.0", "BSL-REF"),
    ("BSL-1.0", "BSL-TITLE"),
    ("Zlib", "ZLIB-WARRANTY ZLIB-LIABLE ZLIB-GRANT"),
]
# Names that may stand in a line "SPDX-License-Identifier: NAME".
SPDX = ("MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only "
        "LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC 0BSD MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
        "CC-BY-NC-4.0 Unlicense EPL-2.0 BSL-1.0 Zlib").split()


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


ALL_SENTENCES = SENTENCES | MORE_SENTENCES | {_normal(f"SPDX-License-Identifier: {name}"): f"SPDX-{name}" for name in SPDX}
ALL_RULES = [r for rule in RULES for r in (
    [("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE"), rule] if rule[0] == "BSD-2-Clause" else [rule])] + MORE_RULES + [
    (name, f"SPDX-{name}") for name in SPDX]
_GAP = "[^a-z0-9]+"
#: The holder's name in the third condition of BSD-3-Clause, 12 words at most, stops in it included.
HOLDER = (_GAP.join("neither the name of".split()) + f"{_GAP}(?:[a-z0-9]+{_GAP}){{1,12}}?" + _GAP.join("nor the names of its contributors".split()))
NO_HOLDER = "neither the name of the copyright holder nor the names of its contributors"
#: A list mark before a sentence: (1), 2), (a), iv).
MARK = r"(\n|^)[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\)[ \t]+"
# A stop, or a line without letters and digits, ends a sentence (\x01); another line feed ends a line (\x02).
STOP = r"[.!?;][ \t\r\n]+|[.!?;]+\z|\n[^a-z0-9\n]*\n[^a-z0-9]*"


def _wrapped(sentence: str, line: str = "\x02") -> str:
    """Pattern of a normalised sentence whose words may stand on several lines."""
    return f"(?: |{line})".join(map(re.escape, sentence.split()))


def _padded(ids: str) -> str:
    """A sequence of identifiers as text in which whole identifiers can be sought."""
    return "".join(f"<{i}>" for i in ids.split())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = ALL_SENTENCES,
                  rules: list[tuple[str, str]] = ALL_RULES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_sentences, sentence_ids,
    licenses, unused_ids``; lists are joined by one space, ``licenses`` in the
    order of the rules that matched, each once."""
    text = F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    known = F.create_map(*[F.lit(v) for pair in sentences.items() for v in pair])
    text = F.translate(text, "\x01\x02", "  ")
    # the stops in a holder's name end no sentence
    text = F.when(text.contains("neither"), F.regexp_replace(text, HOLDER, NO_HOLDER)).otherwise(text)
    text = F.when(text.contains(")"), F.regexp_replace(text, MARK, "$1")).otherwise(text)
    marked = F.translate(F.regexp_replace(text, STOP, "\x01"), "\n", "\x02")
    clean = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\x01\x02]+", " "), " ?([\x01\x02]) ?", "$1")
    # each line stands between two marks
    lines = F.concat(F.lit("\x02"), F.replace(F.btrim(clean), F.lit("\x01"), F.lit("\x02\x01\x02")), F.lit("\x02"))
    sought = "|".join(map(_wrapped, sorted(sentences, key=len, reverse=True))) or "(?!)"
    # only the identifiers go on from here
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), lines.alias("lines"))
    seen = F.regexp_extract_all("lines", F.lit(f"\x02({sought})(?=\x02)"), F.lit(1))
    found = rows.select("doc_id", F.size(F.filter(F.split("lines", "[\x01\x02]+"), lambda s: s != "")).alias("n_sentences"),
                        F.transform(seen, lambda s: F.element_at(known, F.translate(s, "\x02", " "))).alias("ids"))
    rest = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    out = found.withColumn("rest", rest).withColumn("hits", F.array().cast("array<string>"))
    for name, sequence in rules:
        want = F.lit(_padded(sequence))
        out = out.select("doc_id", "n_sentences", "ids", F.replace("rest", want, F.lit("|")).alias("rest"),
                         F.when(F.instr("rest", _padded(sequence)) > 0, F.array_append("hits", F.lit(name)))
                         .otherwise(F.col("hits")).alias("hits"))
    return out.select(
        "doc_id", "n_sentences", F.concat_ws(" ", "ids").alias("sentence_ids"),
        F.concat_ws(" ", F.array_distinct("hits")).alias("licenses"),
        F.concat_ws(" ", F.regexp_extract_all("rest", F.lit("<([^>]+)>"), F.lit(1))).alias("unused_ids"))


def oracle_sql() -> str:
    """The operator's own rules; a line feed is written twice, as the patterns here can't look ahead."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in ALL_SENTENCES.items())
    steps, rest, hits = [], "rest0", []
    for k, (name, sequence) in enumerate(ALL_RULES):
        want = quote(_padded(sequence))
        steps.append(f"r{k} AS (SELECT *, replace(rest{k}, {want}, '|') AS rest{k + 1} FROM "
                     f"{'f' if not k else f'r{k - 1}'})")
        hits.append(f"CASE WHEN contains(rest{k}, {want}) THEN {quote(name)} END")
        rest = f"rest{k + 1}"
    last = f"r{len(ALL_RULES) - 1}"
    sought = "|".join(_wrapped(x, "\\x02\\x02").replace("\\ ", " ") for x in sorted(ALL_SENTENCES, key=len, reverse=True))
    return rf"""
WITH known(sentence, id) AS (VALUES {table}),
d AS (SELECT doc_id, translate(lower(coalesce(text, '')), chr(1) || chr(2), '  ') AS text FROM documents),
p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{HOLDER}', '{NO_HOLDER}', 'g'), '{MARK}', '\1', 'g') AS text FROM d),
m AS (SELECT doc_id, translate(regexp_replace(text, '{STOP}', chr(1), 'g'), chr(10), chr(2)) AS text FROM p),
c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^a-z0-9\x01\x02]+', ' ', 'g'), ' ?([\x01\x02]) ?', '\1', 'g') AS text FROM m),
l AS (SELECT doc_id, chr(2) || replace(trim(text), chr(1), chr(2) || chr(1) || chr(2)) || chr(2) AS text FROM c),
s AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\x01\x02]+'), lambda x: x <> '')) AS n,
             list_transform(regexp_extract_all(replace(text, chr(2), chr(2) || chr(2)), '\x02({sought})\x02', 1),
                            lambda x: replace(x, chr(2) || chr(2), ' ')) AS found FROM l),
u AS (SELECT doc_id, unnest(found) AS sentence, generate_subscripts(found, 1) AS place FROM s),
g AS (SELECT doc_id, list(id ORDER BY place) AS ids FROM u JOIN known USING (sentence) GROUP BY doc_id),
f AS (SELECT s.doc_id, n, coalesce(ids, []) AS ids,
             array_to_string(list_transform(coalesce(ids, []), lambda i: '<' || i || '>'), '') AS rest0
      FROM s LEFT JOIN g USING (doc_id)),
{', '.join(steps)},
h AS (SELECT *, [{', '.join(hits)}] AS hits FROM {last})
SELECT doc_id, n::INT AS n_sentences, array_to_string(ids, ' ') AS sentence_ids,
  array_to_string(list_transform(list_filter(range(1, {len(ALL_RULES) + 1}),
    lambda i: hits[i] IS NOT NULL AND list_position(hits, hits[i]) = i), lambda i: hits[i]), ' ') AS licenses,
  array_to_string(regexp_extract_all({rest}, '<([^>]+)>', 1), ' ') AS unused_ids
FROM h
"""
