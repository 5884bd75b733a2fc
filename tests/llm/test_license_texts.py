"""License texts as files carry them, and the scan against the SQL statement and a reading of the rules in plain Python."""

import random
import re
import textwrap

import duckdb
import pandas as pd
import pytest

from larder.llm import license_scan as L

BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:\n\n")
BSD = [("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
       ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.")]
ENDORSE = ("Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software "
           "without specific prior written permission.")
GNU = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by "
       "the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")


def bsd(mark, holder=None):
    parts = BSD + ([ENDORSE.format(holder)] if holder else [])
    return BSD_HEAD + "\n".join(textwrap.fill(mark.format(i + 1, "abc"[i]) + p, 70) for i, p in enumerate(parts))


CASES = [
    (bsd("{0}. ", "Google Inc."), "BSD-3-Clause"), (bsd("({0}) ", "the Dept. of Physics, St. Mary's Univ."), "BSD-3-Clause"),
    (bsd("{1}) ", "the copyright holder"), "BSD-3-Clause"), (bsd("* ", "A. B. Müller"), "BSD-3-Clause"), (bsd("({0}) "), "BSD-2-Clause"),
    (bsd("{0}. "), "BSD-2-Clause"),
    ("// SPDX-License-Identifier: Apache-2.0\nint main;", "Apache-2.0"), ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only"), ("SPDX-License-Identifier: Nothing-1.0", ""),
    (textwrap.fill("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                   "provided that the above copyright notice and this permission notice appear in all copies.", 60, initial_indent=" * ",
                   subsequent_indent=" * "), "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with "
     "this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    (textwrap.fill(GNU.format("library", ";", "Lesser", ";", "2.1"), 66), "LGPL-2.1-or-later"),
    (textwrap.fill(GNU.format("program", ":", "Lesser", ",", "3"), 66), "LGPL-3.0-or-later"),
    (textwrap.fill(GNU.format("program", ":", "Affero", ",", "3"), 66), "AGPL-3.0-or-later"),
    ("CC0 1.0 Universal\n", "CC0-1.0"), ("This is free and unencumbered software released into the public domain.\n", "Unlicense"),
    ("Eclipse Public License - v 2.0\n\n", "EPL-2.0"), ("Boost Software License - Version 1.0\n", "BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\n"
     "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial "
     "applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Licensed under the MIT License.", "MIT"), ("", ""), (None, ""), ("neither the name of a nor b (c) words)", ""),
]


def plain(text):
    """The rules read line by line: lines joined one after the other until a known sentence is met."""
    t = (text or "").lower().replace("\x01", " ").replace("\x02", " ")
    t = re.sub(L.HOLDER, L.NO_HOLDER, t)
    t = re.sub(L.MARK, r"\1", t)
    parts = [[" ".join(re.findall("[a-z0-9]+", line)) for line in s.split("\n")] for s in re.split(L.STOP.replace(r"\z", r"\Z"), t)]
    ids, n = [], 0
    for lines in ([x for x in p if x] for p in parts):
        n += len(lines)
        i = 0
        while i < len(lines):
            ends = [j for j in range(i + 1, len(lines) + 1) if " ".join(lines[i:j]) in L.ALL_SENTENCES]
            if ends:
                ids.append(L.ALL_SENTENCES[" ".join(lines[i:ends[-1]])])
            i = ends[-1] if ends else i + 1
    rest, found = "".join(f"<{i}>" for i in ids), []
    for name, sequence in L.ALL_RULES:
        want = "".join(f"<{i}>" for i in sequence.split())
        if want in rest:
            rest = rest.replace(want, "|")
            found.append(name)
    return n, " ".join(ids), " ".join(dict.fromkeys(found)), " ".join(re.findall("<([^>]+)>", rest))


def mixed(seed, n=120):
    rnd = random.Random(seed)
    texts = [t for t, _ in CASES]
    for _ in range(n):
        parts = [rnd.choice([rnd.choice(CASES)[0] or "", " ".join(rnd.choices(["some", "words", "(2)", "x)", "neither", "the"], k=rnd.randint(1, 9)))])
                 for _ in range(rnd.randint(1, 5))]
        texts.append(rnd.choice(["\n", "\n\n", ". ", " "]).join(parts))
    return texts + ["Prose. " * 200_000 + CASES[0][0]]


def scan(spark, texts):
    rows = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licenses"], r["unused_ids"]) for r in rows}


def test_each_text_has_its_license(spark):
    got = scan(spark, [t for t, _ in CASES])
    assert [got[i][2] for i in range(len(CASES))] == [name for _, name in CASES]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_the_sql_and_the_plain_reading(spark, seed):
    texts = mixed(seed)
    got = scan(spark, texts)
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)}))
    assert got == {r[0]: r[1:] for r in con.execute(L.oracle_sql()).fetchall()}
