import random

import duckdb
import pandas as pd

from locusgrid.llm import licenses as L


def slow(text, least=L.LEAST):
    import re

    text = text or ""
    units = {text, *re.split(r"\n\s*\n", text), *text.split("\n")}
    found = []
    for u in units:
        own = set(L.bigram_list(u))
        scores = [(2.0 * len(own & set(b)) / (len(own) + len(b)), n) for n, t in L.TEMPLATES if own and (b := L.bigram_list(t))]
        if good := [x for x in scores if x[0] >= least]:
            found.append(good)
    top = max(d for own in found for d, _ in own) if found else None
    return (min(n for own in found for d, n in own if d == top) if found else None), top, len(found)


def texts():
    r = random.Random(1)
    out = [None, "", "\n\n", "Released under the MIT License.", "RELEASED under the mit license", "released under license",
           "é Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 4.0."]
    for _, t in L.TEMPLATES:
        words = t.split()
        for _ in range(12):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 5))):
                own[r.randrange(len(own))] = r.choice(["x", "", "license", "software"])
            out.append("Some prose first.\n" + " ".join(own) + r.choice(["", "\nmore", "\n \nLicensed under CC BY-NC 4.0."]))
    return out


def test_matches_brute_force(spark, docs):
    rows = list(enumerate(texts()))
    got = {x.doc_id: (x.license, x.dice, x.n_units) for x in L.scan(docs(rows)).collect()}
    for i, t in rows:
        assert got[i] == slow(t), t
    assert sum(v[2] for v in got.values()) > 60


def test_matches_sql(spark, docs):
    rows = list(enumerate(texts()))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(map(str, con.execute(L.oracle()).fetchall()))
    assert sorted(str(tuple(x)) for x in L.scan(docs(rows)).collect()) == want


def test_odd_tables(spark, docs):
    rows = [(1, None), (1, None), (None, "Released under the MIT License."), (2, "word " * 30000)]
    got = sorted(str((x.doc_id, x.license, x.n_units)) for x in L.scan(docs(rows)).collect())
    assert got == ["(1, None, 0)", "(1, None, 0)", "(2, None, 0)", "(None, 'MIT', 1)"]
    assert L.scan(docs([])).count() == 0 and L.scan(docs(rows), templates=()).filter("license is not null").count() == 0


def test_published_forms(spark, docs):
    cases = [
        ("MIT", L._MIT_GRANT), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Apache License, Version 2.0"),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the "
                    "MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
        ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU "
                     "Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the "
                     "License, or (at your option) any later version."),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007"),
        ("ISC", f"ISC License\n\nCopyright 2020 A. Person\n\n{L._ISC_GRANT}\n\n{L._ISC_WARRANTY}"),
        ("0BSD", f"{L._0BSD_GRANT}\n\n{L._ISC_WARRANTY}"),
        ("BSD-2-Clause", f"Copyright 2020 A. Person\n\n{L._BSD_GRANT}\n\n{L._BSD_TWO}\n\n{L._BSD_WARRANTY}"),
        ("BSD-3-Clause", f"{L._BSD_GRANT}\n\n{L._BSD_TWO}\n{L._BSD_THIRD}\n\n{L._BSD_WARRANTY}"),
    ]
    rows = [(i, f"Some prose first.\n\n{t}\n\nAnd more.") for i, (_, t) in enumerate(cases)]
    got = {x.doc_id: x.license for x in L.scan(docs(rows)).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]
