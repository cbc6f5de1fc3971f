import textwrap

import duckdb

from waymark.llm.licenses import KNOWN, licenses_sql, scan

NOTICES = [
    "Copyright (c) 2020 A B", "(c) 2020 X", "© 2020 X", "Copyright Foo Inc. 2020", "Copyright: 2020 X", "Copyright (c)  2020", "Copyright 2019-2021 A, B and others.",
    "COPYRIGHT © 2020 X. All rights reserved.", "Copyright The Foo Authors. All Rights Reserved.", "Copyright (C) [year] [fullname]",
]


def test_scan(spark):
    isc = KNOWN["ISC"]
    rows = [(1, "Copyright (c) 2020 A B\n" + isc.upper()), (2, isc.replace(",", " ;")), (3, isc + " more"), (4, None), (5, ""), (None, isc), (1, isc)]
    got = [(r.doc_id, r.license) for r in scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "ISC"), (2, "ISC"), (3, None), (4, None), (5, None), (None, "ISC"), (1, "ISC")], key=str)
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def names(spark, rows):
    return dict(scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("doc_id", "license").collect())


def test_known_texts(spark):
    usual = {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "ISC", "Zlib", "Unlicense", "CC0-1.0"}
    assert usual <= KNOWN.keys()
    rows = [(n, how(t)) for n, t in KNOWN.items() for how in (str, lambda t: " ".join(t.split()), lambda t: "\n".join(textwrap.wrap(t, 61)), lambda t: t.replace("\n", "\r\n# "))]
    got = names(spark, [t for _, t in rows])
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]
    bsd = KNOWN["BSD-3-Clause"].replace("the University nor", "Foo, Inc. nor").replace("THE REGENTS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS").replace("THE REGENTS OR", "FOO OR")
    more = ["The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + KNOWN["MIT"], bsd, KNOWN["Apache-2.0"].split("END OF TERMS")[0], KNOWN["MIT"].replace("notice shall", "notice shall not"), KNOWN["MIT"] * 2]
    assert list(names(spark, more).values()) == ["MIT", "BSD-3-Clause", "Apache-2.0", None, None]


def test_sql(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "©", "Ünïcode licence (c) x", *NOTICES, *(n + "\n" + KNOWN["MIT"] for n in NOTICES), *(n + " " + KNOWN["ISC"] for n in NOTICES), *KNOWN.values()])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    ours = [tuple(r) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(ours) == sorted(con.execute(licenses_sql()).fetchall())


def test_notices(spark):
    one = " ".join(KNOWN["MIT"].split())
    rows = [n + "\n\n" + KNOWN["MIT"] for n in NOTICES] + [n + " " + one for n in NOTICES] + [n + "\r\n" + textwrap.fill(n + " " + one, 50) for n in NOTICES]
    assert {k for k, v in names(spark, rows).items() if v != "MIT"} == set()
    # a notice never takes the rest of a text with it
    texts = ["Copyright (c) 2020 A " + w * 300 for w in ("x ", "y ")]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.digest for r in got}) == 2
