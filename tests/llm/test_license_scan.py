import duckdb
import pandas as pd
import pytest
from cases import CLASH, D2, DOCS

from pageloom.llm import license_scan as ls
from pageloom.llm._spark import table

MIT = """MIT License

Copyright (c) 2021 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"text": "string"}))
    return sorted(con.sql(ls.scan_sql()).fetchall())


def found(df):
    return sorted((r["doc_id"], r["ord"], r["license"]) for r in ls.scan(df).collect())


def test_documents_equal_sql(spark):
    docs = table(spark, D2, "documents")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D2}/documents.parquet'")
    got = found(docs)
    assert got == sorted(con.sql(ls.scan_sql()).fetchall()) and len(got) > 10


ROWS = [
    (1, MIT), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (3, "Some words.\nReleased under CC BY-NC 4.0.\nAnd more. Licensed under the MIT License!"), (4, "the license is unknown"), (5, ""), (6, None),
    (7, "SPDX-License-Identifier: MIT"), (8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."), (9, ("filler words go on and on. " * 20_000) + "\nThis work is in the public domain.\n"), (10, "Copyright 2020 Foo"),
]


def test_rules(make):
    assert found(make(ROWS)) == by_sql(ROWS) == [(1, 0, "MIT"), (2, 0, "Apache-2.0"), (3, 0, "CC-BY-NC-4.0"), (3, 1, "MIT"), (7, 0, "MIT"), (8, 0, "GPL-3.0-or-later"), (9, 0, "Public-Domain")]


@pytest.mark.parametrize("name", sorted(ls._NAMES))
def test_every_name_by_every_verb(make, name):
    rows = [(i, f"{v.capitalize()} the {f}.") for i, (v, f) in enumerate((v, f) for v in ls._VERBS[:3] for f in ls._NAMES[name])]
    assert found(make(rows)) == [(i, 0, name) for i, _ in rows]


def test_odd_rows(spark, make, odd, nothing):
    assert found(odd) == [] and found(nothing) == []
    twice = make([(1, "Licensed under MIT."), (1, "Licensed under MIT."), (None, "Licensed under MIT.")], wide=True)
    assert sorted((r["doc_id"] or 0, r["ord"]) for r in ls.scan(twice).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert set(CLASH) <= set(twice.columns) and DOCS.names == twice.columns[:5]
