"""License scan: whole texts however wrapped, statements of copyright, spellings; the SQL beside it."""

from __future__ import annotations

import re
import textwrap

import duckdb
from test_operators import by_id, frame

from visbag.llm import licenses
from visbag.llm.oracles import LICENSE

LONG = {k: v for k, v in licenses.TEXTS.items() if len(v) > 200}


def wrapped(text: str, width: int) -> str:
    return "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n\s*\n", text))


def test_whole_texts_rewrapped(spark):
    assert len(LONG) >= 20
    rows = [(100 * i + k, wrapped(t, w) if w else t.upper()) for i, t in enumerate(LONG.values()) for k, w in enumerate((40, 72, 200, 0))]
    rows += [(100_000 + i, t.replace("<year> <holder>", "2021-2023 Ann Author\nAll rights reserved.")) for i, t in enumerate(LONG.values())]
    want = {100 * i + k: (name,) for i, name in enumerate(LONG) for k in range(4)} | {100_000 + i: (name,) for i, name in enumerate(LONG)}
    assert by_id(licenses.scanned(frame(spark, rows)), "license_id") == want


def test_spellings_side_by_side(spark):
    rows = [(1, "licence licence colour colour"), (2, "License license, color\ncolor"), (3, "non-commercial non commercial"), (4, "noncommercial Noncommercial"), (5, "licence"), (6, None), (7, ""), (8, "copyright notice stays"), (9, "Copyright 2020 goes")]
    got = by_id(licenses.scanned(frame(spark, rows)), "digest")
    assert got[1] == got[2] and got[3] == got[4] and got[5] != got[1] and got[6] == (None,) and got[7] == got[9] != got[8]


def test_scan_equals_sql(spark):
    rows = [(i, wrapped(t, 60)) for i, t in enumerate(LONG.values())] + [(100, None), (101, ""), (102, "x\nReleased under the MIT Licence.\n(c) 2020 y\nlicence  licence non-commercial sub-licence"), (103, "All rights reserved"), (104, "behaviour " * 50)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(LICENSE).fetchall()}
    assert by_id(licenses.scanned(frame(spark, rows)), "digest", "license_id", "n_lines", "line_licenses") == want
