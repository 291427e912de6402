"""License scan: canonical digests of entire texts, hash-joined to the digests of known licence texts.

The canonical form: lower case; statements of copyright dropped (lines that begin with the word or sign and name a
year or carry the sign, and lines of "all rights reserved" alone); everything but letters and digits read as a space;
equivalent spellings made one. Its SHA-256 is the digest. A second digest keeps the statements of copyright: texts
with their own (the GPL family) are found by it however their lines are wrapped. Digests of whole documents are joined
to a table of known licences (a broadcast of a fixed list, built by the same SQL); besides, each line is looked up
among the digests of one-line licence notices, a constant map, without a join.

Only DataFrame and SQL functions; no shuffle. Null text: null digest and no licence; an empty text has the digest
of the empty string, which is no licence. Rows are kept as they are, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns

# Public licence texts and notices as published, long ones in the file beside; the copyright line is not part of a digest.
TEXTS = {
    "MIT": 'MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    **json.loads(Path(__file__).with_name("license_texts.json").read_text("utf-8")),
}
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorised": "authorized", "behaviour": "behavior", "cancelled": "canceled", "colour": "color", "favour": "favor",
    "fulfil": "fulfill", "honour": "honor", "labelled": "labeled", "licence": "license", "licenced": "licensed", "modelled": "modeled", "non commercial": "noncommercial",
    "non infringement": "noninfringement", "organisation": "organization", "programme": "program", "recognise": "recognize", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while",
}


def canonical_sql(text: str, statements: bool = False) -> str:
    """Spark SQL of the canonical form; with ``statements``, those of copyright stay."""
    x = f"lower({text})"
    if not statements:
        x = f"regexp_replace({x}, '(?m)^[^a-z0-9\\n]*(?:(?:copyright|\\\\(c\\\\)|©)[^\\n]*(?:\\\\(c\\\\)|©|<year>|[12][0-9]{{3}}|yyyy)[^\\n]*|all rights reserved[^a-z0-9\\n]*)$', ' ')"
    x = f"regexp_replace({x}, '[\\\\s!-/:-@\\\\[-`{{-~©«»“”‘’–—…]+', '  ')"  # two, so that each word has its own
    x = f"concat('  ', {x}, '  ')"
    for one, other in SPELLINGS.items():
        x = f"replace({x}, ' {one.replace(' ', '  ')} ', ' {other} ')"
    return f"replace(trim({x}), '  ', ' ')"


def known(spark: SparkSession) -> DataFrame:
    """license_id, digest and digest_with_statements of each known text."""
    rows = spark.createDataFrame(list(TEXTS.items()), "license_id string, text string")
    return rows.select("license_id", F.sha2(F.expr(canonical_sql("text")), 256).alias("digest"), F.sha2(F.expr(canonical_sql("text", True)), 256).alias("digest_with_statements"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text), license_id (null: none), n_lines, line_licenses (sorted, distinct)."""
    table = known(docs.sparkSession)
    of_line = F.create_map(*(F.lit(x) for r in table.collect() for x in (r.digest, r.license_id)))  # the fixed list above
    docs = columns(docs, doc_id="bigint", text="string")
    lines = "filter(split(text, '\\n'), x -> lower(x) rlike 'licen|permission|warrant')"
    digests = F.expr(f"transform({lines}, x -> sha2({canonical_sql('x')}, 256))")
    found = F.filter(F.transform(digests, lambda d: F.try_element_at(of_line, d)), lambda x: x.isNotNull())
    rows = docs.select(
        "doc_id",
        F.sha2(F.expr(canonical_sql("text")), 256).alias("digest"),
        F.when(F.expr("lower(text) like '%copyright%'"), F.sha2(F.expr(canonical_sql("text", True)), 256)).alias("digest_with_statements"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.concat_ws(",", F.array_sort(F.array_distinct(found))), F.lit("")).alias("line_licenses"),
    )
    rows = rows.join(F.broadcast(table.select("digest", F.col("license_id").alias("first"))), "digest", "left")
    rows = rows.join(F.broadcast(table.select("digest_with_statements", F.col("license_id").alias("second"))), "digest_with_statements", "left")
    return rows.select("doc_id", "digest", F.coalesce("first", "second").alias("license_id"), "n_lines", "line_licenses")
