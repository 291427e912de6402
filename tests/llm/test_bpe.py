"""Byte-level BPE where rows are shuffled: long texts, their copies, rows that come in another order."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_operators import by_id, frame

from visbag.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_long_texts_in_any_order(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "béta", "'s", "x" * 700, "12345", "  ", "\n\n", "ßß"]) for _ in range(n)) for n in (3000, 5000)] + ["y" * 90_000, "short"]
    rows = [(i, t) for i in range(6) for t in [texts[i % 4]]] + [(None, texts[0]), (0, texts[0]), (0, texts[1])]
    encoding = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})
    want = set()
    for i, t in rows:
        ids = encoding.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    # rows reach the operator in a different order at each evaluation
    shuffled = frame(spark, rows).withColumn("z", F.rand()).repartition(5, "z")
    got = [tuple(r) for r in byte_bpe.encoded(shuffled, PATH, PATTERN).collect()]
    assert set(got) == want and len(got) == len(rows)
    assert by_id(byte_bpe.encoded(frame(spark, [(1, texts[0])]), PATH, PATTERN, digests=False), "decoded")[1][0] == texts[0].encode()
