"""Rows that every operator must take: nulls, empty and long texts, repeated rows, and extra columns with names operators use."""

from __future__ import annotations

import random

CLASHES = ("key1", "fp", "found", "score", "host", "verdict", "size", "kept", "failed", "n_words", "n_tokens", "license", "spans", "at")
LONG = " ".join(random.Random(5).choices("the of and stone water river hill road tree light".split(), k=30_000))


def odd(spark, source: bool = True):
    texts = [
        (None, None, None), (1, "", "a"), (2, " \n\t\x0b", "a"), (3, "x", "b"), (3, "x", "b"), (4, LONG, "a"), (5, LONG, None),
        (6, "same words here again and again " * 20, "a"), (7, "same words here again and again " * 20, "a"),
        (8, "Ünï çödé 日本 😀 words stand here", "c"), (None, "an id that is null and a text", "c"), (9, None, "b"),
    ]
    columns = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in texts], columns)


def empty(spark):
    return odd(spark).filter("false")
