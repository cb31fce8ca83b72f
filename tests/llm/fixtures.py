"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and stone water river light house green small round paper morning winter field garden letter window silver copper".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, rows, extra=""):
    """doc_id, text and columns whose names the operators use themselves."""
    clash = "found string, hits string, score double, n_words int, rep string, spans string, length string, n_chars bigint"
    return spark.createDataFrame([(i, t, "f", "h", 1.5, 7, "r", "s", "l", None if t is None else len(t)) for i, t in rows], f"doc_id bigint, text string, {clash}")


def empty(spark):
    return documents(spark, [])
