"""Likeness of two designations."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metreur.functions.text import as_column, comparison_tokens, jaccard, normalize_text


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two normalised texts (order of arguments matters).

    No built-in equals it: ``levenshtein`` is another measure. Designations
    repeat from bill to bill, so each worker remembers recent answers.
    """
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


# A filter on the answer must not make the planner ask again above it.
sequence_ratio = sequence_ratio.asNondeterministic()


def sequence_similarity(a, b) -> Column:
    return sequence_ratio(normalize_text(a), normalize_text(b))


def line_similarity(a, b) -> Column:
    """Mean of sequence likeness and shared vocabulary; 0 when a side is empty."""
    na, nb = normalize_text(a), normalize_text(b)
    shared = jaccard(comparison_tokens(na, True), comparison_tokens(nb, True))
    return F.when((na == "") | (nb == ""), F.lit(0.0)).otherwise((sequence_ratio(na, nb) + shared) / 2)


def ratio_ceiling(a, b) -> Column:
    """No sequence ratio of texts of these lengths can exceed this."""
    a, b = F.length(as_column(a)), F.length(as_column(b))
    return 2 * F.least(a, b) / (a + b)
