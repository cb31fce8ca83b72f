"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. Both classes get a mean and
a covariance, shrunk towards the pooled one and its diagonal, whose Cholesky
factors are computed once; a score is the difference of the two Mahalanobis log
densities, with the log of the class shares, squashed to 0..1.

Moments are sums over rows of (class, position, value): partial sums in every task,
a few hundred rows in the end, whatever the corpus. Texts are read in one pass to
learn and one to score, and are never shuffled.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import ROW, cut_lineage, listed, packed

THRESHOLD = 0.3
POOLED = 0.1
DIAGONAL = 0.05
#: Words whose share shows running prose; frequent function words of four languages.
FUNCTION_WORDS = frozenset("the of and to in is that it for on with as was by are this be at from or de la le les et des du un une en est que qui dans pour par sur au avec der die das und den von zu mit ein eine ist im nicht auf für sich dem auch el los las y se una por con para del su no lo".split())
#: Counts are drawn towards the usual share with the weight of this many words or letters.
DRAWN = 20.0

STATISTICS = ("words", "chars_a_word", "upper", "digits", "marks", "symbols", "bars", "bangs", "distinct", "top_word", "repeats", "function", "lines_twice", "words_a_line", "long_words", "one_letter")
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_DIGITS = string.digits.encode()
_MARKS = b".,;:?'\"()-"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{}~"


def _logit(count: float, of: float, usual: float) -> float:
    share = (count + DRAWN * usual) / (of + DRAWN)
    share = min(max(share, 1e-4), 1 - 1e-4)
    return math.log(share / (1 - share))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS; null is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n, chars = len(raw), len(text)
    drop = lambda what: n - len(raw.translate(None, what))
    low = text.lower()
    # Capitals of any alphabet: characters that lowering changes.
    if text.isascii() or len(low) != chars:
        upper = drop(_UPPER)
    else:
        upper = int((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())
    words = low.split()
    k = len(words)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in low.split("\n") if x.strip()]
    size = [len(w) for w in words]
    letters = max(chars - (n - len(raw.translate(None, _DIGITS + _MARKS + _SYMBOLS + b"|! \n\t\r"))), 0)
    return [
        math.log1p(k),
        math.log((sum(size) + 5.5 * DRAWN) / (k + DRAWN)),
        _logit(upper, letters, 0.03),
        _logit(drop(_DIGITS), chars, 0.002),
        _logit(drop(_MARKS), k, 0.12),
        _logit(drop(_SYMBOLS), k, 0.002),
        _logit(raw.count(b"|"), k, 0.002),
        _logit(raw.count(b"!"), k, 0.002),
        _logit(len(counts), k, 0.85) + 0.25 * math.log1p(k),
        _logit(top, k, 0.05),
        _logit(sum(map(eq, words, words[1:])), k, 0.005),
        _logit(sum(counts[w] for w in FUNCTION_WORDS if w in counts), k, 0.35),
        _logit(len(lines) - len(set(lines)), len(lines), 0.02),
        math.log((k + 12 * 5) / (len(lines) + 5)),
        _logit(sum(x > 12 for x in size), k, 0.08),
        _logit(sum(x == 1 for x in size), k, 0.02),
    ]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        flat = np.array(found, np.float64).reshape(-1)
        yield pa.RecordBatch.from_arrays([batch.column(0), listed(np.arange(len(found) + 1) * len(STATISTICS), pa.array(flat))], names=[ROW, "x"])


def described(docs: DataFrame, *, keep: list[str] | None, text: str = "text") -> DataFrame:
    """``__row`` and the statistics ``x`` of each document."""
    rows = packed(docs, keep, text=F.col(text))
    return rows.mapInArrow(_describe, f"`{ROW}` {rows.schema[ROW].dataType.simpleString()}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        for k in (0, 1):
            own = x[label == k]
            total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).reshape(-1)))
    width = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width), pa.int32()), pa.array(np.tile(np.arange(width), 2), pa.int32()), pa.array(total.reshape(-1))], names=["label", "at", "value"])


@dataclass
class Model:
    """Means, inverse Cholesky factors of the shrunk covariances, their log determinants and the classes' shares."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    share: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, shares included."""
        side = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse[k].T
            side.append(np.log(self.share[k]) - 0.5 * self.logdet[k] - 0.5 * (z * z).sum(1))
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; asinh keeps the order of far away documents, which a plain logistic would round to 0 or 1."""
        return 1 / (1 + np.exp(-np.arcsinh(self.difference(x))))


@dataclass
class Constant:
    """Where one class has fewer than two labelled rows: the share of label 1, one half if there are none."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def solve(total: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model | Constant:
    d = len(STATISTICS)
    n = total[:, 0]
    if n.min() < 2:
        return Constant(float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    both = scatter.sum(0) / max(n.sum() - 2, 1)
    spread = np.diag(np.maximum(np.diag(both), 1e-6))
    inverse, logdet = [], []
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1)
        factor = np.linalg.cholesky((1 - pooled - diagonal) * own + pooled * both + diagonal * spread)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Model(mean, np.array(inverse), np.array(logdet), n / n.sum())


def held_out(id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(found: DataFrame, labels: DataFrame, *, id: str = "doc_id", label: str = "quality") -> Model | Constant:
    """Learn from described documents and their labels; labels other than 0 and 1 and held out rows are left out.

    A document id with several rows or labels counts once for each pair.
    """
    said = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    # by a shuffle, so that the sums do not run in the tasks that read the texts, with two Python workers each
    rows = found.select(F.col(f"{ROW}.`{id}`").alias("id"), "x").join(said.hint("merge"), "id").select("label", "x")
    sums = rows.mapInArrow(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    total = np.zeros((2, 1 + len(STATISTICS) + len(STATISTICS) ** 2))
    for k, at, value in sums.collect():  # two classes, one row for each position
        total[k, at] = value
    return solve(total)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=[ROW, "score"])

    return run


def _judge(model):
    """Statistics and score in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=[ROW, "score"])

    return run


def scored(found: DataFrame, model: Model | Constant) -> DataFrame:
    """``__row`` and ``score`` of described documents."""
    return found.mapInArrow(_scorer(model), f"`{ROW}` {found.schema[ROW].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: held out or not, score, predicted label."""
    found = cut_lineage(described(docs, keep=[id], text=text))
    own = F.col(f"{ROW}.`{id}`")
    done = scored(found, fit(found, labels, id=id))
    return done.select(own.alias("doc_id"), held_out(own).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fit(described(docs, keep=[id], text=text), labels, id=id)
    rows = packed(docs, None, text=F.col(text))
    judged = rows.mapInArrow(_judge(model), f"`{ROW}` {rows.schema[ROW].dataType.simpleString()}, score double")
    return judged.where(F.col("score") >= threshold).select(f"{ROW}.*")
