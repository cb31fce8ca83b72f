"""How quality filters act on each other, from one byte pass over every text.

A table-driven transducer reads the UTF-8 bytes of a batch of texts once. Its state
is whether it stands in a word; the table gives, for each state and byte, what to
report: a word begins, a word ends, a capital, a symbol, a byte that continues a
code point. The next state hangs on the byte alone, so a block's states are looked
up together, and blocks follow each other with the state carried over.

Word spans go into an open-addressing hash table of spans, one region per text. A
span that meets an occupied slot is compared with the span there byte by byte, so the
number of distinct words is exact whatever the hashes do.

What remains of a document is its failed conditions and the SHA-256 of its text, some
sixty bytes. Copies are told by pre-aggregated rows per digest, never gathered, and the
120 orders are worked out from the 32 counts of each part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metreur.llm.common import ROW, packed

FILTERS = "ABCDE"
#: Bytes that the transducer looks up together, bytes of texts taken at a time, and spans inserted together.
BLOCK = 1 << 18
SLICE = 1 << 21
SPANS = 1 << 17

BEGIN, END, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8, 16
_OUT, _IN = 0, 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state of each byte, report of each state and byte)."""
    after = np.full(256, _IN, np.uint8)
    report = np.zeros((2, 256), np.uint8)
    for byte in range(256):
        blank = byte == 0x20 or 0x09 <= byte <= 0x0D
        if blank:
            after[byte] = _OUT
            report[_IN, byte] |= END
        else:
            report[_OUT, byte] |= BEGIN
        for state in (_OUT, _IN):
            if 0x41 <= byte <= 0x5A:
                report[state, byte] |= CAPITAL
            if byte in b"#$%&*|":
                report[state, byte] |= SYMBOL
            if 0x80 <= byte <= 0xBF:
                report[state, byte] |= INNER
    return after, report.reshape(-1)


_AFTER, _REPORT = _tables()
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def transduce(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> dict[int, np.ndarray]:
    """Places of what is reported over texts that lie end to end, each from ``offsets[k]`` to ``offsets[k + 1]``.

    An END is the place behind the word; at the end of a text an open word is closed.
    """
    found: dict[int, list[np.ndarray]] = {k: [] for k in (BEGIN, END, CAPITAL, SYMBOL, INNER)}
    starts, closes = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
    state = _OUT
    for at in range(0, len(data), block):
        piece = data[at : at + block]
        states = np.empty(len(piece), np.intp)
        after = _AFTER[piece]
        states[0], states[1:], state = state, after[:-1], int(after[-1])
        a, b = np.searchsorted(starts, [at, at + len(piece)])
        states[starts[a:b] - at] = _OUT
        report = _REPORT[states * 256 + piece]
        for k in found:
            found[k].append(np.flatnonzero(report & k) + at)
        # Texts that close in this block, in a word: the byte behind belongs to another text.
        a, b = np.searchsorted(closes, [at, at + len(piece)], side="right")
        found[END].append(closes[a:b][after[closes[a:b] - 1 - at] == _IN])
        if b > a and closes[b - 1] == at + len(piece):
            state = _OUT
    out = {k: np.concatenate([*v, np.zeros(0, np.int64)]) for k, v in found.items()}
    out[END].sort()
    return out


class SpanTable:
    """Spans of ``data`` in open addressing, one region of slots per text; spans of equal bytes are one entry."""

    def __init__(self, data: np.ndarray, words: np.ndarray):
        """``words``: the number of spans of each text."""
        self.wide = np.ndarray((len(data) + 1,), np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        size = np.where(words > 0, 1 << np.ceil(np.log2(np.maximum(2 * words, 2))).astype(np.int64), 0)
        self.mask, self.base = size - 1, np.concatenate([[0], np.cumsum(size)])
        self.begin, self.length = np.zeros(self.base[-1], np.int64), np.full(self.base[-1], -1, np.int64)

    def _chunks(self, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eight bytes at a time of each span (what lies behind it is zero), number in its span, and where each span starts."""
        many = (length + 7) >> 3
        first = np.cumsum(many) - many
        k = np.arange(many.sum()) - np.repeat(first, many)
        left = np.minimum(np.repeat(length, many) - 8 * k, 8)
        return self.wide[np.repeat(begin, many) + 8 * k] & _KEEP[left], k, first

    def _hash(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        value, k, first = self._chunks(begin, length)
        value = (value ^ ((k.astype(np.uint64) + np.uint64(1)) * _ODD[0])) * _ODD[1]
        total = np.add.reduceat((value ^ (value >> np.uint64(31))) * _ODD[2], first) ^ length.astype(np.uint64)
        return ((total ^ (total >> np.uint64(29))) * _ODD[1]) >> np.uint64(20)

    def _equal(self, begin: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether spans of one length hold the same bytes."""
        if not len(begin):
            return np.zeros(0, bool)
        left, _, first = self._chunks(begin, length)
        return np.logical_and.reduceat(left == self._chunks(other, length)[0], first)

    def insert(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each span (of text number ``text``) was new."""
        length, new = end - begin, np.zeros(len(begin), bool)
        if not len(begin):
            return new
        probe, mask, base = self._hash(begin, length).astype(np.int64), self.mask[text], self.base[text]
        todo = np.arange(len(begin))
        while len(todo):
            slot = base[todo] + (probe[todo] & mask[todo])
            free = self.length[slot] < 0
            claim, where = todo[free][::-1], slot[free][::-1]
            self.begin[where], self.length[where] = begin[claim], length[claim]  # of several the first stays
            mine = self.begin[slot] == begin[todo]
            new[todo[mine]] = True
            close = ~mine & (self.length[slot] == length[todo])
            same = np.flatnonzero(close)
            same = same[self._equal(begin[todo[same]], self.begin[slot[same]], length[todo[same]])]
            stay = ~mine
            stay[same] = False
            todo = todo[stay]
            probe[todo] += 1
        return new


def measure(data: np.ndarray, offsets: np.ndarray, spans: int = SPANS) -> np.ndarray:
    """Rows (words, distinct words, capitals, code points, symbols) of texts that lie end to end."""
    seen = transduce(data, offsets)
    inside = lambda places: np.diff(np.searchsorted(places, offsets))
    words = inside(seen[BEGIN])
    table = SpanTable(data, words)
    text = np.repeat(np.arange(len(words)), words)
    distinct = np.zeros(len(words), np.int64)
    for at in range(0, len(text), spans):
        part = slice(at, at + spans)
        new = table.insert(text[part], seen[BEGIN][part], seen[END][part])
        distinct += np.bincount(text[part][new], minlength=len(words))
    return np.stack([words, distinct, inside(seen[CAPITAL]), np.diff(offsets) - inside(seen[INNER]), inside(seen[SYMBOL])])


def _slices(offsets: np.ndarray, bytes_: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of texts of some ``bytes_`` together, one text at least."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + bytes_, side="right")) - 1)
        yield at, to
        at = to


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        _, ends, raw = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw or b"", np.uint8)
        rows = [np.zeros((5, 0), np.int64)]
        for a, b in _slices(offsets):
            rows.append(measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [pa.array(c, pa.int64()) for c in np.concatenate(rows, axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.binary())], names=[ROW, *MEASURES, "digest"])


MEASURES = ("words", "distinct_words", "capitals", "code_points", "symbols")


def measures(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` in a struct, the five measures of the whole text, and its SHA-256. A null text is an empty one.

    A task holds a batch and some forty bytes a word of its longest text.
    """
    rows = packed(docs, keep, text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    kinds = ", ".join(f"{m} bigint" for m in MEASURES)
    return rows.mapInArrow(_measured, f"`{ROW}` {rows.schema[ROW].dataType.simpleString()}, {kinds}, digest binary")


def failures() -> Column:
    """Bits of the conditions A to D that a row of measures fails."""
    failed = (
        F.col("words") < 100, 100 * F.col("distinct_words") < 80 * F.col("words"), 100 * F.col("capitals") > 10 * F.col("code_points"), F.col("symbols") > 0,
    )
    bits = F.lit(0)
    for k, c in enumerate(failed):
        bits = bits + F.when(c, 1 << k).otherwise(0)
    return bits


def marked(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by part and failed conditions: part, mask (bit k: filter k of ``FILTERS``), n, good, toxic.

    Copies (condition E) are rows whose id is larger than the smallest of their text;
    a row without an id is no copy and nobody's original. A document is good or toxic
    if any of its labels says so.
    """
    docs = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    facts = measures(docs, keep=["id", "part"]).select(F.col(f"{ROW}.id").alias("id"), F.col(f"{ROW}.part").alias("part"), failures().alias("bits"), "digest")
    # Rows without an id are dealt by their text, as no label can meet them.
    held = facts.groupBy("id", "part", "bits", "digest").agg(F.count("*").alias("n")).withColumn("apart", F.when(F.col("id").isNull(), F.hex("digest")).otherwise(""))
    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("id"), F.lit("").alias("apart")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = held.withColumn("key", F.coalesce("id", F.lit(0))).join(said.where("id is not null").withColumnRenamed("id", "key"), ["key", "apart"], "left")
    known = known.fillna(0, ["good", "toxic"])
    few = known.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id")
    )
    lowest = F.min("low").over(Window.partitionBy("digest"))
    few = few.withColumn("first", F.coalesce(F.when(F.col("low") == lowest, F.col("at_low")), F.lit(0)) + F.col("no_id"))
    both = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("first").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    rows = few.select("part", "good", "toxic", both.alias("x")).where("x.n > 0")
    return rows.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def _steps() -> Column:
    """Every step of every order: filter_order, step, its bit and the bits before it. One literal, not hundreds of nodes."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": k + 1, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each filter does at each step of each order, per part, zeros included.

    No documents give no parts. Repeated rows count each; of a text's rows those with
    its smallest id are no copies.
    """
    counts = marked(docs, labels, **columns)
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(value, when):
        return F.aggregate("masks", F.lit(0).cast("bigint"), lambda got, m: got + F.when(when(m["mask"].bitwiseAND(bit) != 0, m["mask"].bitwiseAND(before) != 0, m["mask"]), value(m)).otherwise(0))

    n = lambda m: m["n"]
    here = lambda fails, gone, mask: fails & ~gone
    weight = lambda m: m["n"] * (120 / F.bit_count(m["mask"])).cast("bigint")
    return per_part.select("part", "masks", F.explode(_steps()).alias("s")).select(
        "part", "s.filter_order", "s.step",
        total(n, lambda fails, gone, mask: ~fails & ~gone).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda fails, gone, mask: fails & gone).alias("redundant"),
        total(n, lambda fails, gone, mask: mask == bit).alias("unique_fails"),
        total(lambda m: m["good"], here).alias("good_lost"),
        total(lambda m: m["toxic"], here).alias("toxic_lost"),
        # A document that fails k filters is lost to each of them in 120 / k orders.
        total(weight, lambda fails, gone, mask: fails).alias("shapley"),
    )
