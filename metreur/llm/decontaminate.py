"""Benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards of about ``shard_words`` words. Each shard gets a
suffix array over the word positions at which a match could begin or go on; every
suffix of every benchmark item is then looked up in it by binary search, one word
deeper at a time, until its interval is empty. The interval at the depth of a
window gives every place where the window occurs, the last interval that is not
empty gives the longest verbatim match and where it lies.

Words that no benchmark item holds end a match, so positions next to them need
no suffix: they are left out before sorting, which loses nothing.

The benchmark travels to the tasks as a broadcast of at most ``block_bytes`` of
text; a larger one is taken in several blocks, one after the other within one pass
over the documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import ROW, ascii_words, listed, packed

WINDOW = 10
SHARD_WORDS = 200_000
BLOCK_BYTES = 256 << 20

_FOUND = "n_words bigint, hits array<struct<lo:int,hi:int>>, items array<bigint>, longest bigint, longest_item bigint, longest_at bigint"


class Block:
    """Benchmark items as word numbers, one after the other, each followed by -1."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        number, flat, starts, sizes, ids = self.vocabulary, [], [], [], []
        for item_id, text in items:
            words = ascii_words(text)
            if item_id is None or not words:
                continue
            starts.append(len(flat))
            sizes.append(len(words))
            ids.append(item_id)
            flat.extend(number.setdefault(w, len(number)) for w in words)
            flat.append(-1)
        self.flat = np.array(flat or [-1], np.int64)
        self.starts, self.sizes, self.ids = (np.array(x, np.int64) for x in (starts, sizes, ids))
        at = np.flatnonzero(self.flat >= 0)
        self.suffixes = at
        self.item_of = np.searchsorted(self.starts, at, "right") - 1
        # The depth at which a suffix holds a whole window; 0 where none begins.
        room = self.starts[self.item_of] + self.sizes[self.item_of] - at if len(at) else at
        short = (self.sizes < window)[self.item_of] if len(at) else at.astype(bool)
        begins = at == self.starts[self.item_of] if len(at) else at.astype(bool)
        self.depth = np.where(short, np.where(begins, self.sizes[self.item_of] if len(at) else 0, 0), np.where(room >= window, window, 0))
        # For each word the least window that begins with it.
        self.least = np.full(max(len(number), 1), np.iinfo(np.int32).max, np.int64)
        if len(at):
            usable = self.depth > 0
            np.minimum.at(self.least, self.flat[at[usable]], self.depth[usable])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[:-step] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


def _bound(text, order, low, high, word, depth, after: bool):
    """Binary search of many intervals at once for the first suffix whose word at ``depth`` is not below (``after``: above) ``word``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        here = text[np.minimum(order[np.minimum(middle, len(order) - 1)] + depth, len(text) - 1)]
        up = open_ & ((here <= word) if after else (here < word))
        low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)


def search(documents: list[list[bytes]], block: Block) -> list[tuple]:
    """For each document: words, hit ranges, items, longest match, its item and its first word."""
    counts = np.array([len(d) for d in documents], np.int64)
    none = [(int(c), [], [], 0, None, None) for c in counts]
    if not len(block.suffixes) or not counts.sum():
        return none
    ends = np.cumsum(counts + 1)
    text = np.full(ends[-1], -1, np.int64)
    get = block.vocabulary.get
    for words, end in zip(documents, ends, strict=True):
        text[end - 1 - len(words) : end - 1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
    # Runs of benchmark words; those too short for any window that begins in them are left out.
    places = np.arange(len(text))
    stop = np.minimum.accumulate(np.where(text < 0, places, len(text))[::-1])[::-1]
    known = text >= 0
    may = np.zeros(len(text), bool)
    may[known] = (stop - places)[known] >= block.least[text[known]]
    if not may.any():
        return none
    first = np.full(len(text) + 1, len(text))
    np.minimum.at(first, stop[may], places[may])  # of each run, by its end
    kept = np.flatnonzero((places >= first[stop]) & (stop < len(text)))  # with the run's end itself
    own = text[kept]
    ending = own < 0
    breaks = int(ending.sum())
    own = np.where(ending, np.cumsum(ending) - 1, own + breaks)  # ends differ, so that suffixes end there
    order = suffix_array(own)

    active = np.arange(len(block.suffixes))
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(order), np.int64)
    windows: list[tuple[np.ndarray, ...]] = []
    longest: list[tuple[np.ndarray, ...]] = []
    depth = 0
    while len(active):
        at = block.suffixes[active] + depth
        word = block.flat[at]
        ended = word < 0
        word = word + breaks
        left = _bound(own, order, low, high, word, depth, False)
        right = _bound(own, order, left, high, word, depth, True)
        on = ~ended & (left < right)
        full = (block.depth[active] > 0) & (block.depth[active] <= depth)
        over = full & ~on
        longest.append((active[over], low[over], high[over], np.full(int(over.sum()), depth)))
        active, low, high = active[on], left[on], right[on]
        depth += 1
        here = block.depth[active] == depth
        windows.append((active[here], low[here], high[here], np.full(int(here.sum()), depth)))

    suffix, low, high, size = (np.concatenate(x) for x in zip(*windows, strict=True))
    if not len(suffix):
        return none
    # Suffixes with the same interval and depth begin with the same window.
    same, window_of = np.unique(np.stack((low, high, size)), axis=1, return_inverse=True)
    window_of = window_of.reshape(-1)
    low, high, size = same
    reach = high - low
    which = np.repeat(np.arange(len(low)), reach)
    where = kept[order[np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(low, reach)]]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, where, 1)
    np.add.at(change, where + size[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = ends - counts - 1
    range_doc = np.searchsorted(ends, starts, "right")
    # Items: distinct (document, window), then the items of each window.
    pair = np.unique(np.searchsorted(ends, where, "right") * len(low) + which)
    pair_doc, pair_window = np.divmod(pair, len(low))
    by_window = np.unique(window_of * (len(block.ids) + 1) + block.item_of[suffix])
    item_window, item = np.divmod(by_window, len(block.ids) + 1)
    item_from, item_to = np.searchsorted(item_window, pair_window, "left"), np.searchsorted(item_window, pair_window, "right")
    # The longest match of each document: largest depth, then first item, then first place.
    suffix, low, high, size = (np.concatenate(x) for x in zip(*longest, strict=True))
    by_depth = np.lexsort((suffix, -size))
    best: dict[int, tuple[int, int, int]] = {}
    for s, a, b, d in zip(suffix[by_depth], low[by_depth], high[by_depth], size[by_depth], strict=True):
        spot = kept[order[a:b]]
        docs, place = np.unique(np.searchsorted(ends, spot, "right"), return_inverse=True)
        least = np.full(len(docs), len(text))
        np.minimum.at(least, place, spot)
        for doc, spot_ in zip(docs.tolist(), least.tolist(), strict=True):
            best.setdefault(doc, (int(d), int(block.ids[block.item_of[s]]), int(spot_ - begins[doc])))
    out = [list(x) for x in none]
    for doc, a, b in zip(range_doc.tolist(), starts.tolist(), stops.tolist(), strict=True):
        out[doc][1].append((a - int(begins[doc]), b - int(begins[doc])))
    for doc, a, b in zip(pair_doc.tolist(), item_from.tolist(), item_to.tolist(), strict=True):
        out[doc][2].extend(block.ids[item[a:b]].tolist())
    for doc, found in best.items():
        out[doc][3:] = found
    return [(c, hits, sorted(set(items)), size_, item_, at_) for c, hits, items, size_, item_, at_ in out]


def _columns(found: list[tuple]) -> list[pa.Array]:
    hits, items = [f[1] for f in found], [f[2] for f in found]
    span = pa.StructArray.from_arrays(
        [pa.array([r[k] for h in hits for r in h], pa.int32()) for k in (0, 1)], names=["lo", "hi"]
    )
    return [
        pa.array([f[0] for f in found], pa.int64()),
        listed(np.cumsum([0, *map(len, hits)]), span),
        listed(np.cumsum([0, *map(len, items)]), pa.array([i for x in items for i in x], pa.int64())),
        *[pa.array([f[k] for f in found], pa.int64()) for k in (3, 4, 5)],
    ]


_NAMES = ["n_words", "hits", "items", "longest", "longest_item", "longest_at"]


def _together(old: dict, new: tuple) -> tuple:
    """Findings of earlier blocks of the benchmark and of one more, for one text."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted([(r["lo"], r["hi"]) for r in old["hits"]] + new[1]):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    best = min((tuple(old[n] for n in _NAMES[3:]), new[3:]), key=lambda p: (-p[0], p[1] or 0, p[2] or 0))
    return (new[0], spans, sorted({*old["items"], *new[2]}), *best)


def _searcher(shared, shard_words: int, last: bool = True):
    """Findings of one block for rows (row, text) or, behind another block, (row, text, findings); but for the ``last`` block with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        held: list[pa.RecordBatch] = []
        words: list[list[bytes]] = []
        size = 0

        def flush():
            found = search(words, block)
            begin = 0
            for part in held:
                own = found[begin : begin + len(part)]
                begin += len(part)
                if part.num_columns > 2:
                    own = [_together(old, new) for old, new in zip(part.select(_NAMES).to_pylist(), own, strict=True)]
                passed = 1 if last else 2
                yield pa.RecordBatch.from_arrays([*part.columns[:passed], *_columns(own)], names=[*part.schema.names[:passed], *_NAMES])

        for batch in batches:
            begin = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = ascii_words(text)
                words.append(own)
                size += len(own) + 1
                if size >= shard_words:
                    held.append(batch.slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield from flush()
                    held, words, size = [], [], 0
            if begin < len(batch):
                held.append(batch.slice(begin))
        if held:
            yield from flush()

    return run


def matches(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each document's row with what benchmark items it holds.

    Columns: ``__row`` (struct of the kept columns), ``n_words``, ``hits`` (word
    ranges, end exclusive, apart from each other), ``items`` (ids, sorted),
    ``longest`` (words of the longest verbatim match of a whole window or more, 0
    if none), ``longest_item``, ``longest_at`` (its first word). Null and empty
    texts have no words. Items without an id or without words are none; an id
    that comes twice counts once. Repeated documents each get their row. A benchmark
    of several blocks is searched block after block in one pass over the documents:
    each hands its findings on beside the text, and nothing is shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("words")).where("item is not null")
    blocks = 1 + int(items.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block_bytes
    rows = packed(docs, keep, words=F.col(text).cast("string"))
    kind = f"`{ROW}` {rows.schema[ROW].dataType.simpleString()}"
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        block = Block([tuple(r) for r in mine.collect()], window)  # a block of block_bytes
        last = b == blocks - 1
        rows = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(block), shard_words, last), f"{kind}, {_FOUND}" if last else f"{kind}, words string, {_FOUND}")
    return rows


def report(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """One row per document: what of it is contaminated, and by which items."""
    found = matches(docs, benchmark, keep=[id], **options)
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["hi"] - r["lo"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col(f"{ROW}.`{id}`").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "items", "longest", "longest_item", "longest_at",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any benchmark item, with their columns."""
    return matches(docs, benchmark, keep=None, **options).where(F.size("hits") == 0).select(f"{ROW}.*")
