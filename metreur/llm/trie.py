"""Prefix trie of conversations by range minima over sorted common prefixes.

A conversation is the sequence of the digests of its turns. Sequences are sorted, dealt
over tasks by ranges, and each is described by the length of the prefix it shares with the
one before (LCP). A prefix of d turns is a node; its conversations are the stretch around
any of them in which no LCP is below d.

1. In each range a sparse table holds the minima of LCPs over stretches of 1, 2, 4, ...
   rows. Every prefix that a row is the first to show is a candidate: it finds the right end
   of its own stretch and both ends of its parent's by doubling steps through the
   table, each for itself. Sums over a stretch (leaves, saved bytes, children) are
   differences of running sums or ranks, the smallest member is a range minimum as well.
2. A stretch that goes on beyond its range is found by the same search over one row a
   range (least LCP inside, LCP to the range before). Each range gives its share of such
   nodes, keyed by depth and the range where they begin; shares are added up.
3. The members that end at a node are neighbours in order of their ids. Where they
   fill several ranges their ids come as pieces of text and are hashed as a stream.

A first turn, or a whole conversation, that a third of all conversations share is
therefore spread over ranges like any other; no task holds more than its range and no group
is gathered. A conversation's digests are one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import bounded_batches, cut_lineage

#: Turns and conversations of one range.
RANGE_ROWS = 200_000
#: Ids of one piece of a list that fills several ranges.
PIECE = 4096
#: Rows of one Arrow batch of nodes.
OUT_ROWS = 50_000
DIGEST = 16
#: Head turns that a contract's conversation takes from the first of its five, at most.
HEAD = 8
_NONE = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max


def sequences(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (array of digest in hex and bytes of the text), in order.

    Turns without a number come first; turns of one number stand in the order of role,
    then digest, and repeated ones count each. Null roles and texts are empty. Rows without
    a conversation take no part. Two turns are equal when the MD5 of role and text are.
    """
    role_, text_ = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    one = F.struct(
        F.col(f"`{turn}`").isNotNull().alias("some"), F.col(f"`{turn}`").cast("bigint").alias("turn"), role_.alias("role"),
        F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)).alias("digest"), F.octet_length(text_).cast("bigint").alias("bytes"),
    )
    rows = turns.select(F.col(f"`{conversation}`").cast("bigint").alias("conv_id"), one.alias("one")).where("conv_id is not null")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(held: DataFrame) -> DataFrame:
    """Conversations with their first turns taken from the first conversation of their five.

    Conversation c: the first h turns of conversation c - c % 5, then its own after its first
    h, with h = crc32 of c in decimal, modulo 9. ``held`` is read twice and must be stored.
    """
    many = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    heads = held.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head"))
    own = held.select("conv_id", "turns", many.alias("h"), F.expr("conv_id - conv_id % 5").alias("base"))
    both = own.join(heads, "base", "left")
    none = F.slice("turns", F.lit(1), F.lit(0))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def _shared(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of each sequence after the first with the one before; ``flat`` holds two numbers a turn."""
    size = np.diff(offsets)
    least = np.minimum(size[:-1], size[1:])
    out = least.copy()
    full = np.flatnonzero(least)
    many = least[full]
    if len(full):
        first = np.cumsum(many) - many
        k = np.arange(many.sum()) - np.repeat(first, many)
        a, b = np.repeat(offsets[:-2][full], many) + k, np.repeat(offsets[1:-1][full], many) + k
        differs = (flat[a] != flat[b]).any(axis=1)
        out[full] = np.minimum(many, np.minimum.reduceat(np.where(differs, k, _FAR), first))
    return out


def _turns(seq: bytes) -> np.ndarray:
    return np.frombuffer(seq, np.uint64).reshape(-1, 2)


class Minima:
    """Sparse table of the minima of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values, np.int64)]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def right(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The farthest place at or after ``at`` with all values behind ``at`` up to it at least ``floor``."""
        out, end = at.copy(), len(self.rows[0]) - 1
        for j in reversed(range(len(self.rows))):
            step = 1 << j
            can = out + step <= end
            can[can] = self.rows[j][out[can] + 1] >= floor[can]
            out[can] += step
        return out

    def left(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The farthest place at or before ``at`` with all values behind it up to ``at`` at least ``floor``."""
        out = at.copy()
        for j in reversed(range(len(self.rows))):
            step = 1 << j
            can = out - step >= 0
            can[can] = self.rows[j][out[can] - step + 1] >= floor[can]
            out[can] -= step
        return out

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minimum from ``a`` to ``b``."""
        j = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(j):
            own = j == k
            out[own] = np.minimum(self.rows[k][a[own]], self.rows[k][b[own] - (1 << int(k)) + 1])
        return out


@dataclass
class Ranges:
    """The ranges that hold rows, in order: least LCP inside (none: far above), LCP and equality with the last row of the range before."""

    parts: list[int]
    low: np.ndarray
    link: np.ndarray
    same: np.ndarray

    def around(self, part: int) -> tuple[int, int, bool, bool, np.ndarray]:
        """LCP and equality to the left and to the right, and for each depth up to the LCP on the left the range where its node begins."""
        k = self.parts.index(part)
        left, more = int(self.link[k]), k + 1 < len(self.parts)
        depth = np.arange(left + 1)
        # A range is passed when neither its rows nor the step into it fall below the depth.
        start = Minima(np.minimum(self.link, self.low)).left(np.full(len(depth), k - 1), depth) if len(depth) else depth
        return left, int(self.link[k + 1]) if more else -1, bool(self.same[k]), more and bool(self.same[k + 1]), np.array(self.parts, np.int64)[start]


def _loaded(batches: Iterator[pa.RecordBatch]):
    """(part, ids, flat digests, offsets, bytes) of a whole range, or None."""
    got = [b for b in batches if len(b)]
    if not got:
        return None
    table = pa.Table.from_batches(got)
    raw = [x.as_buffer().to_pybytes() for x in table.column("seq")]
    offsets = np.cumsum([0, *(len(x) // DIGEST for x in raw)])
    width = np.concatenate([*(np.asarray(c.flatten()) for c in table.column("bytes").chunks), np.zeros(0, np.int64)])
    return table.column("part")[0].as_py(), table.column("conv_id").to_numpy(), _turns(b"".join(raw)), offsets, width


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, low, first, last) of a range: its least LCP and the sequences at its ends."""
    part, low, first, last = None, None, None, None
    for batch in batches:
        for seq in batch.column("seq"):
            seq = seq.as_buffer().to_pybytes()
            if part is None:
                part, first = batch.column("part")[0].as_py(), seq
            else:
                a, b = _turns(last), _turns(seq)
                n = min(len(a), len(b))
                differs = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
                lcp = int(differs[0]) if len(differs) else n
                low = lcp if low is None else min(low, lcp)
            last = seq
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "low": pa.array([low], pa.int64()), "first": [first], "last": [last]})


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lcp, same = [], []
        for x, y in zip(batch.column(1), batch.column(2), strict=True):
            a, b = _turns(x.as_py()), _turns(y.as_py())
            n = min(len(a), len(b))
            differs = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
            lcp.append(int(differs[0]) if len(differs) else n)
            same.append(len(a) == len(b) == lcp[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lcp, pa.int64()), pa.array(same, pa.bool_())], names=["part", "lcp", "same"])


#: part: the range; whole: the node ends in it and begins in it; start: the range where the node begins; parent, up: smallest
#: member of the parent if that is whole, and the range where the parent begins if it is not; ids: a piece of a long list.
_SCHEMA = (
    "part int, whole boolean, start int, depth bigint, conv_id bigint, n bigint, children bigint, leaves bigint, shared bigint, before bigint, "
    "parent bigint, up int, ends string, piece int, ids string"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("whole", pa.bool_()), ("start", pa.int32()), *[(n, pa.int64()) for n in ("depth", "conv_id", "n", "children", "leaves", "shared", "before", "parent")],
    ("up", pa.int32()), ("ends", pa.string()), ("piece", pa.int32()), ("ids", pa.string()),
])


def _joined_ids(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _nodes(ranges: Ranges):
    """Rows of ``_SCHEMA`` for one range: its whole nodes, its shares of others, and pieces of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(batches)
        if loaded is None:
            return
        part, ids, flat, offsets, width = loaded
        left, right, same_left, same_right, begun = ranges.around(part)
        n = len(ids)
        size = np.diff(offsets)
        lcp = np.concatenate([[left], _shared(flat, offsets)])
        after = np.append(lcp[1:], right)
        table, smallest = Minima(lcp), Minima(ids)
        total = np.concatenate([[0], np.cumsum(width)])
        upto = lambda row, k: total[offsets[row] + np.maximum(k, 0)] - total[offsets[row]]
        leaves = np.concatenate([[0], np.cumsum(after < size)])
        shared = np.concatenate([[0], np.cumsum(upto(np.arange(n), lcp))])
        opens = np.flatnonzero(size > lcp)
        ranks = np.sort(lcp[opens] * (n + 1) + opens)  # rows that open a child of the node at their LCP
        opened = lambda d, a, b: np.searchsorted(ranks, d * (n + 1) + b, "right") - np.searchsorted(ranks, d * (n + 1) + a, "left")

        # Candidates: prefixes that a row is the first to show, before them the nodes that come in from the left.
        row = np.concatenate([np.zeros(left + 1, np.int64), np.repeat(np.arange(n), size - lcp)])
        fresh = np.arange(len(row)) > left
        new = np.arange(len(row) - left - 1) - np.repeat(np.cumsum(size - lcp) - (size - lcp), size - lcp)
        depth = np.concatenate([np.arange(left + 1), lcp[row[left + 1 :]] + 1 + new])

        def extent(at, d):
            """(first row, last row, whether it goes on to the left, to the right) of the nodes of depth d around rows."""
            a, b = table.left(at, d), table.right(at, d)
            return a, b, (a == 0) & (d <= left), (b == n - 1) & (d <= right)

        for at in range(0, len(row), OUT_ROWS):
            r, d, new_ = row[at : at + OUT_ROWS], depth[at : at + OUT_ROWS], fresh[at : at + OUT_ROWS]
            a, b, before, beyond = extent(r, d)
            whole = ~before & ~beyond
            start = np.full(len(r), part)
            start[before] = begun[d[before]]
            pa_, pb, p_before, p_beyond = extent(r, d - 1)
            p_whole = ~p_before & ~p_beyond & (d > 0)
            up = np.full(len(r), part)
            up[p_before & (d > 0)] = begun[d[p_before & (d > 0)] - 1]
            # The first member of a node counts only where the node begins.
            skip = a + new_
            ends = [None] * len(r)
            last = np.full(len(r), -1)
            exact = np.flatnonzero(new_ & (size[r] == d))
            last[exact] = table.right(r[exact], d[exact])
            for k in np.flatnonzero(new_).tolist():
                if last[k] < 0:
                    ends[k] = _NONE
            for k in exact.tolist():
                # Members that end here come first, one after the other.
                stop = int(r[k]) + int(np.searchsorted(size[r[k] : last[k] + 1] > d[k], True))
                if not (stop == n and same_right):
                    ends[k] = hashlib.sha256(_joined_ids(ids[r[k] : stop]).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(r), part), pa.int32()), pa.array(whole), pa.array(start, pa.int32()), pa.array(d), pa.array(smallest.least(a, b)), pa.array(b - a + 1),
                    pa.array(opened(d, skip, b) + (new_ & (size[r] > d))), pa.array(leaves[b + 1] - leaves[a]), pa.array(shared[b + 1] - shared[skip]), pa.array(upto(r, d - 1)),
                    pa.array(smallest.least(pa_, pb), mask=~p_whole), pa.array(up, pa.int32(), mask=p_whole | (d == 0) | ~new_), pa.array(ends, pa.string()),
                    pa.nulls(len(r), pa.int32()), pa.nulls(len(r), pa.string()),
                ],
                schema=_ARROW,
            )

        # Lists of ids that fill this range to an end of it: pieces, under the node they end at.
        equal = lcp == size
        stretches = []
        if same_left:
            ending = np.flatnonzero(~(equal & (size == size[0])))
            ending = ending[ending > 0]
            stretches.append((0, int(ending[0]) if len(ending) else n, int(begun[size[0]])))
        if same_right and not (same_left and stretches[0][1] == n):
            first = int(table.left(np.array([n - 1]), np.array([size[-1]]))[0])
            stretches.append((first, n, part))
        for first, stop, start in stretches:
            cuts = range(first, stop, PIECE)
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "whole": False, "start": start, "depth": int(size[first]), "piece": k, "ids": _joined_ids(ids[c : min(c + PIECE, stop)])} for k, c in enumerate(cuts)], schema=_ARROW
            )

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, start, ends) of lists whose pieces come one after the other."""
    key, so_far = None, None
    done = []
    for batch in batches:
        for depth, start, ids in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if (depth, start) != key:
                if key is not None:
                    done.append((*key, so_far.hexdigest()))
                key, so_far = (depth, start), hashlib.sha256()
            else:
                so_far.update(b",")
            so_far.update(ids.encode())
    if key is not None:
        done.append((*key, so_far.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["depth", "start", "hashed"])


def _ranges(rows: DataFrame) -> Ranges:
    """What the driver knows of the ranges: three numbers each."""
    borders = cut_lineage(rows.select("part", "seq").mapInArrow(_borders, "part int, low bigint, first binary, last binary"))
    listed = sorted((r["part"], r["low"]) for r in borders.select("part", "low").collect())
    parts = [p for p, _ in listed]
    low = np.array([_FAR if x is None else x for _, x in listed], np.int64)
    link, same = np.full(len(parts), -1, np.int64), np.zeros(len(parts), bool)
    if len(parts) > 1:
        pairs = rows.sparkSession.createDataFrame(list(zip(parts[1:], parts[:-1], strict=True)), "part int, earlier int")
        met = pairs.join(borders.select("part", "first"), "part").join(borders.select(F.col("part").alias("earlier"), "last"), "earlier")
        found = {r["part"]: (r["lcp"], r["same"]) for r in met.select("part", "last", "first").mapInArrow(_linked, "part int, lcp bigint, same boolean").collect()}
        for k, p in enumerate(parts[1:], 1):
            link[k], same[k] = found[p]
    return Ranges(parts, low, link, same)


def nodes(conversations: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per distinct prefix of the rows (conv_id, turns) of :func:`sequences`.

    conv_id: smallest member; depth; parent_conv_id: that of the prefix without its last
    turn, null at the root; n_convs: members; n_children, n_leaves: nodes one turn longer,
    and nodes below or here that have none; saved_tokens: bytes of texts that members share
    with earlier ones, over the subtree; ends_sha256: digest of the ids of the members
    that end here, ascending, comma-joined.

    Ids are unique. A conversation without turns is a member of the root alone. No
    conversations give no nodes.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["bytes"]).alias("bytes"),
    )
    rows = cut_lineage(rows)
    many, turns = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("bytes")), F.lit(0))).first()
    wide = max(-(-(many + turns) // range_rows), 1)
    dealt = rows.repartitionByRange(wide, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    dealt = cut_lineage(dealt.select(F.spark_partition_id().alias("part"), "conv_id", "seq", "bytes"))
    found = cut_lineage(dealt.mapInArrow(_nodes(_ranges(dealt)), _SCHEMA))

    pieces = found.where("ids is not null").select("depth", "start", "part", "piece", "ids")
    lists = pieces.repartition("depth", "start").sortWithinPartitions("depth", "start", "part", "piece").select("depth", "start", "ids")
    lists = lists.mapInArrow(_hashed, "depth bigint, start int, hashed string")
    shares = found.where("ids is null and not whole")
    ours = shares.groupBy("depth", "start").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "shared")], F.max("before").alias("before"),
        F.max("up").alias("up"), F.max("ends").alias("ends"),
    )
    ours = cut_lineage(ours.join(lists, ["depth", "start"], "left").withColumn("ends", F.coalesce("ends", "hashed")).drop("hashed"))
    above = ours.select((F.col("depth") + 1).alias("depth"), F.col("start").alias("up"), F.col("conv_id").alias("parent"))
    long = ours.join(above, ["depth", "up"], "left")
    # A whole node whose parent goes on beyond its range meets that range's own share of the parent: no key is met by more than a range.
    near = shares.select("part", "depth", "start").join(ours.select("depth", "start", "conv_id"), ["depth", "start"])
    near = near.select("part", (F.col("depth") + 1).alias("depth"), F.col("start").alias("up"), F.col("conv_id").alias("far"))
    own = found.where("ids is null and whole").withColumn("up", F.coalesce("up", F.lit(-1)))
    own = own.join(near, ["part", "depth", "up"], "left").withColumn("parent", F.coalesce("parent", "far"))
    columns = ["conv_id", "depth", "parent", "n", "children", "leaves", "shared", "before", "ends"]
    both = own.select(columns).unionByName(long.select(columns))
    return both.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def rebuilt_nodes(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return nodes(rebuilt(cut_lineage(sequences(turns, **columns))))
