"""Exact top-k by block-at-a-time pruning.

Vectors become whole numbers and are laid out in an order that keeps like ones
together; ranges of that order are blocks, each with a forward index (its vectors)
and, for every component, the largest and smallest value in it. For a query the
components' extremes bound every score of a block. A query takes the blocks in falling
order of their bounds, scores whole blocks, and stops where the next bound falls below
its k-th score; where it only equals it, the block is left out if all its ids are
larger than that of the k-th.

Blocks are spread as shards of neighbouring blocks. Queries are the given set; they go
to every shard in blocks of rows and start there from a first threshold: the k-th
score among a bounded sample of vectors, which every query's final k-th reaches at
least. Each shard returns k rows a query, and the best k of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metreur.llm.common import cut_lineage

K = 20
SCALE = 64
#: Vectors of one block, and of one shard at most.
BLOCK = 128
SHARD = 16_384
#: Queries that a task scores at once.
QUERIES = 512
#: Vectors of the sample that gives each query its first threshold.
SAMPLE = 512
#: Below every score; its negative is a whole number of 64 bits too.
LOW = -(1 << 63) + 1


def whole(embedding: str, scale: int = SCALE):
    """floor(scale * x) of each component as double; null where a component is null or not finite, or the vector is."""
    x = F.col(embedding).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros."""
    ends = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(ends)), ends)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


class Shard:
    """Blocks of vectors with their component extremes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        self.ids, self.starts = ids, np.arange(0, max(len(ids), 1), block)
        self.block = block
        size = int(np.abs(vectors).max(initial=0))
        # Doubles hold the products exactly below 2^53; beyond, whole numbers are slower.
        self.kind = np.float64 if size * size * max(vectors.shape[1], 1) < 1 << 53 else np.int64
        self.vectors = vectors.astype(self.kind)
        self.most = np.maximum.reduceat(self.vectors, self.starts) if len(ids) else self.vectors
        self.least = np.minimum.reduceat(self.vectors, self.starts) if len(ids) else self.vectors
        self.first_id = np.minimum.reduceat(ids, self.starts) if len(ids) else ids

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of at most k rows a query that reach its floor; equal scores by smaller id."""
        size = int(np.abs(queries).max(initial=0))
        kind = np.float64 if self.kind is np.float64 and size * int(np.abs(self.vectors).max(initial=0)) * max(queries.shape[1], 1) < 1 << 53 else np.int64
        own = self.vectors if kind is self.kind else self.vectors.astype(kind)
        q = queries.astype(kind)
        bound = np.maximum(q, 0) @ self.most.T.astype(kind) + np.minimum(q, 0) @ self.least.T.astype(kind)
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(q)
        low = LOW
        score, ids = np.full((n, k), low, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        live = np.arange(n)
        for turn in range(len(self.starts)):
            block = order[live, turn]
            b = bound[live, block].astype(np.int64)
            kth = np.maximum(score[live, -1], floor[live])
            # Blocks come by falling bound, so a query is done where one falls below its k-th score.
            on = b >= kth
            live, block, b = live[on], block[on], b[on]
            if not len(live):
                break
            tie_only = (b == score[live, -1]) & (self.first_id[block] > ids[live, -1])
            rows, blocks = live[~tie_only], block[~tie_only]
            by = np.argsort(blocks, kind="stable")
            rows, blocks = rows[by], blocks[by]
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(blocks)) + 1) if len(rows) else []:
                r, at = rows[part], self.starts[blocks[part[0]]]
                cand = self.ids[at : at + self.block]
                got = (q[r] @ own[at : at + self.block].T).astype(np.int64)
                got[query_ids[r][:, None] == cand[None, :]] = low
                all_score = np.concatenate([score[r], got], axis=1)
                all_id = np.concatenate([ids[r], np.broadcast_to(cand, got.shape)], axis=1)
                best = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                score[r], ids[r] = np.take_along_axis(all_score, best, 1), np.take_along_axis(all_id, best, 1)
        good = score > low
        return np.nonzero(good)[0], ids[good], score[good]


def _searcher(k: int, block: int, sample: np.ndarray, sample_ids: np.ndarray, width: int):
    """Rows come by shard, its vectors before the queries; a task holds one shard and one block of queries."""

    def floors(ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        low = LOW
        if not len(sample):
            return np.full(len(ids), low)
        got = queries @ sample.T
        got[ids[:, None] == sample_ids[None, :]] = low
        return np.partition(got, -k, axis=1)[:, -k] if got.shape[1] >= k else np.full(len(ids), low)

    def answers(shard: Shard, ids: list[np.ndarray], vectors: list[np.ndarray]):
        one, many = np.concatenate(ids), np.concatenate(vectors)
        row, vec, score = shard.search(one, many, floors(one, many), k)
        return pa.RecordBatch.from_arrays([pa.array(one[row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, base, asked = None, None, ([], []), ([], [])
        for batch in batches:
            number = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            vectors = _matrix(batch.column(3), width)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1, [len(number)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if number[a] != current:
                    if asked[0]:
                        yield answers(shard, *asked)
                    current, shard, base, asked = number[a], None, ([], []), ([], [])
                if kind[a] == 0:
                    base[0].append(ids[a:b])
                    base[1].append(vectors[a:b])
                    continue
                if shard is None:
                    if not base[0]:
                        continue
                    shard, base = Shard(np.concatenate(base[0]), np.concatenate(base[1]), block), ([], [])
                for at in range(a, b, QUERIES):
                    asked[0].append(ids[at : min(at + QUERIES, b)])
                    asked[1].append(vectors[at : min(at + QUERIES, b)])
                    if sum(map(len, asked[0])) >= QUERIES:
                        yield answers(shard, *asked)
                        asked = ([], [])
        if asked[0]:
            yield answers(shard, *asked)

    return run


def search(
    vectors: DataFrame, queries: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE,
    block: int = BLOCK, shard: int = SHARD, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products of whole components.

    Queries and vectors without an id, and those with a null or not finite component,
    take no part. Of rows that share an id the greatest vector counts. Shorter vectors
    are filled up with zeros. A query's own id is no candidate. Equal scores go by
    smaller id; with fewer candidates than ``k`` all are returned. Scores must fit
    64 bits.
    """
    spark = vectors.sparkSession

    def taken(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id).cast("bigint").alias("vec_id"), whole(embedding, scale).alias("v")).where("vec_id is not null and v is not null")
        return rows.groupBy("vec_id").agg(F.max("v").alias("v"))

    # Like vectors lie together: by the signs of their first components, then by id.
    near = F.aggregate(F.slice("v", 1, 16), F.lit(0), lambda s, x: s * 2 + F.when(x >= 0, 1).otherwise(0))
    base = cut_lineage(taken(vectors).withColumn("place", near))
    total, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shards = max(-(-total // shard), min(spark.sparkContext.defaultParallelism, -(-total // block)))
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").collect()  # a bounded sample: thresholds only
    sample_ids = np.array([r[0] for r in some], np.int64)
    first = np.zeros((len(some), width), np.int64)
    for row, r in zip(first, some, strict=True):
        row[: len(r[1])] = r[1]
    laid = base.repartitionByRange(shards, "place", "vec_id").sortWithinPartitions("place", "vec_id").select(F.spark_partition_id().alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", "place")
    laid = cut_lineage(laid)
    last = laid.agg(F.max("shard")).first()[0]  # a session may deal out to more partitions than asked for
    asked = taken(queries).select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", F.lit(0).alias("place"))
    met = laid.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "place", "vec_id")
    found = met.select("shard", "kind", "vec_id", "v").mapInArrow(_searcher(k, block, first, sample_ids, width), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
