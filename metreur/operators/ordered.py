"""Ordered operators that never hold a whole document in one task.

A window over a document puts all its rows in one task. Here a document is cut
into stretches of ``CHUNK`` positions: windows run inside a stretch, each
stretch is summed up in one row before any shuffle, and a window over those few
rows carries the state from stretch to stretch. Results are those of the plain
window, whatever share of the corpus one document holds.

Positions are unique within the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metreur.session import store_step

CHUNK = 8192
_C = "__stretch"


def stretched(df: DataFrame, keys: list[str], pos: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Append ``name``, the stretch of each row among positions with gaps: what :func:`running` and :func:`following` may be given."""
    return _cut(df, keys, pos, chunk, True).withColumnRenamed(_C, name)


def _cut(df: DataFrame, keys, pos: str, chunk: int, sparse: bool, stretch: str | None = None) -> DataFrame:
    if stretch is not None:
        return df.withColumn(_C, F.col(stretch))
    if not sparse:
        return df.withColumn(_C, F.expr(f"cast(`{pos}` as bigint) div {int(chunk)}"))
    # Positions with gaps: only keys of more than ``chunk`` rows are cut, into
    # stretches as wide as their spread asks for. The others are one stretch, -1.
    place = F.col(pos).cast("bigint")
    wide = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__rows"), F.min(place).alias("__low"), F.max(place).alias("__high"))
        .where(F.col("__rows") > chunk)
        .select(
            *keys,
            "__low",
            F.greatest(F.lit(1), F.ceil((F.col("__high") - F.col("__low") + 1) * F.lit(float(chunk)) / F.col("__rows")))
            .cast("bigint")
            .alias("__width"),
        )
    )
    stretch = F.expr(f"(cast(`{pos}` as bigint) - __low) div __width")
    # at most a row for each ``chunk`` rows: sent to every task, so that nothing is shuffled by the keys alone
    return df.join(F.broadcast(wide), list(keys), "left").withColumn(_C, F.coalesce(stretch, F.lit(-1))).drop("__low", "__width")


def _several(staged: DataFrame, sparse: bool, stretch: str | None) -> DataFrame:
    """Rows of the keys that have something to hand on from stretch to stretch, as far as that is known."""
    return staged.where(F.col(_C) >= 0) if sparse or stretch is not None else staged


def _rejoin(rows: DataFrame, carry: DataFrame, keys, names) -> DataFrame:
    """Bring the carried state to the rows of each stretch that has one."""
    held = F.lit(False)
    for name in names:
        held = held | F.col(name).isNotNull()
    return rows.join(carry.where(held), [*keys, _C], "left")


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    strict: bool = False,
    chunk: int = CHUNK,
    sparse: bool = False,
    stretch: str | None = None,
) -> DataFrame:
    """Append running sums and last non-null values, ordered by ``pos``.

    With ``strict`` the current row does not count. ``stretch`` names a column that
    holds what :func:`stretched` gave for the same rows, or for those of which these are some.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    out = df.columns
    staged = _cut(df, keys, pos, chunk, sparse, stretch).select(
        "*",
        *[c.alias(f"__in_{n}") for n, c in {**sums, **lasts}.items()],
    )
    end = -1 if strict else 0
    inside = Window.partitionBy(*keys, _C).orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    value = lambda n: F.col(f"__in_{n}")

    rows = staged.select(
        *out,
        _C,
        *[F.sum(value(n)).over(inside).alias(f"__own_{n}") for n in sums],
        *[F.last(value(n), ignorenulls=True).over(inside).alias(f"__own_{n}") for n in lasts],
    )
    totals = _several(staged, sparse, stretch).groupBy(*keys, _C).agg(
        *[F.sum(value(n)).alias(f"__tot_{n}") for n in sums],
        *[F.max_by(value(n), F.when(value(n).isNotNull(), F.col(pos))).alias(f"__tot_{n}") for n in lasts],
    )
    carry = totals.select(
        *keys,
        _C,
        *[F.sum(f"__tot_{n}").over(before).alias(f"__carry_{n}") for n in sums],
        *[F.last(f"__tot_{n}", ignorenulls=True).over(before).alias(f"__carry_{n}") for n in lasts],
    )
    joined = _rejoin(rows, carry, keys, [f"__carry_{n}" for n in {**sums, **lasts}])
    zero = F.lit(0)
    return joined.select(
        *out,
        *[
            (F.coalesce(F.col(f"__own_{n}"), zero) + F.coalesce(F.col(f"__carry_{n}"), zero)).alias(n)
            for n in sums
        ],
        *[F.coalesce(F.col(f"__own_{n}"), F.col(f"__carry_{n}")).alias(n) for n in lasts],
    )


def following(
    df: DataFrame, keys: list[str], pos: str, fields: list[str], name: str = "following", chunk: int = CHUNK, sparse: bool = False,
    stretch: str | None = None,
) -> DataFrame:
    """Append ``name``, a struct of ``fields`` of the next row, null at the end. ``stretch`` as in :func:`running`."""
    out = df.columns
    item = F.struct(*[F.col(f) for f in fields])
    staged = _cut(df, keys, pos, chunk, sparse, stretch)
    inside = Window.partitionBy(*keys, _C).orderBy(pos)
    rows = staged.select(*out, _C, F.lead(item).over(inside).alias("__own"))
    heads = _several(staged, sparse, stretch).groupBy(*keys, _C).agg(F.min_by(item, pos).alias("__head"))
    carry = heads.select(*keys, _C, F.lead("__head").over(Window.partitionBy(*keys).orderBy(_C)).alias("__carry"))
    joined = _rejoin(rows, carry, keys, ["__carry"])
    return joined.select(*out, F.coalesce("__own", "__carry").alias(name))


def numbered(
    df: DataFrame, keys: list[str], pos: str, name: str, chunk: int = CHUNK, sparse: bool = False
) -> DataFrame:
    """Append ``name``, the rank of each row from 1 in the order of ``pos``."""
    return running(df, keys, pos, sums={name: F.lit(1).cast("bigint")}, chunk=chunk, sparse=sparse)


def ranked(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Append ``name``, the place of each row from 1 among those of its keys, in a total order.

    All rows are sorted by ranges, stored, and a row's place is that in its range behind
    the rows of the same keys in earlier ranges, so that no key is one task. Null keys are
    a key. Without keys the whole table is numbered.
    """
    out = df.columns
    # Ids grow along the order, by one within a range. Stored, as ranges are drawn from a sample.
    by_range = store_step(df.orderBy(*keys, *order).select(*out, F.monotonically_increasing_id().alias("__at"), F.spark_partition_id().alias("__range")))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = by_range.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__many"))
    counts = counts.select(
        *[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__range").alias("__of"), "__first", F.coalesce(F.sum("__many").over(earlier), F.lit(0)).alias("__before")
    )
    same = F.col("__range") == F.col("__of")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    # a row for each key and range: however small their files are, they are not sent to every task, but without keys
    counts = counts.hint("merge") if keys else F.broadcast(counts)
    return by_range.join(counts, same).select(*out, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name))


def counters(df: DataFrame, keys: list[str], pos: str, level: str, name: str, depth: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Append ``name``, the multilevel counters after each row.

    A row of level k adds one to counter k and sets deeper counters to zero.
    Counter k is the number of level-k rows since the last shallower row, which
    a stretch can count on its own; what it counted and whether it reset the
    counter are all the next stretches need.
    """
    out = df.columns
    ks = range(1, depth + 1)
    lvl = F.col(level)
    inside = Window.partitionBy(*keys, _C).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    seen = _cut(df, keys, pos, chunk, False).select(
        *out,
        _C,
        *[F.sum((lvl == k).cast("bigint")).over(inside).alias(f"__n{k}") for k in ks],
        *[F.coalesce(F.bool_or(lvl < k).over(inside), F.lit(False)).alias(f"__r{k}") for k in ks],
    )
    own = seen.select(
        *out,
        _C,
        *[f"__r{k}" for k in ks],
        *[
            (F.col(f"__n{k}") - F.coalesce(F.last(F.when(lvl < k, F.col(f"__n{k}")), ignorenulls=True).over(inside), F.lit(0))).alias(f"__c{k}")
            for k in ks
        ],
    )
    ends = own.groupBy(*keys, _C).agg(
        *[F.max_by(f"__c{k}", pos).alias(f"__c{k}") for k in ks], *[F.bool_or(f"__r{k}").alias(f"__r{k}") for k in ks]
    )
    along = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    summed = ends.select(
        *keys, _C, *[f"__c{k}" for k in ks], *[f"__r{k}" for k in ks],
        *[F.sum(f"__c{k}").over(along).alias(f"__s{k}") for k in ks],
    )
    carry = summed.select(
        *keys,
        _C,
        *[
            (
                F.sum(f"__c{k}").over(before)
                - F.coalesce(
                    F.last(F.when(F.col(f"__r{k}"), F.col(f"__s{k}") - F.col(f"__c{k}")), ignorenulls=True).over(before),
                    F.lit(0),
                )
            ).alias(f"__k{k}")
            for k in ks
        ],
    )
    joined = _rejoin(own, carry, keys, [f"__k{k}" for k in ks])
    return joined.select(
        *out,
        F.array(
            *[
                F.col(f"__c{k}") + F.when(F.col(f"__r{k}"), F.lit(0)).otherwise(F.coalesce(f"__k{k}", F.lit(0)))
                for k in ks
            ]
        ).alias(name),
    )
