"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, each a 63 bit hash; its sketch
is the ``K`` smallest of them. Documents with equal sets are one class from the start.

Candidates come from inverted lists of retained values. If two sets agree to 0.75,
their sketches share at least ``SHARED`` of 64 values but for odds of about 1e-8, and
sets smaller than a sketch share three quarters for certain. So a class enters only
the lists of its rarest values, as many as it takes that such a pair must meet in
one; a value that many documents hold is among the last and rarely a list at all.

Lists are worked off without all pairs:

1. Classes whose text is too much their own leave, told by a wider sketch of those
   in lists. The most typical member of each list (whose values are the most frequent)
   is compared with the others; what agrees is linked.
2. In lists that still hold several components, shingles that only one member of
   any such list has are counted. They bound every overlap of that member exactly,
   and members that can reach 0.75 with nobody leave.
3. The most typical member outside the largest component is compared in the same way.
4. What is left outside the largest component of its list has been counted against a
   typical member, its reference. It can agree with a text of some size only by shingles
   that the reference lacks, or else the text is smaller than a bound. The first are
   found by those few shingles, the second in the lists, by size.

Before a comparison of the last kind counts on the full sets, the Jaccard similarity
is estimated from the sketch of the union, and pairs that are clearly apart go.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metreur.llm.common import ROW, Shelf, cut_lineage, listed, packed

K = 64
SHARED = 28
SHINGLE = 5
#: A second, wider sketch for the classes in lists: 192 of 256 shared are expected, 150 are six standard deviations less.
WIDE = 256
WIDE_SHARED = 150
#: Rows of ids that may be sent to every task (24 bytes each).
BROADCAST_ROWS = 2_000_000
#: Documents, or pairs of them with their sets, in one Arrow batch.
BATCH = 200
#: Partners of a member that are compared in the first round of the last step, and how much more in each after it.
FIRST_PARTNERS, MORE_PARTNERS = 4, 8
#: Edges that one task takes while components are found.
EDGES_A_TASK = 50_000
#: Sizes of one bucket differ by less than this factor.
_RATIO = 1.02


def _lower_table() -> bytes:
    table = bytearray(range(256))
    for b in range(65, 91):
        table[b] = b + 32
    return bytes(table)


_LOWER = _lower_table()
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63 bit hashes of the text's word shingles; one of all words if there are fewer; none without words."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        total = total * _P + one[k : len(one) - span + 1 + k]
    return np.unique(_mixed(total).astype(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        firsts = [s[:K] for s in sets]
        sketches = listed(np.cumsum([0, *map(len, firsts)]), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
        digest = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), digest, sketches], names=[ROW, "n", "digest", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "whole"])


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Share of the union's sketch that both hold, and the size of that sketch."""
    union = np.union1d(a[:K], b[:K])[:K]
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    return both.sum() / max(len(union), 1), len(union)


def apart(a: np.ndarray, b: np.ndarray) -> bool:
    """The union's sketch shows less than 0.75, by six standard deviations."""
    share, size = estimate(a, b)
    return share < 0.75 - 6 * (0.75 * 0.25 / max(size, 1)) ** 0.5


def _set(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int64)


def _confirm(estimated: bool):
    """(a, b, both, good): shingles that both sets have, and whether 100 * intersection >= 75 * union.

    ``estimated``: pairs that are apart by their sketches are left out uncounted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, both, good = [], [], []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                left, right = _set(x), _set(y)
                if estimated and apart(left, right):
                    continue
                n = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(k)
                both.append(n)
                good.append(100 * n >= 75 * (len(left) + len(right) - n))
            rows = batch.select([0, 1]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(both, pa.int64()), pa.array(good, pa.bool_())], names=["a", "b", "both", "good"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shingle) of sets, less those of the reference if there is one."""
    for batch in batches:
        sets = [_set(x) for x in batch.column(1)]
        if batch.num_columns > 2:
            sets = [np.setdiff1d(x, _set(y), assume_unique=True) for x, y in zip(sets, batch.column(2), strict=True)]
        reps = batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
        yield pa.RecordBatch.from_arrays([reps, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["rep", "shingle"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shingle) of the ``WIDE`` smallest of each set."""
    for batch in batches:
        sets = [_set(x)[:WIDE] for x in batch.column(1)]
        reps = batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
        yield pa.RecordBatch.from_arrays([reps, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["rep", "shingle"])


_SPREAD = "rep bigint, shingle bigint"


@contextmanager
def _batches(spark, rows: int):
    """Smaller Arrow batches while rows carry whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the graph of stored edges (a, b): comp is the smallest node reachable.

    Alternating large and small stars until the edges stay as they are; every
    round is written to the checkpoint folder.
    """

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        # As many tasks as the edges ask for: few edges in many partitions are mostly small files.
        wide = -(-seen[0] // EDGES_A_TASK)
        edges = edges.coalesce(wide)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").coalesce(wide).distinct().coalesce(wide)
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        edges = cut_lineage(small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").coalesce(wide).distinct().coalesce(wide))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _needed(s: Column) -> Column:
    """Values that the sketch of a set of ``n`` shares at least with any set that agrees to 0.75."""
    return F.when(s < 48, F.ceil(s * 3 / 4)).otherwise(SHARED)


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / np.log(_RATIO)).cast("int")


def _fits(a: str, b: str) -> Column:
    """Sizes ``n`` and numbers of shareable shingles ``m`` of two sets allow 0.75: 7 * overlap >= 3 * (sum of sizes)."""
    return F.least(F.col(f"{a}.m"), F.col(f"{b}.m")) * 7 >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * 3


class _Linker:
    def __init__(self, docs: DataFrame, id: str, text: str):
        self.docs = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
        self.spark = docs.sparkSession
        self.shelf = Shelf(self.spark, "neardup")
        self.counted: DataFrame | None = None

    def lists(self, classes: DataFrame) -> DataFrame:
        """(value, rep, n, typical): the entries of the lists that have two members or more."""
        held = classes.select("rep", "n", F.explode("sketch").alias("value"))
        often = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
        shared = held.join(often, "value")
        mine = Window.partitionBy("rep", "n")
        s = F.least(F.col("n"), F.lit(K))
        ranked = shared.select(
            "*", F.row_number().over(mine.orderBy("df", "value")).alias("at"), F.count("*").over(mine).alias("some"),
            (F.sum("df").over(mine) / s).alias("typical"),
        )
        mine_first = ranked.where(F.col("at") <= s - _needed(s) + 1 - (s - F.col("some"))).select("value", "rep", "n", "typical")
        entries = cut_lineage(mine_first)
        many = entries.groupBy("value").agg(F.count("*").alias("members")).where("members > 1").select("value")
        return cut_lineage(entries.join(many, "value"))

    def fetch(self, entries: DataFrame, classes: DataFrame) -> None:
        """Whole sets of all classes in the lists, each by the id and text of one row."""
        ids = cut_lineage(entries.select("rep").distinct().join(classes.select("rep", "doc", "mark"), "rep"))
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        # Checkpointed, not kept as Parquet: a writer of row groups would hold whole sets by the hundred megabytes.
        self.sets = cut_lineage(self.docs.join(ids, ["doc", "mark"]).select("rep", "text").mapInArrow(_sets, "rep bigint, whole binary"))

    def compare(self, pairs: DataFrame, estimated: bool = False) -> None:
        """Count pairs (a, b); those that agree become edges."""
        one = self.sets.select(F.col("rep").alias("a"), F.col("whole").alias("left"))
        two = self.sets.select(F.col("rep").alias("b"), F.col("whole").alias("right"))
        met = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "left", "right")
        with _batches(self.spark, BATCH):
            got = cut_lineage(met.mapInArrow(_confirm(estimated), "a bigint, b bigint, both bigint, good boolean"))
        self.counted = got if self.counted is None else self.counted.unionByName(got)
        self.parts = components(self.counted.where("good"))

    def open(self, entries: DataFrame) -> DataFrame:
        """Entries with their component, of lists that hold more than one; ``outside``: not in the list's largest."""
        now = entries.drop("comp", "outside").join(self.parts.withColumnRenamed("node", "rep"), "rep", "left")
        now = now.withColumn("comp", F.coalesce("comp", "rep"))
        sizes = now.groupBy("value", "comp").agg(F.count("*").alias("many"))
        top = sizes.groupBy("value").agg(F.count("*").alias("comps"), F.max(F.struct("many", "comp")).alias("top")).where("comps > 1")
        return cut_lineage(now.join(top.select("value", F.col("top.comp").alias("first")), "value").withColumn("outside", F.col("comp") != F.col("first")).drop("first"))

    def likely(self, entries: DataFrame) -> DataFrame:
        """Entries without the classes whose text is too much their own, of lists that keep two members or more.

        Of the ``WIDE`` smallest shingles of each class, those that no other class in
        any list has are counted. A set no larger than that is whole: more than a quarter
        of its own rules out 0.75 with sets that are whole too. Of a larger partner (of at
        most 4 / 3 of its size) what lies beyond the ``WIDE`` smallest counts as its own as
        well, in all no more than 4 / 3 of the size less ``WIDE``. A larger set shares at
        least ``WIDE_SHARED`` of them with a set that agrees, but for odds of about 1e-9.
        """
        firsts = lambda: self.sets.mapInArrow(_firsts, _SPREAD)
        with _batches(self.spark, BATCH):
            alone = firsts().groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("rep")).where("df = 1")
            alone = cut_lineage(alone.groupBy("rep").agg(F.count("*").alias("own")))
        own = F.coalesce("own", F.lit(0))
        whole = (own * 4 <= F.col("n")) | (own * 3 <= F.col("n") * 4 - 3 * WIDE)
        good = F.when(F.col("n") <= WIDE, whole).otherwise(own <= WIDE - WIDE_SHARED)
        kept = cut_lineage(entries.join(alone, "rep", "left").withColumn("own", own).where(good))
        many = kept.groupBy("value").agg(F.count("*").alias("members")).where("members > 1").select("value")
        return cut_lineage(kept.join(many, "value"))

    @staticmethod
    def stars(entries: DataFrame, centre: Column) -> DataFrame:
        """Each list's most typical member among ``centre`` with all members whose size allows 0.75.

        Edits outside the sketch leave it as typical as the text they were made in. Of such
        members the one with the least text of its own comes first, then the longest: as a
        reference, a text lacks little that many others share.
        """
        hub = entries.where(centre).groupBy("value").agg(F.max(F.struct("typical", (-F.col("own")).alias("own"), "n", (-F.col("rep")).alias("rep"))).alias("hub"))
        met = entries.join(hub.select("value", (-F.col("hub.rep")).alias("a"), F.col("hub.n").alias("size")), "value")
        return met.where("a <> rep and 4 * least(n, size) >= 3 * greatest(n, size)").select("a", F.col("rep").alias("b"))

    def bounded(self, entries: DataFrame) -> DataFrame:
        """Entries with ``m``, their shingles that another member of an open list has; without those that reach 0.75 with nobody."""
        ids = entries.select("rep").distinct()
        with _batches(self.spark, BATCH):
            whole = self.shelf.store(self.sets.join(ids, "rep", "left_semi").mapInArrow(_spread, _SPREAD), "whole")
        often = self.shelf.store(whole.groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("rep")), "often")
        alone = cut_lineage(often.where("df = 1").groupBy("rep").agg(F.count("*").alias("u")))
        # From here on only shingles count that several members have.
        self.often = often.where("df > 1").select("shingle", "df")
        self.spread = self.shelf.store(whole.join(self.often, "shingle"), "spread")
        self.shelf.clear("whole")
        found = entries.join(alone, "rep", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
        return cut_lineage(found.where("4 * m >= 3 * n"))

    def rest(self, entries: DataFrame) -> DataFrame:
        """Pairs of an outside member with any member of another component that the bounds allow."""
        both = self.counted.select("a", "b", "both").unionByName(self.counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "both"))
        seen = both.groupBy(F.col("a").alias("rep")).agg(F.max(F.struct("both", "b")).alias("ref"))
        asks = entries.where("outside and m * 7 / 3 - n >= n * 3 / 4").join(seen, "rep", "left")
        # Above this size a text must share what the reference lacks: 7 * both < 3 * (n + size).
        asks = cut_lineage(asks.withColumn("limit", F.floor((F.coalesce(F.col("ref.both"), F.col("m")) * 7 - F.col("n") * 3) / 3)).select("*", F.col("ref.both").alias("both"), F.col("ref.b").alias("h")).drop("ref"))

        low, high = _bucket(F.col("n") * 3 / 4) - 1, _bucket(F.greatest(F.lit(1), F.least(F.col("n") * 4 / 3, F.col("m") * 7 / 3 - F.col("n"), F.col("limit"))))
        x = asks.where("limit >= n * 3 / 4").select("*", F.explode(F.sequence(low, F.greatest(low, high + 1))).alias("bucket")).alias("x")
        y = entries.withColumn("bucket", _bucket(F.col("n"))).alias("y")
        on = (F.col("x.value") == F.col("y.value")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & _fits("x", "y") & (F.col("y.n") <= F.col("x.limit"))
        small = x.join(y, on).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

        who = asks.where("h is not null").select("rep", "n", "m", "comp", "h", "both", "limit").distinct()
        mine = who.select("rep", "h").join(self.sets, "rep").join(self.sets.select(F.col("rep").alias("h"), F.col("whole").alias("other")), "h").select("rep", "whole", "other")
        with _batches(self.spark, BATCH):
            extra = cut_lineage(mine.mapInArrow(_spread, _SPREAD))
        members = entries.select("rep", "n", "m", "comp").distinct()
        # A text that agrees shares at least ``least`` of these, so one of the rarest all but ``least`` - 1.
        least = F.ceil((F.col("n") + F.greatest(F.col("limit") + 1, F.ceil(F.col("n") * 3 / 4))) * 3 / 7) - F.col("both")
        mine = Window.partitionBy("rep")
        ranked = extra.join(self.often, "shingle").join(who, "rep").select("rep", "shingle", F.row_number().over(mine.orderBy("df", "shingle")).alias("at"), F.count("*").over(mine).alias("some"))
        ranked = self.shelf.store(ranked, "ranked")
        who = who.withColumn("least", least)
        # First against components: one row a shingle, however many members have it.
        held = self.shelf.store(self.spread.join(members, "rep"), "held")
        together = self.shelf.store(held.groupBy("shingle", "comp").agg(F.min("n").alias("small"), F.max("n").alias("large"), F.max("m").alias("m")), "together")
        first = ranked.join(who, "rep").where(F.col("at") <= F.col("some") + 1 - F.col("least"))
        x, y = first.alias("x"), together.alias("y")
        reach = F.least(F.col("x.m"), F.col("y.m")) * 7 >= (F.col("x.n") + F.greatest(F.col("x.limit") + 1, F.col("y.small"))) * 3
        met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("y.large") > F.col("x.limit")) & reach)
        met = self.shelf.store(met.select("x.rep", F.col("y.comp").alias("other")).distinct(), "met")
        # As a whole a component shares as much as any of its members, or more.
        shared = ranked.join(met, "rep").join(together.select("shingle", F.col("comp").alias("other")), ["shingle", "other"]).groupBy("rep", "other").agg(F.count("*").alias("shared"))
        likely = self.shelf.store(shared.join(who.select("rep", "least"), "rep").where("shared >= least").select("rep", "other"), "likely")
        x, y = first.join(likely, "rep").alias("x"), held.alias("y")
        on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.other") == F.col("y.comp")) & _fits("x", "y") & (F.col("y.n") > F.col("x.limit"))
        large = x.join(y, on).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        return small.unionByName(large).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def run(self, classes: DataFrame) -> DataFrame:
        entries = self.lists(classes)
        self.fetch(entries, classes)
        entries = self.likely(entries)
        self.compare(self.stars(entries, F.lit(True)))
        left = self.open(entries)
        if not left.isEmpty():
            left = self.open(self.bounded(left))
        if not left.isEmpty():
            self.compare(self.stars(left, F.col("outside")))
            left = self.open(left)
        if not left.isEmpty():
            self.rounds(self.rest(left))
        self.shelf.clear()
        return self.parts

    def rounds(self, pairs: DataFrame) -> None:
        """Compare all pairs whose ends are not linked meanwhile, those with the most in common first.

        Members of one group mostly hang together by their closest pairs; once these are
        linked, the rest of their pairs, which grow with the square of the group, need no
        comparison. What is still apart is compared to the last pair.
        """
        left = self.shelf.store(pairs.groupBy("a", "b").agg(F.count("*").alias("many")), "pairs-0")
        partners, k = FIRST_PARTNERS, 0
        while True:
            part = lambda end: self.parts.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
            far = left.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
            rank = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("many"), "a", "b"))
            k += 1
            left = self.shelf.store(far.select("a", "b", "many", rank("a").alias("at_a"), rank("b").alias("at_b")), f"pairs-{k}")
            now = (F.col("at_a") <= partners) | (F.col("at_b") <= partners)
            if left.isEmpty():
                return
            self.compare(left.where(now), estimated=True)
            self.shelf.clear(f"pairs-{k - 1}")
            left, partners = left.where(~now).drop("at_a", "at_b"), partners * MORE_PARTNERS


def grouped(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document without words is linked with nothing and kept. A row without an id
    takes no part: it is kept and has no component. Rows that repeat an id share
    their text's component, and all of them are kept if it is the smallest.
    """
    return _marked(docs, id, text).drop("mark")


def _marked(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``grouped`` with ``mark``, a hash of the text that tells apart the texts of one id."""
    rows = packed(docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")), ["id", "mark"], text=F.col("text"))
    base = cut_lineage(rows.mapInArrow(_sketch, f"`{ROW}` struct<id:bigint,mark:bigint>, n bigint, digest string, sketch array<bigint>").select(F.col(f"{ROW}.id").alias("doc_id"), F.col(f"{ROW}.mark").alias("mark"), "n", "digest", "sketch"))
    some = base.where("digest is not null and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # Several classes may have the same smallest id, so they are numbered; stored, the numbers stay.
    classes = cut_lineage(classes.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("one.doc_id").alias("doc"), F.col("one.mark").alias("mark"), "n", "sketch"))
    parts = _Linker(docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")), "id", "text").run(classes)
    found = classes.select("digest", "rep", "doc").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    named = found.groupBy("comp").agg(F.min("doc").alias("component"), F.count("*").alias("many")).where("many > 1").drop("many")
    least = found.join(named, "comp", "left").select("digest", F.coalesce("component", "doc").alias("component"))
    done = base.drop("sketch").join(least, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return done.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of their group, with their columns. Texts of one id stay or go each for itself."""
    gone = _marked(docs, id, text).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    return docs.join(gone, (F.col(f"`{id}`") == F.col("__gone")) & (F.xxhash64(text) == F.col("__mark")), "left_anti")
