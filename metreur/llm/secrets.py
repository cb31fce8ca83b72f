"""Secrets, and weak credential parts that count only when they complete each other.

Base kinds (assignments, access keys, long hexadecimal strings) are always
reported. Beside them each text yields weak parts: identifiers, secret-looking
strings and endpoints, none of which says much alone. Parts are joined as
intervals within a scope (the same document, at most ``SCOPE`` characters between
them); a weak part becomes a span when an identifier, a secret and an endpoint of
one scope stand together. Base access keys count as identifiers, base assignments and
hexadecimal strings as secrets.

The join meets parts by (document, stretch of ``SCOPE`` characters), so one long
document is many keys, and each part asks its own and the two neighbouring
stretches. It keeps only whether a complement exists, by the nearest one on each
side, so a stretch full of parts makes one row per part and not one per pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import ROW, cut_lineage, listed, packed

BASE = ("assign", "access", "hex")
WEAK = ("ident", "secret", "endpoint")
KINDS = BASE + WEAK
SCOPE = 400

_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_WORDS = re.compile(r"(?i:passw|secret|token|api_?key)")
_IDENT = re.compile(r"""(?:client|user|account|tenant|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})""", re.I | re.A)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT, _CAPITAL, _SMALL = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
_ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?)""", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds; leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    if _WORDS.search(text):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        out += [(2, m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], s[0]))


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no base span and no other part: identifiers, then endpoints, then secret-looking strings."""
    out: list[tuple[int, int, int]] = []

    def free():
        """Tells whether a stretch touches nothing found so far."""
        edges = sorted((a, b) for _, a, b in [*base, *out])
        starts = np.array([e[0] for e in edges], np.int64)
        ends = np.maximum.accumulate(np.array([e[1] for e in edges], np.int64)) if edges else starts

        def of(a: int, b: int) -> bool:
            k = int(np.searchsorted(starts, b))
            return k == 0 or int(ends[k - 1]) <= a

        return of

    low = text.lower() if "=" in text or ":" in text else ""
    finds = []
    if low and ("id" in low or "name" in low):
        finds.append((3, _IDENT))
    if "://" in text or low and any(w in low for w in ("host", "endpoint", "server", "url")):
        finds.append((5, _ENDPOINT))
    for kind, pattern in finds:
        apart = free()
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if apart(m.start(), m.end())]
    if out or base:  # a string that looks secret needs company
        apart = free()
        mixed = lambda m: all(p.search(text, m.start(), m.end()) for p in (_DIGIT, _CAPITAL, _SMALL))
        out += [(4, m.start(), m.end()) for m in _SECRET.finditer(text) if mixed(m) and apart(m.start(), m.end())]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            both.append((base, weak_parts(text or "", base)))
        columns = [batch.column(0)]
        for k in (0, 1):
            spans = [s for pair in both for s in pair[k]]
            struct = pa.StructArray.from_arrays([pa.array([s[i] for s in spans], pa.int32()) for i in range(3)], names=["kind", "start", "end"])
            columns.append(listed(np.cumsum([0, *[len(pair[k]) for pair in both]]), struct))
        yield pa.RecordBatch.from_arrays(columns, names=[ROW, "base", "weak"])


def scan(docs: DataFrame, *, keep: list[str] | None, text: str = "text") -> DataFrame:
    """``__row``, ``base`` and ``weak``: arrays of (kind, start, end), code points, end exclusive."""
    rows = packed(docs, keep, text=F.col(text))
    spans = "array<struct<kind:int,start:int,end:int>>"
    return rows.mapInArrow(_scan, f"`{ROW}` {rows.schema[ROW].dataType.simpleString()}, base {spans}, weak {spans}")


def _role(kind: Column) -> Column:
    """0 identifier, 1 secret, 2 endpoint."""
    return F.when(kind.isin(1, 3), 0).when(kind == 5, 2).otherwise(1)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of parts (doc, kind, start, end), the weak ones with a complement of each other role within ``scope`` characters.

    Distance is that between the ends that face each other, 0 if they overlap.
    """
    cut = lambda c: (c / scope).cast("int")
    roled = parts.withColumn("role", _role(F.col("kind")))
    # A stretch is as wide as the scope: a part in one's own stretch is always near enough, and of a
    # neighbouring stretch the extreme that faces the part decides.
    held = roled.select("doc", "role", "start", "end", F.explode(F.sequence(cut(F.col("start")), cut(F.col("end") - 1))).alias("at"))
    held = held.groupBy("doc", "at", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    asks = roled.where("kind >= 3").select("doc", "kind", "start", "end", "role", F.explode(F.sequence(cut(F.col("start")) - 1, cut(F.col("end") - 1) + 1)).alias("at"))
    met = asks.join(held.withColumnRenamed("role", "other"), ["doc", "at"]).where("role <> other")
    near = (F.col("first") - F.col("end") <= scope) & (F.col("start") - F.col("last") <= scope)
    has = lambda r: F.max((F.col("other") == r) & near).alias(f"has{r}")
    full = met.groupBy("doc", "kind", "start", "end", "role").agg(*[has(r) for r in range(3)])
    return full.where("(role = 0 or has0) and (role = 1 or has1) and (role = 2 or has2)").select("doc", "kind", "start", "end")


def _shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, *, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans.

    Null and empty texts have none. Repeated documents each get their row; their
    parts are told apart by id and text, so different texts under one id never link.
    """
    found = cut_lineage(scan(docs.select(F.struct(F.col(id).alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("key")).alias("own"), F.col(text).alias("text")), keep=["own"]))
    key = F.col(f"{ROW}.own")
    parts = found.where("size(weak) > 0").select(key.alias("doc"), F.explode(F.concat("base", "weak")).alias("s")).select("doc", "s.*").distinct()
    extra = linked(parts, scope).groupBy(F.col("doc").alias("mine")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    weak = found.where("size(weak) > 0").join(extra, F.col("mine").eqNullSafe(key), "left").select(ROW, "base", "extra")
    plain = found.where("size(weak) = 0").select(ROW, "base", F.lit(None).cast("array<struct<kind:int,start:int,end:int>>").alias("extra"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    every = plain.unionByName(weak)
    return every.select(
        key["id"].alias("doc_id"), *[of(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.concat("base", F.coalesce("extra", F.array()))).alias("spans"),
    )
