"""Personal data by weak supervision, in column expressions only.

1. Candidates: certain forms (base spans, always reported) and loose forms.
2. Labelers vote on each candidate (no, abstain, yes): strict form, check digits
   or format, gazetteer, context before the span, shape of the digits.
3. Expectation-maximisation over the counts of vote patterns estimates how
   reliable each labeler is and how likely each pattern is personal data.
4. A logistic span classifier is trained on those likelihoods over span features;
   a loose candidate becomes a span where it says ``ACCEPT`` or more.

The counts table has at most kinds x 3^labelers x 2^features rows whatever the
corpus, so the driver reads a bounded table; documents are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import ROW, cut_lineage, packed

KINDS = ("email", "ip", "card", "phone", "name", "national")
BASE = KINDS[:4]
LABELERS = ("form", "check", "gazetteer", "context", "shape")
FEATURES = ("form", "check", "gazetteer", "context", "against", "separated")
ACCEPT = 0.9
BLOCK = 64

# Possessive forms of the contract's patterns: same matches, no backtracking into a run.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
DIGITS = r"[0-9](?<!(?:[0-9]|[0-9][\x20-])[0-9])(?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}\x20?[(\[]\x20?[aA][tT]\x20?[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]\x20?[dD][oO][tT]\x20?[)\]]|\.)\x20?[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Titles that stand before a name, and frequent given names.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora")
GIVEN = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Hans", "Anna", "Peter", "Marie", "Pierre", "Jean", "Sophie", "Carlos", "José", "María", "Juan", "Luis", "Carmen", "Klaus", "Thomas", "Sarah", "Karen", "Paul")
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{Ll}}++|(?:{'|'.join(GIVEN)})\x20\p{{Lu}}\p{{Ll}}++)(?:\x20\p{{Lu}}\p{{Ll}}++)?"
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "ch", "at", "be", "nl", "us")
DIALS = ("+1", "+33", "+34", "+39", "+41", "+43", "+44", "+49")
FOR = r"(?i)(?:e-?mail|contact|tel|phone|mobile|call|fax|ssn|social|security|card|visa|name|from|dear|signed|ip|host|server)\b[^\n]{0,16}$"
AGAINST = r"(?i)(?:order|invoice|serial|version|isbn|issn|ticket|ref|part|model|page|figure|article|no\.?|nr\.?|id)\b[^\n]{0,16}$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add) -> Column:
    """Running totals of a non-empty array, by blocks: no step copies more than a block or the list of blocks."""

    def within(a, b, start):
        return F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), F.array(start), lambda got, x: F.concat(got, F.array(add(F.element_at(got, -1), x))))

    def whole(a):
        blocks = F.sequence(F.lit(0), ((F.size(a) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda got, x: F.concat(got, F.array(add(F.element_at(got, -1), x))))
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda b: F.slice(within(a, b, s[b]), F.lit(2), F.lit(BLOCK)))))

    return let(values, whole)


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """(start, end, value, before) of the leftmost non-overlapping matches; code points, end exclusive."""
    kind = "array<struct<start:int,end:int,value:string,before:string>>"
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("piece"))

    def placed(pairs):
        ends = running(F.transform(pairs, lambda p: F.length(p["piece"]) + F.length(p["value"])), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, e: F.struct((e - F.length(p["value"])).alias("start"), e.alias("end"), p["value"].alias("value"), F.right(p["piece"], F.lit(40)).alias("before")))

    some = let(pieces, lambda a: F.when(F.size(a) > 1, placed(F.slice(a, F.lit(1), F.size(a) - 1))))
    return F.coalesce(F.when(guard, some), F.array()).cast(kind)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d):
        def one(s, i):
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return s + x - F.when(x > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), one)

    return let(digits, total) % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    """0 no, 1 abstain, 2 yes."""
    return F.when(yes, 2).otherwise(F.when(no, 0).otherwise(1) if no is not None else F.lit(1))


def _judged(kind: str, spans: Column, certain, check, gazetteer) -> Column:
    """Candidates of one kind with their base mark, vote pattern and feature pattern."""
    number = KINDS.index(kind)

    def judge(c):
        value, before = c["value"], c["before"]
        digits = _digits(value)
        sure, good, known = certain(value), check(value), gazetteer(value)
        for_, against = before.rlike(FOR), before.rlike(AGAINST)
        flat = F.length(digits) > 6
        dull = flat & (digits.rlike(r"^([0-9])\1+$") | digits.rlike("^(?:0?123456789|12345678|1234567)[0-9]*$"))
        votes = (_vote(sure, F.lit(kind in ("card", "ip"))), _vote(good, ~good), _vote(known), _vote(for_, against), _vote(F.lit(False), dull))
        marks = (sure, good, known, for_, against & ~for_, value.rlike(r"[\x20().-]"))
        code, bits = F.lit(0), F.lit(0)
        for k, v in enumerate(votes):
            code = code + v * 3**k
        for k, m in enumerate(marks):
            bits = bits + F.when(m, 1 << k).otherwise(0)
        return F.struct(
            F.lit(number).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            (sure if kind in BASE else F.lit(False)).alias("base"), code.alias("votes"), bits.alias("marks"),
        )

    return F.transform(spans, judge)


def candidates(text: Column) -> Column:
    """All candidates of a text: array<struct<kind,start,end,base,votes,marks>>, by kind, then start."""
    text = F.coalesce(text, F.lit(""))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    yes, no = (lambda v: F.lit(True)), (lambda v: F.lit(False))
    has = lambda p: text.rlike(p)
    tld = lambda v: F.lower(F.regexp_extract(v, r"([A-Za-z]{2,})[^A-Za-z]*$", 1)).isin(*TLDS)
    length = lambda v: F.length(_digits(v))
    ok_card = lambda v: length(v).between(16, 19) & _luhn(_digits(v))
    ok_phone = lambda v: length(v).between(8, 15)
    ok_ip = lambda v: v.rlike(rf"^(?:{part}\.){{3}}{part}$")
    area = lambda v: ~_digits(v).rlike("^[01]")
    digit = has("[0-9]")
    groups = [
        _judged("email", _found(text, EMAIL, text.contains("@")), yes, lambda v: v.rlike(r"\.[A-Za-z]{2,}$"), tld),
        _judged("email", _found(text, LOOSE_EMAIL, has(r"[(\[]\x20?[aA][tT]\x20?[)\]]")), no, lambda v: v.rlike(r"[A-Za-z]{2,}$"), tld),
        _judged("ip", _found(text, IP, has(r"[0-9]\.[0-9]")), ok_ip, ok_ip, no),
        _judged("card", _found(text, DIGITS, digit), ok_card, ok_card, no),
        _judged("phone", _found(text, PHONE, text.contains("+")), ok_phone, ok_phone, lambda v: F.substring(v, 1, 3).isin(*DIALS) | v.startswith("+1")),
        _judged("phone", _found(text, LOOSE_PHONE, digit), no, area, no),
        _judged("name", _found(text, NAME, has(rf"(?:{'|'.join(TITLES + GIVEN)})\.?\x20")), no, lambda v: v.rlike(r"\x20"), lambda v: v.rlike("|".join(GIVEN))),
        _judged("national", _found(text, NATIONAL, has("[0-9]-[0-9]{2}-[0-9]")), no, lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), no),
    ]
    return F.concat(*groups)


@dataclass
class Model:
    """What was learnt: labeler reliability, and the accepted (kind, marks) codes."""

    reliability: list[float]
    rate: list[float]
    weights: list[float]
    accepted: list[int]


def em(table: list[tuple[int, int, int, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likelihood of each row of (kind, votes, marks, count), labeler reliabilities, share per kind.

    One reliability per labeler where it does not abstain; priors of eight right
    and two wrong votes, and of one candidate each way per kind, keep them
    proper where votes are few.
    """
    kinds = np.array([t[0] for t in table], int)
    weight = np.array([t[3] for t in table], float)
    votes = np.array([[t[1] // 3**k % 3 for k in range(len(LABELERS))] for t in table], int).reshape(len(table), len(LABELERS))
    said = votes - 1
    score = 1 / (1 + np.exp(-said.sum(1).astype(float)))
    right, share = np.full(len(LABELERS), 0.8), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        for k in range(len(LABELERS)):
            agree = (weight * np.where(said[:, k] > 0, score, 1 - score))[said[:, k] != 0].sum()
            right[k] = (agree + 8) / (weight[said[:, k] != 0].sum() + 10)
        right = np.clip(right, 0.5, 0.999)
        for k in range(len(KINDS)):
            share[k] = ((weight * score)[kinds == k].sum() + 1) / (weight[kinds == k].sum() + 2)
        lean = np.log(right / (1 - right))
        score = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share))[kinds] + said @ lean, -60, 60)))
    return score, right, share


def _design(kind: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(KINDS))[kind], (marks[:, None] >> np.arange(len(FEATURES))) & 1], axis=1)


def train(table: list[tuple[int, int, int, int]], accept: float = ACCEPT) -> Model:
    """EM, then a regularised logistic classifier on its likelihoods (Newton steps on the counts)."""
    codes = [(k, m) for k in range(len(KINDS)) for m in range(1 << len(FEATURES))]
    if not table:
        return Model([], [], [], [])
    score, right, share = em(table)
    x = _design(np.array([t[0] for t in table]), np.array([t[2] for t in table]))
    n = np.array([t[3] for t in table], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - score)) + w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    z = _design(np.array([c[0] for c in codes]), np.array([c[1] for c in codes])) @ w
    line = math.log(accept / (1 - accept))
    # A pattern of marks that no candidate showed is not accepted.
    shown = {(t[0], t[2]) for t in table}
    good = [k * 64 + m for (k, m), v in zip(codes, z.tolist(), strict=True) if v >= line and (k, m) in shown]
    return Model(right.tolist(), share.tolist(), w.tolist(), good)


def counted(found: DataFrame) -> list[tuple[int, int, int, int]]:
    """The bounded table of vote and feature patterns with their counts."""
    one = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.marks").count()
    return sorted(tuple(r) for r in one.collect())


def decided(model: Model, found: Column) -> Column:
    """Base spans and accepted loose spans that overlap none of them; by kind, then start."""

    def whole(all_):
        base = F.filter(all_, lambda c: c["base"])
        loose = F.filter(all_, lambda c: ~c["base"] & (c["kind"] * 64 + c["marks"]).isin(*(model.accepted or [-1])))
        apart = let(base, lambda b: F.filter(loose, lambda c: ~F.exists(b, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))))
        plain = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        return F.array_sort(F.array_distinct(F.concat(plain(base), plain(apart))))

    return let(found, whole)


def _shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans.

    Null and empty texts have none. Repeated documents each get their row.
    """
    found = cut_lineage(packed(docs, [id], found=candidates(F.col(text))))
    model = train(counted(found))
    base = F.filter("found", lambda c: c["base"])
    of = lambda k: F.filter("found", lambda c: c["base"] & (c["kind"] == k))
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select(F.col(f"{ROW}.`{id}`").alias("doc_id"), *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(decided(model, F.col("found"))).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``length``, if there, follows the text.

    Overlapping spans become one mark, that of the first. Null texts stay null.
    """
    # Stored, so that the patterns run once: the counts are needed before the first span is decided.
    rows = cut_lineage(packed(docs, [c for c in docs.columns if c != text], text=F.col(text), found=candidates(F.col(text))))
    model = train(counted(rows))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def marked(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

        def joined(o):
            ends = running(F.transform(o, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

            def piece(s, before):
                new = s["start"] >= before
                return F.when(new, F.concat(F.substring(F.col("text"), before + 1, s["start"] - before), name[s["kind"]])).otherwise("")

            def whole(e):
                begin = F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1))
                rest = F.substring(F.col("text"), F.element_at(e, -1) + 1, F.length(F.col("text")))
                return F.concat(F.array_join(F.zip_with(o, begin, piece), ""), rest)

            return let(ends, whole)

        return F.when(F.size(spans) > 0, let(ordered, joined)).otherwise(F.col("text"))

    done = rows.withColumn("text", F.when(F.size("found") > 0, let(decided(model, F.col("found")), marked)).otherwise(F.col("text")))
    changed = {text: F.col("text")} | ({length: F.length("text").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return done.select(*[changed.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])
