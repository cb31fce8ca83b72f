import hashlib
import re

from metreur.llm import pii

from .fixtures import documents, empty, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    counts, spans = [], []
    for kind, pattern in PATTERNS.items():
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
        counts.append(len(own))
        spans += own
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


TEXTS = [
    None, "", "@", "a@b", "a@b.co", "a@b.co_x@d.ef y", "a@b.c.d@e.f", "é🙂 x@y.zz 1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 0000255.1.1.1 9.1.2.3.4",
    "1.2.3.x 2.3.4.5", "4539578763621486", "4539 5787-6362 1486 ", "45395787636214861", "4539578763621486 1", "+1 (843) 555-4223", "+1", "+1 ", "+12345678901234567890",
    "+1 2 3 4 5 6 7 8 ...", "tel +33 1 23 45 67 89.", "x" * 20000 + "@" + "y" * 10, "a." * 5000 + "@" + "b." * 5000 + "c", "7" * 30000, "1.1.1.1 " * 700, "1 " * 40, "12-34-56-78-90-12-34-56",
    "٣@b.co ١.2.3.4 1.2.3.4", prose(3, 300),
    "10.0.0.1 127.0.0.1, 192.168.0.1 0.0.0.0 00.000.1.0 0.1.2.3 0256.0.0.1 1.00255.0.0", "0" * 4000 + ".0.0." + "0" * 4000 + " " + "0" * 4000 + "256.1.1.1", "x" * 100_000 + " 10.0.0.1",
]


def test_base_spans_are_the_plain_matches(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (4, TEXTS[4])]
    found = pii.report(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        wanted, spans = brute(TEXTS[4] if r.doc_id is None else TEXTS[r.doc_id])
        assert tuple(r)[1:6] == wanted, r.doc_id
        assert set(spans) <= set(r.spans.split(",")), r.doc_id


def test_labelers_find_loose_spans_and_leave_numbers_alone(spark):
    sure = [(k, f"mail me at user{k}@mail.example.com or call +1 (415) 555-26{k:02d}") for k in range(10, 70)]
    loose = [(100, "write to email jane (at) example (dot) com today"), (101, "order 1234567890123456 shipped"), (102, "phone 415-555-2671 please")]
    found = {r.doc_id: r.spans for r in pii.report(documents(spark, sure + loose)).collect()}
    assert found[101] == ""
    assert found[100].startswith("email:")


def test_estimation_learns_reliability():
    # Labeler 1 agrees with the truth, labeler 3 with a coin.
    vote = lambda *v: sum(x * 3**k for k, x in enumerate(v))
    table = [(0, vote(2, 2, 2, 0, 1), 1, 50), (0, vote(2, 2, 2, 2, 1), 1, 50), (2, vote(0, 0, 1, 2, 1), 8, 50), (2, vote(0, 0, 1, 0, 1), 16, 50)]
    score, right, _ = pii.em(table)
    assert score[:2].min() > 0.9 and score[2:].max() < 0.1
    assert right[1] > 0.95 and right[3] < 0.7
    model = pii.train(table)
    assert 1 in model.accepted and 2 * 64 + 8 not in model.accepted


def test_redaction(spark):
    rows = [(1, "a x@y.zz b +1 (843) 555-4223 c"), (2, None), (3, ""), (4, "plain"), (5, "é🙂 1.2.3.4"), (6, "4539578763621486"), (6, "4539578763621486")]
    frame = documents(spark, rows)
    out = pii.redact(frame)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.where("text is not null").collect())
    assert got == sorted([(1, "a [EMAIL] b [PHONE] c", 21), (3, "", 0), (4, "plain", 5), (5, "é🙂 [IP]", 7), (6, "[CARD]", 6), (6, "[CARD]", 6)])
    assert out.where("text is null").count() == 1


def test_empty_table(spark):
    assert pii.report(empty(spark)).count() == 0
    assert pii.redact(empty(spark)).count() == 0
