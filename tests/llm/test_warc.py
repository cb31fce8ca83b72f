import hashlib
import random

from metreur.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 3) for i, u, h in rows], "page_id bigint, url string, html string, digest string, refers_to int")


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, p in data:
        if i is not None and len(p) >= 1000:
            last[p] = max(last.get(p, i), i)
    out = []
    for i, p in data:
        other = last.get(p) if i is not None and last.get(p, i) > i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "x" * 1000), (5, "http://b/", "x" * 1000), (3, None, "x" * 1000), (5, "http://b/", "x" * 1000), (None, "u", "x" * 1000), (7, "http://c/\r\nEvil: 1", "y" * 999), (8, "", "y" * 999),
    (9, "u", None), (10, "u", ""), (11, "ü", "é" * 500), (12, "ü", "é" * 500), (13, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "z" * 2000), (14, "u", "\r\n\r\n" * 900), (-4, "u", "x" * 1000), (15, "u", "w" * 400_000),
]


def test_round_trip(spark):
    for packed in (True, False):
        got = sorted((tuple(r) for r in warc.round_trip(pages(spark, ROWS).repartition(3), packed=packed).collect()), key=str)
        assert got == brute(ROWS)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    listed = warc.write(warc.with_revisits(pages(spark, ROWS)), folder, archive_bytes=3000)
    assert listed.count() > 1
    rows = warc.read(listed, folder).collect()
    assert all(r.gap_bytes is None for r in rows)
    by_id = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(bytes(r.payload) == by_id[r.page_id] for r in rows if r.record_type == "response")


def test_salvage():
    r = random.Random(1)
    records = []
    for k in range(40):
        payload = bytes(r.randrange(256) for _ in range(r.choice([0, 9, 3000])))
        records.append(warc.record(k, f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None))
    for packed in (True, False):
        parts = [warc.member(x) if packed else x for x in records]
        at = [sum(map(len, parts[:k])) for k in range(41)]
        whole = b"".join(parts)
        assert [x[1]["page_id"] for what, x in warc.salvage(whole) if what == "record"] == list(range(40))
        bad = bytearray(whole)
        for k in (3, 20):
            bad[at[k] + len(parts[k]) // 2] ^= 0x55
        bad = b"noise" + bytes(bad[: at[39] + 25])
        found = list(warc.salvage(bad))
        lost = set(range(40)) - {x[1]["page_id"] for what, x in found if what == "record"}
        assert 39 in lost and lost <= {3, 20, 39}
        gaps = [x for what, x in found if what == "gap"]
        assert gaps[0] == (0, 5) and gaps[-1] == (at[39] + 5, 25)
        assert sum(n for _, n in gaps) == 5 + 25 + sum(len(parts[k]) for k in lost - {39})
    assert list(warc.salvage(b"")) == []
    assert list(warc.salvage(b"junk")) == [("gap", (0, 4))]


def test_long_headers_of_plain_records():
    sha = hashlib.sha1(b"page").hexdigest()
    urls = ["http://x/" + "u" * (2 << 20), "http://y/WARC/1.1" + "v" * (1 << 20), "http://z/"]
    records = [warc.record(k, url, b"page", sha, None) for k, url in enumerate(urls)]
    found = list(warc.salvage(b"".join(records)))
    assert [(what, x[1]["page_id"], x[1]["url"]) for what, x in found] == [("record", k, url) for k, url in enumerate(urls)]
    cut = records[0][: 1 << 20]
    found = list(warc.salvage(cut + b"\r\n" + records[1] + records[2]))
    assert found[0] == ("gap", (0, len(cut) + 2)) and [x[1]["page_id"] for _, x in found[1:]] == [1, 2]


def changed(one: bytes, old: bytes, new: bytes) -> bytes:
    assert old in one
    return one.replace(old, new)


def test_damaged_numbers_are_gaps_or_nulls_and_never_end_the_job(spark, tmp_path):
    sha = hashlib.sha1(b"page").hexdigest()
    good = [warc.record(k, "http://x/", b"page", sha, None) for k in range(3)]
    size = good[0].split(b"Content-Length: ")[1].split(b"\r\n")[0]
    wide = changed(good[0], b"Content-Length: " + size, b"Content-Length: " + b"9" * 5000)
    odd = changed(good[0], b"<urn:page:0>", b"<urn:page:--7>")
    large = changed(good[0], b"<urn:page:0>", b"<urn:page:99999999999999999999>")
    for packed in (True, False):
        parts = [warc.member(x) if packed else x for x in (good[0], wide, good[1], odd, large, good[2])]
        found = list(warc.salvage(b"".join(parts)))
        assert [(what, x if what == "gap" else x[1]["page_id"]) for what, x in found] == [
            ("record", 0), ("gap", (len(parts[0]), len(parts[1]))), ("record", 1), ("record", None), ("record", None), ("record", 2),
        ]
    with open(f"{tmp_path}/a.warc", "wb") as out:
        out.write(good[0] + wide + large + odd + good[1])
    rows = warc.read(spark.createDataFrame([("a.warc",)], "archive string"), f"file://{tmp_path}").collect()
    assert [(r.offset, r.gap_bytes, r.page_id) for r in rows if r.gap_bytes or r.page_id is not None] == [
        (0, None, 0), (len(good[0]), len(wide), None), (len(good[0] + wide + large + odd), None, 1),
    ]


def test_records_without_digest_and_with_other_digests_are_read():
    sha = hashlib.sha1(b"page").hexdigest()
    one = warc.record(4, "http://x/", b"page", sha, None)
    line = [x for x in one.split(b"\r\n") if x.startswith(b"WARC-Payload-Digest")][0]
    said = {
        b"": True, b"WARC-Payload-Digest: sha1:" + sha.encode() + b"\r\n": True, b"WARC-Payload-Digest: SHA-1:" + sha.upper().encode() + b"\r\n": True,
        b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"page").hexdigest().encode() + b"\r\n": True, b"WARC-Payload-Digest: blake3:abc\r\n": True,
        b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"other").hexdigest().encode() + b"\r\n": False, b"WARC-Payload-Digest: sha1:" + b"0" * 40 + b"\r\n": False,
        b"WARC-Payload-Digest: sha1:nonsense\r\n": False,
    }
    for field, sound in said.items():
        data = changed(one, line + b"\r\n", field)
        found = list(warc.salvage(data))
        if sound:
            assert [(what, x[1]["page_id"], x[1]["payload_digest"], x[1]["payload"]) for what, x in found] == [("record", 4, sha, b"page")], field
        else:
            assert found == [("gap", (0, len(data)))], field
    revisit = warc.record(5, "u", b"page", sha, 4)
    found = list(warc.salvage(changed(revisit, [x for x in revisit.split(b"\r\n") if x.startswith(b"WARC-Payload-Digest")][0] + b"\r\n", b"")))
    assert [(x[1]["refers_to"], x[1]["payload_digest"], x[1]["payload_bytes"]) for _, x in found] == [(4, None, 4)]
