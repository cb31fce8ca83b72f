import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest

from metreur.llm import packing, tokens

from .fixtures import documents, empty, prose

TEXTS = [
    "a  b", " a", "a \n b", "<|endoftext|> hi <|startoftext|>x", "don't  stop\tit's", "É́ á ́b", "x\x1cy z\x0b w", "ΑΣ ΣΑΣ.", " ", "\n\n", "日本 語 。", "I'LL we'VE", "🙂 ok 👩‍👩‍👧",
    "\u0085 b c", "xy", "'s's't 123a4 !!??a", "İstanbul ẞ ß ǅ ŉ", "ç", "\x00\x01 \x7f", "K̊", "x" * 5000,
]


def test_ids_are_the_tokenizers():
    table = tokens.WordIds(tokens.tokenizer_file(packing.TOKENIZER), kept=50)
    for text in [*TEXTS, prose(3, 400), prose(4, 400)]:
        assert table.ids(text).tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)[:60]
    assert table.ids(None).tolist() == table.ids("").tolist() == []


@pytest.mark.parametrize("capacity", [10, 50, 2048])
def test_sweeps_fill_and_are_as_few_as_best_fit_decreasing(capacity):
    r = random.Random(capacity)
    for n in (0, 1, 7, 400):
        for most in (capacity, max(capacity // 2, 1), max(capacity // 6, 1)):
            lengths = [r.randint(1, most) for _ in range(n)]
            placed, opened = packing.sweep(Counter(lengths), capacity)
            sequences, got = {}, Counter()
            for length, _, ranks, first, offset, each in placed:
                for k in range(ranks):
                    got[length] += 1
                    sequences.setdefault(first + k // each, []).append((offset + k % each * length, length))
            assert got == Counter(lengths) and len(sequences) == opened
            for own in sequences.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity
            gaps = []
            plain = 0
            for length in sorted(lengths, reverse=True):
                k = bisect_left(gaps, length)
                left = capacity - length if k == len(gaps) else gaps.pop(k) - length
                plain += k == len(gaps) and left == capacity - length
                insort(gaps, left)
            assert opened <= len(gaps) + 1


def test_every_piece_has_a_place(spark):
    rows = [(k, prose(k, k * 5 % 700)) for k in range(80)] + [(1, None), (2, ""), (2, ""), (None, "x"), (99, prose(1, 4000))] + [(200 + k, "same text") for k in range(300)]
    found = packing.pack(documents(spark, rows).repartition(3)).collect()
    table = tokens.tokenizer(packing.TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = np.append(table.ids(t), np.uint32(0)).astype("<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in found) // 2048) + 1


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0
