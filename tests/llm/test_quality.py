import zlib

import numpy as np

from metreur.llm import quality

from .fixtures import documents, empty, prose


def corpus():
    good = [(k, ". ".join(prose(k, 20).capitalize() for _ in range(4))) for k in range(0, 300)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(k, 60).split())) for k in range(60)]
    bad += [(2000 + k, " ".join([prose(k, 1)] * 80)) for k in range(60)]
    return good, bad


def test_held_out_accuracy(spark):
    good, bad = corpus()
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    labels += [(None, 1, 0), (5, None, 0), (6, 7, 0), (424242, 1, 1)]
    frame = documents(spark, good + bad + [(None, "x"), (9999, None), (9998, "")])
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = quality.report(frame, said).collect()
    assert len(rows) == len(good) + len(bad) + 3
    wanted = {i: q for i, q, _ in labels}
    for r in rows:
        assert r.held_out == (True if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in wanted and r.doc_id is not None and r.doc_id < 9000]
    assert np.mean([r.predicted == wanted[r.doc_id] for r in held]) > 0.97
    kept = quality.keep_good(frame, said)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r.predicted for r in rows)


def test_scores_are_the_log_density_differences():
    r = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    x = [r.normal(k, 1 + k, (200, d)) for k in (0, 1)]
    total = np.array([np.concatenate(([len(v)], v.sum(0), (v.T @ v).reshape(-1))) for v in x])
    model = quality.solve(total, pooled=0.2, diagonal=0.1)
    both = (np.cov(x[0].T) * 199 + np.cov(x[1].T) * 199) / 398
    want = []
    for k in (0, 1):
        own = 0.7 * np.cov(x[k].T) + 0.2 * both + 0.1 * np.diag(np.diag(both))
        away = x[1] - x[k].mean(0)
        want.append(-0.5 * np.linalg.slogdet(own)[1] - 0.5 * (away @ np.linalg.inv(own) * away).sum(1))
    assert np.allclose(model.difference(x[1]), want[1] - want[0])


def test_one_class_or_none(spark):
    frame = documents(spark, [(k, prose(k, 5)) for k in range(9)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.report(frame, none).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id bigint, quality int")
    assert {r.score for r in quality.report(frame, ones).collect()} == {1.0}
    assert quality.report(empty(spark), none).count() == 0


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n\n", "x", "🙂", "İ" * 10, "a" * 100_000, "é É ß"):
        assert np.isfinite(quality.statistics(text)).all()
