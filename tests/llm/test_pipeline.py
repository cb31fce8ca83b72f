import __spark_entry__ as contract
import corpus_pipeline
from metreur.llm import decontaminate, neardup, pii, quality
from metreur.llm.queries import QUERIES

from .fixtures import prose
from .test_decontaminate import brute as plain_hits
from .test_neardup import brute as plain_groups

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(contract.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_stages_on_a_small_corpus(spark, tmp_path):
    docs = [(k, prose(k, 60)) for k in range(60)]
    docs += [(100 + k, docs[k][1].replace("paper", "papers", 1)) for k in range(10)]
    docs += [(200 + k, " ".join(w.upper() + "!!" for w in prose(k, 40).split())) for k in range(30)]
    items = [(1, prose(3, 60)[100:200]), (2, prose(999, 20))]
    docs += [(300, prose(40, 30) + " " + prose(999, 20)), (301, prose(41, 30) + " mail me@example.com")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200 or i >= 300), 0) for i, _ in docs], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    texts = dict(docs)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    good = {r.doc_id for r in quality.report(frame, labels).collect() if r.predicted}
    assert good == {i for i in texts if i < 200 or i >= 300}
    groups = plain_groups([(i, texts[i]) for i in good])
    single = {i for i in good if groups[i][1] == i}
    clean = {h[0] for h in plain_hits([(i, texts[i]) for i in single], items, 10) if not h[5]}
    assert len(clean) < len(single) < len(good)

    docs_now = frame
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_now = stage(spark, docs_now, str(tmp_path))
        docs_now.write.parquet(f"{tmp_path}/{k}")
        docs_now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs_now.columns == frame.columns
        if name == "near_duplicates":
            assert {r.doc_id for r in docs_now.collect()} == single
        if name == "decontamination":
            assert {r.doc_id for r in docs_now.collect()} == clean
        if name == "personal_data":
            assert "[EMAIL]" in docs_now.where("doc_id = 301").first().text
    assert {r.doc_id for r in docs_now.collect()} == clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs_now.count()


def test_operators_share_names_without_clashing(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "text2")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.remove_contaminated(frame, bench).columns == frame.columns
    assert pii.redact(frame).columns == frame.columns
    assert neardup.keep_one(frame).columns == frame.columns
