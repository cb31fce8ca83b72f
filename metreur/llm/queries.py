"""The corpus operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metreur.llm import audit, chat, decontaminate, dedup, neardup, order, packing, pii, quality, secrets, topk, trie, warc
from metreur.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Statements for DuckDB, by query.
CHECKS: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_pii(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CHECKS["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, words, least(10, len(words)) AS w FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE item_id IS NOT NULL AND len(words) > 0),
own AS (SELECT DISTINCT item_id, w, array_to_string(words[k : k + w - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - w + 2)) AS k FROM i)),
sizes AS (SELECT DISTINCT w FROM own),
seen AS (SELECT doc_id, k, w, array_to_string(words[k : k + w - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - w + 2)) AS k FROM d, sizes)),
met AS (SELECT doc_id, k, w, item_id FROM seen JOIN own USING (w, win)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + w)) AS place FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op3_quality(spark, sf_dir):
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_neardup(spark, sf_dir):
    return neardup.grouped(read(spark, sf_dir, "documents"))


CHECKS["op5_neardup"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k : k + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM t WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * met >= 75 * (nx.n + ny.n - met)),
link AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.r = link.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op6_secrets(spark, sf_dir):
    return secrets.report(read(spark, sf_dir, "documents"))


@query
def op7_pack(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op8_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


CHECKS["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, sha1(html) AS digest, octet_length(encode(html)) AS bytes FROM p),
c AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM c
"""


@query
def op10_chat(spark, sf_dir):
    return chat.repair(read(spark, sf_dir, "conversations"))


@query
def op4_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"))


CHECKS["op4_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op9_order(spark, sf_dir):
    return order.report(read(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark, sf_dir):
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


CHECKS["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS x(name, k)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k) JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT filter_order, step, ks[step] AS k, ks[1 : step - 1] AS gone FROM (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, k, fails[k] AS here, len(list_filter(gone, lambda g: fails[g])) > 0 AS out, len(list_filter(fails, lambda y: y)) AS many, n, good, toxic
  FROM c CROSS JOIN s),
one AS (
  SELECT part, filter_order, step, k,
         sum(CASE WHEN NOT here AND NOT out THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT out THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND out THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT out THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT out THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM one
"""


@query
def op12_prefix_trie(spark, sf_dir):
    return trie.rebuilt_nodes(read(spark, sf_dir, "conversations"))


@query
def op13_exact_dedup(spark, sf_dir):
    return dedup.assigned(read(spark, sf_dir, "documents"))


CHECKS["op13_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
