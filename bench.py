"""Headline queries, timed: one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores. Each query is run
whole through the ``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metreur.registry import QUERIES  # noqa: E402
from metreur.session import local_session  # noqa: E402

HEADLINE = [
    "a4_bill_totals", "a4_bill_rollup", "a1_quality_stats", "a2_dossier_summary", "f1_normalize_text", "f18_signature",
    "s3_assemble_pdf_lines", "s5_drop_repeated_boundaries", "d3_numbered_headings", "d5_synthesize_numbering", "d6_score_anchors",
    "d7_select_perimeter", "d10_dedupe_headings", "d11_attach_context", "r2_infer_unit", "r3_mine_rules", "e1_apply_decomposition",
    "e2_apply_skeleton", "j1_overlay_edits", "j3_visible_dossiers", "j4_similar_line_pairs", "j5_match_one_to_one", "a5_evaluate_corpus",
    "d17_extract_lines",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a9_lot_counters"](spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
