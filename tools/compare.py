"""Run registered queries beside their statements and report differences.

usage: python tools/compare.py [table folder] [name prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from metreur.checks import CHECKS  # noqa: E402
from metreur.registry import QUERIES  # noqa: E402
from metreur.session import local_session  # noqa: E402
from metreur.views import TABLES  # noqa: E402


def shown(value):
    if value is None or isinstance(value, bool):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, build in QUERIES.items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            rows = frame.collect()
        except Exception as problem:  # report and go on
            bad += 1
            print(f"FAIL {name}: spark {str(problem)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in CHECKS:
            print(f"rows {name}: {len(rows)} rows, {took:.1f} s", flush=True)
            continue
        start = time.time()
        try:
            result = db.execute(CHECKS[name])
            columns = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            other = result.fetchall()
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: sql {str(problem)[:600]}", flush=True)
            continue
        sql_took = time.time() - start
        kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
        order = sorted(kinds)
        if order != sorted(columns):
            bad += 1
            print(f"FAIL {name}: columns {order} / {sorted(columns)}", flush=True)
            continue
        mine = sorted(tuple(shown(row[c]) for c in order) for row in rows)
        at = [columns.index(c) for c in order]
        theirs = sorted(tuple(shown(row[i]) for i in at) for row in other)
        same = mine == theirs
        bad += not same
        pairs = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        odd = {c: (k, types[c]) for c, k in kinds.items() if k in pairs and pairs[k] != types[c]}
        print(f"{'ok  ' if same else 'FAIL'} {name}: {len(mine)}/{len(theirs)} rows, {took:.1f} s, sql {sql_took:.1f} s {odd or ''}", flush=True)
        if not same:
            left, right = set(mine) - set(theirs), set(theirs) - set(mine)
            print("   ", order, len(left), len(right))
            for row in sorted(left)[:2]:
                print("    spark", str(row)[:400])
            for row in sorted(right)[:2]:
                print("    sql  ", str(row)[:400])
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
