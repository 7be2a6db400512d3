"""Run registered queries against their oracles and report time and agreement.

usage: python tests/check_all.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

import __spark_entry__ as entrypoint
from millrace.session import local_session
from oracle import compare, connect

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    oracles = entrypoint.oracle_sql()
    bad = 0
    total = time.time()
    for name, fn in entrypoint.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            rows = df.collect()
            took = time.time() - t
            if name in oracles:
                t = time.time()
                cur = con.execute(oracles[name])
                want = cur.fetchall()
                cols = [d[0] for d in cur.description]
                duck = time.time() - t
                problem = compare(rows, df.columns, want, cols)
            else:
                problem, duck = None, 0
            tag = "BAD " if problem else ("ok  " if name in oracles else "rows")
            print(f"{tag} {name:32s} rows={len(rows):7d} spark={took:6.2f}s duck={duck:5.2f}s {problem or ''}"[:700], flush=True)
            bad += bool(problem)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:900]}", flush=True)
            if "-v" in wanted:
                traceback.print_exc()
    print(f"bad={bad} total={time.time() - total:.1f}s")
