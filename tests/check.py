"""Runs queries against their oracles: ``python tests/check.py <sf_dir> [key prefixes...]``."""

import sys
import time

sys.path.insert(0, "/root/repo")
import __spark_entry__ as entry  # noqa: E402
from cellseason.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf, want = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls, bad = connect(sf), entry.queries(), entry.oracle_sql(), 0
    for k, fn in qs.items():
        if want and not any(k.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            t1 = time.time()
            if k in sqls:
                msg = compare(df, con, sqls[k])
            else:
                n = len(df.collect())
                msg = "" if n else "EMPTY"
                k += f" [rows only: {n}]"
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += bool(msg)
        print(f"{'BAD ' if msg else 'ok  '} {k} {time.time() - t:.1f}s {msg}", flush=True)
    print("bad:", bad)
