"""Run registered queries against their SQL: python -m tests.check [sf] [key ...]"""

import sys
import time
import traceback

import __spark_entry__ as entry
from tendero.session import local_session
from tests.oracle import DATA, compare, connect

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
path = f"{DATA}/sf{sf}"
spark = local_session("check", 8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(path)
queries, sql = entry.queries(), entry.oracle_sql()
keys = sys.argv[2:] or list(queries)
bad = 0
for key in keys:
    t0 = time.time()
    try:
        df = queries[key](spark, path)
        if key in sql:
            said = compare(df, con, sql[key])
            n = "" if said else f"{con.execute('select count(*) from (' + sql[key] + ')').fetchone()[0]} rows"
        else:
            said, n = None, f"{df.count()} rows, no SQL"
    except Exception as e:
        said, n = f"{type(e).__name__}: {str(e)[:400]}", ""
    bad += said is not None
    print(f"{'FAIL' if said else 'ok  '} {key:32s} {time.time() - t0:6.2f}s {n} {said or ''}", flush=True)
print("failed:", bad)
