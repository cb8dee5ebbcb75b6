"""CLI: python tests/run_oracles.py [sf_dir] [name-prefix...]"""
import json, sys, time, traceback
sys.path.insert(0, "/root/repo")
from tabwright.session import get_spark
from tabwright.plans.queries import queries, oracle_sql
from tests.oracle import compare, duck

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
pref = sys.argv[2:]
spark = get_spark(shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
con = duck(sf)
qs, os_ = queries(), oracle_sql()
bad = 0
for name, fn in qs.items():
    if pref and not any(name.startswith(p) for p in pref):
        continue
    t = time.time()
    try:
        r = compare(spark, con, name, fn, os_.get(name), sf)
    except Exception as e:
        r = {"name": name, "status": "ERROR " + repr(e)[:400]}
    r["sec"] = round(time.time() - t, 2)
    if r["status"] not in ("ok", "rows-only"):
        bad += 1
    print(json.dumps(r, default=str)[:700], flush=True)
print("BAD", bad)
