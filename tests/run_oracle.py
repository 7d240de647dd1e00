"""Compare every registered query with its oracle SQL (like the driver)."""

import json
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402
from tickforge.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
spark = local_session(8)
con = duck(sf)
q, o = E.queries(), E.oracle_sql()
results = {}
for name in sorted(q):
    if only and name not in only:
        continue
    t = time.time()
    try:
        if name in o:
            r = compare(q[name](spark, sf), o[name], con)
        else:
            r = {"rows": (q[name](spark, sf).count(), None), "rows_only": True}
    except Exception as e:  # noqa: BLE001
        r = {"error": str(e).splitlines()[0][:300]}
    r["sec"] = round(time.time() - t, 1)
    results[name] = r
    ok = r.get("hash_match") or r.get("rows_only")
    print(("OK  " if ok else "BAD ") + name, json.dumps(r, default=str)[:600], flush=True)
bad = [k for k, v in results.items() if not (v.get("hash_match") or v.get("rows_only"))]
print("SUMMARY", len(results) - len(bad), "/", len(results), "bad:", bad)
