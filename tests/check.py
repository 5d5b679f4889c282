"""Command line: compare the named queries (default all) with their SQL.

    python tests/check.py [--sf DIR] [name or prefix ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from freightlens.session import local_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main(args):
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con = local_session(), connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, fn, sqls[name], sf)
            else:
                msg = f"rows only: {fn(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        ok = msg == "" or msg.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:5.1f}s {msg}", flush=True)
    print("failed:", bad)


main(sys.argv[1:])
