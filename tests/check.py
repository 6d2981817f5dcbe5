"""python tests/check.py [sf_dir] [name…]: every registered query against its SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from crivo.session import build_session  # noqa: E402
from workload import ORACLE, QUERIES  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in ORACLE:
                msg = oracle.compare(spark, con, QUERIES[n], ORACLE[n], sf)
                types = oracle.type_families(QUERIES[n](spark, sf), con, ORACLE[n])
                if types and not msg:
                    print(f"TYPES {n} {types}")
            else:
                msg = None if QUERIES[n](spark, sf).count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001 - the report names the query
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        if msg:
            bad += 1
            print(f"FAIL {n}: {msg}", flush=True)
        elif time.time() - t > 3:
            print(f"slow {n} {time.time() - t:.1f}s", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok, {len([n for n in names if n in ORACLE])} with SQL")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
