"""python tests/check_all.py [sf folder] [name part …]: all queries against their SQL."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridspan.session import local_session  # noqa: E402
from gridspan.suite import ORACLES, QUERIES  # noqa: E402
from tests.oracle import compare, database  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = database(sf)
    failed = 0
    for name, function in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begun = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, function, ORACLES[name], sf)
            else:
                problem = None if function(spark, sf).collect() else "no rows"
        except Exception as error:  # a failing query is a line of the report
            problem = f"{type(error).__name__}: {str(error)[:500]}"
            if len(wanted) == 1:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - begun:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
