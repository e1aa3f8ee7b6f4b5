"""python tests/check.py [name part ...]: compare registered queries with their SQL on sf0.01 (or $SF)."""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from harness import compare, connect  # noqa: E402

from buildlore import catalog  # noqa: E402
from buildlore.catalog.base import ORACLES, QUERIES  # noqa: E402
from buildlore.session import local_session  # noqa: E402


def main() -> int:
    areas = os.environ.get("AREAS")
    if areas:
        catalog.AREAS[:] = areas.split(",")
    catalog.load()
    sf = f"/root/testdata/sf{os.environ.get('SF', '0.01')}"
    picks = sys.argv[1:]
    spark, con = local_session(), connect(sf)
    bad = 0
    for name, build in QUERIES.items():
        if picks and not any(p in name for p in picks):
            continue
        try:
            if name in ORACLES:
                problems, rows, ts, td = compare(spark, con, sf, build, ORACLES[name])
            else:
                t0 = time.time()
                rows, problems, td = len(build(spark, sf).collect()), [], 0.0
                ts = time.time() - t0
        except Exception as e:
            problems, rows, ts, td = [f"{type(e).__name__}: {str(e)[:1500]}"], 0, 0.0, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = "ok " if not problems else "BAD"
        bad += bool(problems)
        print(f"{flag} {name:34s} rows={rows:<7d} spark={ts:5.1f}s sql={td:5.1f}s {'' if name in ORACLES else '(rows only)'}", flush=True)
        for p in problems:
            print("      ", p, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
