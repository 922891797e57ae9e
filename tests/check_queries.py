"""Run registered queries against their SQL twins: python tests/check_queries.py [sf_dir] [name ...]."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tests.oracle import TIMES, compare, connect  # noqa: E402
from verdictframe.plans import load  # noqa: E402
from verdictframe.session import get_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    registry = load()
    names = args[1:] or list(registry.QUERIES)
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, sf_dir)
            sql = registry.ORACLES.get(name)
            if sql is None:
                print(f"ok    {name} rows={len(df.collect())} (no sql) {time.time() - start:.1f}s", flush=True)
                continue
            problem = compare(name, df, sql, con)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {name} {time.time() - start:.1f}s (spark %.1f sql %.1f) {problem or ''}" % TIMES.get(name, (0, 0)), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
