"""``python tests/run_oracle.py [sf] [name ...]``: compare named queries, with seconds taken."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle
import __spark_entry__ as entry
from airspan.session import build_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle.connect(sf_dir), entry.oracle_sql(), 0
    for name in names:
        begun = time.time()
        try:
            if name in sqls:
                said = oracle.difference(spark, con, name, entry.queries()[name], sqls[name], sf_dir)
            else:
                said = None if entry.queries()[name](spark, sf_dir).count() >= 0 else "?"
        except Exception as error:
            said = f"{name}: {type(error).__name__} {str(error)[:600]}"
        bad += said is not None
        print(f"{'ok ' if said is None else 'BAD'} {time.time() - begun:6.2f}s {name} {'' if name in sqls else '(rows only)'} {said or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
