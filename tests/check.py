"""python tests/check.py [--sf 0.01] [prefix ...]: run catalogue queries against their SQL twins."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

args = sys.argv[1:]
sf = "0.01"
if "--sf" in args:
    i = args.index("--sf")
    sf = args[i + 1]
    del args[i : i + 2]
sf_dir = f"/root/testdata/sf{sf}"
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    .config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if args and not any(name.startswith(a) for a in args):
        continue
    t0 = time.time()
    try:
        if name in sqls:
            ok, msg = compare(spark, con, fn, sqls[name], sf_dir)
        else:
            n = fn(spark, sf_dir).count()
            ok, msg = n > 0, f"{n} rows (no twin)"
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:6.2f}s {name}: {msg if not ok else msg}", flush=True)
print("failures", bad)
