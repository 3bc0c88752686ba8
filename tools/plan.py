"""Print executed plans of registered queries with counts of scans, exchanges and reuse.

usage: python tools/plan.py [-v] [-d DIR] name ...
"""

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stakeflow.plans import QUERIES
from stakeflow.session import local_session

ap = argparse.ArgumentParser()
ap.add_argument("-v", action="store_true")
ap.add_argument("-d", default="/root/testdata/sf0.01")
ap.add_argument("names", nargs="+")
a = ap.parse_args()
spark = local_session()
for name in a.names:
    df = QUERIES[name](spark, a.d)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    count = {k: len(re.findall(p, final)) for k, p in {
        "scans": r"Scan parquet|FileScan", "exchanges": r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning",
        "broadcasts": "BroadcastExchange", "reused": "ReusedExchange", "sorts": r"Sort \[", "windows": r"Window \[", "nested_loop": "NestedLoop|CartesianProduct",
        "python": "ArrowEvalPython|MapInPandas|InPandas"}.items()}
    print(name, count)
    if a.v:
        print(final)
