"""Write the formatted physical plans of the headline queries to docs/plans/
and print a one-line summary per query (exchanges, codegen stages, Python
nodes, pushed filters): python scripts/explain_plans.py [sf_dir]"""

import os
import re
import sys

sys.path.insert(0, ".")
from tidecast.plans.catalog import QUERIES  # noqa: E402
from tidecast.session import build_session  # noqa: E402

NAMES = ["pulls_monthly_filled", "commits_daily_filled", "issues_peak_days", "issues_in_windows_capped",
         "contributors_monthly", "contributors_timeline", "recent_releases", "pulls_ses_forecast",
         "ar5_forecast", "additive_forecast", "lookback_forecast"]
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = build_session("local[8]", 8, extra={"spark.sql.maxMetadataStringLength": "400"})
os.makedirs("docs/plans", exist_ok=True)
for n in NAMES:
    df = QUERIES[n](spark, sf)
    df.collect()  # run it, so the formatted plan is the final adaptive plan
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = re.sub(r"file:/root/testdata/[^\]]*", "<testdata>", plan)
    with open(f"docs/plans/{n}.txt", "w") as f:
        f.write(plan)
    head = plan.split("\n\n")[0]
    ex = len(re.findall(r"Exchange", head)) - len(re.findall(r"ReusedExchange", head))
    print(f"{n:28s} exchanges={ex:2d} codegen={len(set(re.findall(r'\[codegen id : (\d+)\]', plan))):2d} "
          f"python={len(re.findall(r'ArrowEvalPython|MapInPandas|BatchEvalPython', head))} "
          f"broadcast={len(re.findall(r'BroadcastExchange', head))} "
          f"partial_agg={'yes' if 'partial_' in plan else 'no'} "
          f"window_group_limit={'yes' if 'WindowGroupLimit' in head else 'no'}")
