"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillmill.plans import catalog  # noqa: E402
from quillmill.session import local_session  # noqa: E402

HEADLINE = ["usage_daily", "metering_admission", "burst_windows", "chat_history", "budget_trim_by_source", "first_wins_distinct", "secret_findings", "redacted_docs", "strip_quoted_conversations", "html_clean", "license_and_prose", "doc_signals", "doc_verdicts", "benchmark_overlap", "shingle_pairs", "near_dup_survivors", "triage_budget"]
#: No query is begun after so many seconds; the line then names those left out.
LIMIT_S = float(os.environ.get("BENCH_LIMIT_S", "240"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, max(8, int(cpus)), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["usage_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts executors
    same = F.pandas_udf(lambda x: x, "long")
    spark.range(0, 1000 * int(cpus), 1, int(cpus)).select(same("id")).write.format("noop").mode("overwrite").save()  # starts Python workers
    took, start, left = {}, time.time(), []
    for name in HEADLINE:
        began = time.time()
        if began - start > LIMIT_S:
            left.append(name)
            continue
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "not_run": left}))
    spark.stop()


if __name__ == "__main__":
    main()
