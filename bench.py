"""Measure the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores. Every query is run to the
end over all its rows and columns, without collecting them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lexhaven.plans import catalog, inputs  # noqa: E402
from lexhaven.session import local_session  # noqa: E402

HEADLINE = (
    "split_documents", "chunk_ids", "hash_embed", "blocks_code", "regions_template", "search_topk",
    "search_block", "search_single", "search_text", "detect_changes", "upsert_latest",
    "replace_files", "log_summary", "error_triage", "ingest_store",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    registered = catalog.queries()
    names = [n for n in HEADLINE if n in registered]

    rows: dict[str, int] = {}

    def run(name: str) -> float:
        seen = Observation(name)
        start = time.perf_counter()
        df = registered[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("rows"))
        df.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        rows[name] = seen.get["rows"]
        return took

    # Start the JVM, the Python workers and the code generator once.
    inputs.table(spark, folder, "documents").limit(1).collect()
    spark.range(0, 64, 1, spark.sparkContext.defaultParallelism).mapInPandas(
        lambda batches: batches, "id long"
    ).collect()
    seconds = {name: round(run(name), 3) for name in names}
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": total, "unit": "sec",
                "queries": seconds, "rows_per_second": {n: round(rows[n] / seconds[n]) for n in names},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
