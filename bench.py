"""Headline queries on one machine: prints one JSON line with the seconds of each query.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of cores.
Each query runs once for warm-up and once for the clock; its whole result is
computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from samplejobs import derived  # noqa: E402
from samplejobs.jobs import QUERIES  # noqa: E402
from veilspark.session import local_session  # noqa: E402

HEADLINES = (
    "category_counts", "findings", "mask_documents", "placeholder_map", "restore_documents", "source_map",
    "mask_pages", "log_findings", "resolved_spans", "merged_spans", "emails", "cards",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # The test tables are files of one row group; a session on one machine may ask for more partitions.
    spark = local_session(cpus, "bench", **{"spark.sql.files.maxPartitionBytes": str(4 << 20), "spark.veilspark.readPartitions": cpus})

    def run(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(run(name), 3)
    chars = {
        "documents": spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0],
        "logs": derived.service_log(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0],
    }
    rate = {
        "findings": round(chars["documents"] / 1e6 / seconds["findings"], 2),
        "mask_documents": round(chars["documents"] / 1e6 / seconds["mask_documents"], 2),
        "log_findings": round(chars["logs"] / 1e6 / seconds["log_findings"], 2),
    }
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "mb_per_second": rate,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
