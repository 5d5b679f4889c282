"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

The tables come as one row group each, which is one task. Large tables have many, so an untimed copy of
several files is read instead; BENCH_AS_IS=1 reads the tables as they are.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from freightlens.plans import all_queries
from freightlens.session import local_session

HEADLINE = [
    "agg_supplier_profile",
    "agg_route_profile",
    "inv_amount_deviation",
    "inv_amount_discrepancy",
    "inv_duplicate_id",
    "inv_duplicate_pattern",
    "shp_transit_deviation",
    "shp_combined_risk",
    "detect_all",
    "agg_anomaly_summary",
    "unify_updates",
    "ext_invoice_fields",
    "rel_edges",
    "causal_links",
    "join_causal_interval",
    "causal_chains",
    "causal_potential_causes",
    "join_events_window",
    "join_knn",
    "topk_context",
    "answer_aggregate",
    "src_invoice_csv",
    "sink_anomaly_store",
    "st_stateless_rules",
]


FILES = 32  # files of a copied table


def copied(spark, sf_dir: str) -> str:
    """The tables as several files each, in a folder of their own."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(FILES).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()[0]
    names = sys.argv[1:] or HEADLINE
    folder = sf_dir if os.environ.get("BENCH_AS_IS") else copied(spark, sf_dir)
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start-up is not part of any query
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        # the noop sink makes every column, which a count would let the optimizer skip
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
