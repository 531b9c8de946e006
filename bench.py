"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query is written to the noop sink, so every column of every row is computed.  The
time of a query includes its planning and code generation.
"""

import json
import os
import sys
import time

from checks.registry import QUERIES

import checks.all  # noqa: F401  registers the queries

HEADLINES = [
    "import_products",
    "row_findings",
    "peer_stats",
    "nutrient_bands",
    "phrase_detection",
    "search_products",
    "incremental_upsert",
    "scan_enrichment",
    "assemble_products",
    "lookup_products",
]


def main():
    from larder.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    # Files are small here; split them so that every core has work.
    spark = local_session(
        cpus, shuffle_partitions=cpus, memory="12g",
        **{
            "spark.sql.files.maxPartitionBytes": "1m",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    seconds = {}
    for name in HEADLINES:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
