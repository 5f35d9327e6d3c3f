"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is written to the no-op sink, once to warm up and then --runs times (1 by default); the median counts.
--duckdb adds DuckDB's times for the same rows, --all takes every relational query.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import time

from skarn import queries, session

HEADLINE = [
    "dist_join", "agg_group", "agg_two_phase", "agg_distinct", "join_hash", "join_sort_merge", "join_right", "join_semi", "join_anti",
    "scan_bitmap", "scan_page_range", "sort_multi", "topn_desc", "kv_batch", "kv_upsert", "intersect_bag", "except_bag", "null_handling", "stats_mcv", "dml_update",
]


def main() -> None:
    flags = argparse.ArgumentParser()
    flags.add_argument("--runs", type=int, default=1)
    flags.add_argument("--duckdb", action="store_true")
    flags.add_argument("--all", action="store_true")
    given = flags.parse_args()
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", "skarn-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times, beside = {}, {}
    for name in sorted(queries.queries()) if given.all else HEADLINE:
        made = queries.queries()[name]
        taken = []
        for _ in range(given.runs + 1):
            begin = time.perf_counter()
            made(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken[1:]), 3)
    if given.duckdb:
        import duckdb

        base = duckdb.connect(config={"threads": int(cpus)})
        for t in "region nation customer supplier part orders lineitem events".split():
            base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        for name in times:
            begin = time.perf_counter()
            base.execute(queries.oracle_sql()[name]).fetchall()
            beside[name] = round(time.perf_counter() - begin, 3)
    out = {"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out | ({"duckdb": beside} if beside else {})))
    spark.stop()


if __name__ == "__main__":
    main()
