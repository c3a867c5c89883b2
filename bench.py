"""Headline benchmark: prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPEAT (default 3; median reported after one warm-up),
BENCH_EVENT_LOG (optional folder for Spark's event log: stage/task times).
Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from authornet.plans import catalog  # noqa: E402
from authornet.session import get_spark, scratch_path  # noqa: E402
from authornet.sources.tables import TABLES  # noqa: E402

HEADLINE = {
    "q1_clean": "p11_drop_emptied",
    "q2_message_features": "t_all_features",
    "q3_lexicon_inline": "l8_lexicon_rates",
    "q4_lexicon_join": "l10_pivot_rates",
    "q5_author_group_table": "a1_author_group_full",
    "q6_author_table": "a2_author_features",
    "q7_graph_edges": "g1_membership_graph",
    "q8_transition_t2": "g9_transition",
    "q9_attention_layer": "n4_attend",
    "q10_soft_assign": "n9_soft_assign",
    "q11_spearman": "d1_spearman",
    "q12_degree": "g5_degree",
    "q13_scored_authors": "n13_scored_authors",
}


def in_files(spark, sf: str, files: int) -> str:
    """The tables as a cluster would hold them: the large ones in several files
    (the given ones are single row groups, which one task would read)."""
    out = scratch_path(spark, "bench")
    for t in TABLES:
        df = spark.read.parquet(f"{sf.rstrip('/')}/{t}.parquet")
        (df.repartition(files) if df.count() > 1000 else df).write.parquet(f"{out}/{t}.parquet")
    return out


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):  # stage/task times for later inspection
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), extra=extra)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    sf = in_files(spark, sf, 2 * cpus)
    times = {}
    for label, name in HEADLINE.items():
        run_once(spark, name, sf)  # warm-up
        times[label] = round(statistics.median(run_once(spark, name, sf) for _ in range(repeat)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": cpus, "repeat": repeat}))


if __name__ == "__main__":
    main()
