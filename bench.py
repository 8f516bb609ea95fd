"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once at a tenth of the scale (which warms up, and shows the growth) and then up to
``BENCH_RUNS`` times, all queries in turn; no new turn begins after ``BENCH_SECONDS``. Medians are reported,
with the number of turns. Results go to a sink that keeps nothing, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from jobweave.catalog.queries import QUERIES  # noqa: E402
from jobweave.session import get_session  # noqa: E402

HEADLINE = [
    "salary_per_month",
    "experience_numeric",
    "other_requirement",
    "classified_segments",
    "frequent_phrases",
    "skill_counts",
    "skill_edges",
    "skill_merge_preview",
    "merged_job_skills",
    "tag_vectors",
    "weighted_features",
    "silhouette_scores",
    "clustered_embeddings",
    "cluster_profiles",
    "mutual_information",
    "skill_impact",
    "skill_value_robust",
    "key_figures",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    limit = float(os.environ.get("BENCH_SECONDS", "360"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    begun = time.perf_counter()

    def once(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - start, 3)
        print(f"{name} {folder}: {took}", file=sys.stderr, flush=True)
        return took

    small = Path(sf_dir).parent / f"sf{float(Path(sf_dir).name.removeprefix('sf')) / 10:g}"
    warm = str(small) if small.exists() else sf_dir
    small_times = {name: once(name, warm) for name in names}
    turns: list[dict[str, float]] = []
    while len(turns) < runs and (not turns or time.perf_counter() - begun < limit):
        turns.append({name: once(name, sf_dir) for name in names})
    times = {name: round(statistics.median(t[name] for t in turns), 3) for name in names}
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
                "runs": len(turns), "warm_up": {"sf": Path(warm).name.removeprefix("sf"), "queries": small_times},
            }
        )
    )


if __name__ == "__main__":
    main()
