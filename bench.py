"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from shelfgrid.queries import spark_queries
from shelfgrid.session import local_session

HEADLINE = (
    "fuse_final_rows", "parse_tag_fields", "boost_with_text", "best_frame_per_window", "nms_detections",
    "track_objects", "match_labels", "summarize_tracks",
)
#: Whole jobs, timed as long as ``START_WITHIN`` seconds have not passed when their turn comes.
JOBS = ("match_catalog", "tags_to_csv", "detect_candidates")
START_WITHIN = 420


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores), app="shelfgrid-bench")
    registered = spark_queries()
    spark.read.parquet(f"{directory}/lineitem.parquet").count()
    times, begun = {}, time.time()
    for name in (*HEADLINE, *JOBS):
        if name not in registered or (name in JOBS and time.time() - begun > START_WITHIN):
            continue
        started = time.time()
        registered[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
