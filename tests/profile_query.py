"""Per-job timings of one registered query from Spark's event log.

    python tests/profile_query.py <query> [sf_dir]

The event log goes to a fresh scratch folder (mktemp); the query runs twice
(warm-up, then measured under a job group) with a noop sink, and the jobs of
the measured run are printed with their durations.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def read_events(log_dir: str):
    for path in sorted(glob.glob(os.path.join(log_dir, "*", "events_*")) + glob.glob(os.path.join(log_dir, "*.zstd"))):
        raw = open(path, "rb").read()
        if path.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            if line.strip():
                yield json.loads(line)


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from vigil.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    import __spark_entry__ as E
    q = E.queries()[name]
    q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("measured", name)
    t = time.perf_counter()
    q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    total = time.perf_counter() - t
    spark.stop()
    jobs = {}
    for e in read_events(log_dir):
        if e["Event"] == "SparkListenerJobStart":
            stages = e.get("Stage Infos", [])
            jobs[e["Job ID"]] = {"start": e["Submission Time"],
                                 "group": e.get("Properties", {}).get("spark.jobGroup.id"),
                                 "stages": len(stages), "name": stages[-1]["Stage Name"][:70] if stages else ""}
        elif e["Event"] == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["ms"] = e["Completion Time"] - jobs[e["Job ID"]]["start"]
    measured = [(k, v) for k, v in sorted(jobs.items()) if v["group"] == "measured"]
    for k, v in measured:
        print(f"job {k:4d} {v.get('ms', 0):7d} ms  {v['stages']} stage(s)  {v['name']}")
    in_jobs = sum(v.get("ms", 0) for _, v in measured) / 1000
    print(f"total {total:.2f} s, in jobs {in_jobs:.2f} s, driver-side {total - in_jobs:.2f} s (log: {log_dir})")


if __name__ == "__main__":
    main()
