"""Segment one hot timeline (plus many small ones) with both W8 plans and
report task-time spread from the event log (scratch folder).

usage: python tools/skew_experiment.py [hot_rows]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from reelforge.operators import segments as SEG  # noqa: E402
from reelforge.session import get_session  # noqa: E402


def main() -> None:
    hot = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    logdir = tempfile.mkdtemp(prefix="reelforge-skew-")
    spark = get_session(shuffle_partitions=32, extra={"spark.eventLog.enabled": "true",
                                                      "spark.eventLog.compress": "false",
                                                      "spark.eventLog.dir": logdir})
    # video 0 holds `hot` chunks (as many as all the others together); labels repeat in runs
    n = 2 * hot
    ids = spark.range(n)
    vid = F.when(F.col("id") < hot, F.lit(0)).otherwise(1 + F.col("id") % 1000)
    pos = F.when(F.col("id") < hot, F.col("id")).otherwise(F.floor((F.col("id") - hot) / 1000))
    lab = F.when((F.floor(pos / 7) % 5) == 4, F.lit(None)).otherwise((F.floor(pos / 7) % 5).cast("int"))
    ch = ids.select(vid.alias("video_id"), (pos * 5000).alias("start"), ((pos + 1) * 5000).alias("end"),
                    lab.alias("song_id"), F.when(lab.isNotNull(), (pos % 7).cast("double")).alias("offset_seconds"))
    wall = {}
    # A5 on the same skew: one (video, feature) group holds half of all values
    vals = ids.select(vid.alias("video_id"), F.lit("x").alias("feature"), F.sqrt("id").alias("value"))
    from reelforge.operators.frames import column_stats
    spark.sparkContext.setJobGroup("a5", "a5")
    t0 = time.time()
    cnt = column_stats(vals, ["video_id", "feature"]).count()
    wall["a5"] = (round(time.time() - t0, 2), cnt)
    for strategy in ("window", "blocked"):
        spark.sparkContext.setJobGroup(strategy, strategy)
        t0 = time.time()
        extra = {"dense_position": F.col("start") / 5000} if strategy == "blocked" else {}
        cnt = SEG.segment_timeline(ch, strategy=strategy, **extra).count()
        wall[strategy] = (round(time.time() - t0, 2), cnt)
    spark.stop()
    stage_job, tasks = {}, {}
    for path in [p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        for line in open(path):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerJobStart":
                for s in e.get("Stage IDs", []):
                    stage_job[s] = (e.get("Properties") or {}).get("spark.jobGroup.id")
            elif e.get("Event") == "SparkListenerTaskEnd":
                i = e.get("Task Info", {})
                tasks.setdefault(e["Stage ID"], []).append(i.get("Finish Time", 0) - i.get("Launch Time", 0))
    for strategy in ("window", "blocked", "a5"):
        per_stage = {s: (len(tasks.get(s, [])), max(tasks.get(s, [0]))) for s, g in sorted(stage_job.items())
                     if g == strategy and s in tasks}
        print(strategy, "stage -> (tasks, max ms):", per_stage)
        durs = [d for s, g in stage_job.items() if g == strategy for d in tasks.get(s, [])]
        print(json.dumps({"strategy": strategy, "hot_rows": hot, "wall_s": wall[strategy][0],
                          "result_rows": wall[strategy][1], "tasks": len(durs), "max_task_ms": max(durs),
                          "median_task_ms": statistics.median(durs)}))


if __name__ == "__main__":
    main()
