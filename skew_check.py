"""Skew check: one person holding a third of all rows.

Derives a positions table from the test tables in which every third row
(by a hash of its id) belongs to one person, runs L1 and L5 both ways -
the plain per-person window plans and this package's plans - checks they
give the same rows, and reads Spark's event log to report, per job, the
most records any single task had to read (what one slot does alone, however
many executors there are).

    python skew_check.py [sf_dir] [event_log_dir]

Prints one JSON line.  The event log goes to ``event_log_dir`` (default: a
new temporary folder; this is a local diagnostic, not a cluster job).
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from workpanel.operators.cells import cell_means  # noqa: E402
from workpanel.operators.cohorts import keep_keys, movers  # noqa: E402
from workpanel.operators.expand import expand_years  # noqa: E402
from workpanel.operators.spells import (END, START, backfill_start, close_open,  # noqa: E402
                                        parse_dates)
from workpanel.plans import pipelines as L  # noqa: E402
from workpanel.session import build_session, scratch_path  # noqa: E402
from workpanel.sources import fixtures as fx  # noqa: E402
from workpanel.sources.readers import read_positions  # noqa: E402
from workpanel.sources.writers import write_table  # noqa: E402

AS_OF = "2002-01-01"
HOT_AT_TEST = 10_000


def hot_positions(spark, sf_dir):
    """Every third row goes to person 0, who has jobs in India and the US."""
    p = fx.positions(spark, sf_dir)
    hot = F.xxhash64("position_id") % 3 == 0
    return (p.withColumn("user_id", F.when(hot, F.lit(0)).otherwise(F.col("user_id")))
             .withColumn("country", F.when(hot & (F.xxhash64("position_id") % 2 == 0),
                                           F.lit("India"))
                         .when(hot, F.lit("United States")).otherwise(F.col("country"))))


def plain_clean(p, fallback):
    p = parse_dates(p)
    w = Window.partitionBy("user_id").orderBy(F.col(START).asc_nulls_first(),
                                              F.col(END).asc_nulls_first(), "position_id")
    p = p.withColumn(START, F.coalesce(START, F.lag(END).over(w)))
    return backfill_start(close_open(p, as_of=AS_OF), fallback=fallback)


def plain_l1(P):
    s = plain_clean(P.filter(F.col("country") == "India"), "years:3")
    return cell_means(expand_years(s), ["onet_code", "state", "year"])


def plain_l5(P):
    rows = keep_keys(P, movers(P, "India", "United States"))
    s = plain_clean(rows, "days:1095")
    w = Window.partitionBy("user_id").orderBy(F.col(END).desc_nulls_last(), "position_id")
    home = (s.filter(F.col("country") == "India").withColumn("rn", F.row_number().over(w))
            .filter("rn = 1").select("user_id", F.col("state").alias("last_origin_state")))
    d = s.filter(F.col("country") == "United States").join(home, "user_id", "left")
    return cell_means(expand_years(d, drop_reversed=True),
                      ["onet_code", "last_origin_state", "year"])


def read_events(log_dir):
    import zstandard
    events = []
    for f in sorted(glob.glob(f"{log_dir}/*/events_*")) + sorted(glob.glob(f"{log_dir}/local-*")):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(
                io.BytesIO(raw), read_across_frames=True).read()
        events += [json.loads(line) for line in raw.decode().splitlines() if line]
    return events


def busiest_task(events):
    """({job group: (most records read by one task, that task's ms, its
    stage's total records)}, {job group: longest task ms}): the work one slot
    must do alone, whatever the cluster size."""
    stage_group, tasks = {}, {}
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e["Stage IDs"]:
                stage_group[sid] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            m, i = e.get("Task Metrics") or {}, e["Task Info"]
            recs = (m.get("Input Metrics", {}).get("Records Read", 0)
                    + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
            tasks.setdefault(e["Stage ID"], []).append((recs, i["Finish Time"] - i["Launch Time"]))
    out, longest = {}, {}
    for sid, ts in tasks.items():
        g = stage_group.get(sid)
        if g is None:
            continue
        recs, ms = max(ts)
        if recs > out.get(g, (0,))[0]:
            out[g] = (recs, ms, sum(r for r, _ in ts))
        longest[g] = max(longest.get(g, 0), max(t for _, t in ts))
    return out, longest


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = argv[2] if len(argv) > 2 else tempfile.mkdtemp(prefix="workpanel-events-")
    # Broadcast joins off: at scale the per-person tables exceed the broadcast
    # threshold, so the joins are sort-merge joins on the person key.
    spark = build_session("local[8]", 16, app="workpanel-skew",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.sql.autoBroadcastJoinThreshold": "-1",
                                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    path = write_table(hot_positions(spark, sf_dir).repartition(16), scratch_path(spark, "hot"))
    P = lambda: read_positions(spark, path)
    jobs = {
        "L1_plain": lambda: plain_l1(P()),
        "L1_ours": lambda: L.resident_year(P(), "India", AS_OF),
        "L5_plain": lambda: plain_l5(P()),
        "L5_ours": lambda: L.mover_origin_year(P(), as_of=AS_OF),
        # the hot-row threshold scaled down with the data (default: 10^7 rows)
        "L5_ours_spread": lambda: L.mover_origin_year(P(), as_of=AS_OF, hot_rows=HOT_AT_TEST),
    }
    same = {}
    for job, mine in (("L1", "L1_ours"), ("L5", "L5_ours"), ("L5_spread", "L5_ours_spread")):
        a = sorted(map(str, jobs[f"{job[:2]}_plain"]().collect()))
        b = sorted(map(str, jobs[mine]().collect()))
        same[job] = a == b
    wall = {}
    for name, make in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        t = time.time()
        make().write.format("noop").mode("overwrite").save()
        wall[name] = round(time.time() - t, 3)
    spark.stop()
    busy, longest = busiest_task(read_events(log_dir))
    print(json.dumps({"same_rows": same, "wall_sec": wall, "longest_task_ms": longest,
                      "busiest_task_records": {k: v[0] for k, v in busy.items()},
                      "busiest_task_ms": {k: v[1] for k, v in busy.items()},
                      "its_stage_records": {k: v[2] for k, v in busy.items()},
                      "event_log": log_dir}))


if __name__ == "__main__":
    main(sys.argv)
