"""Summarise a Spark event log per job group: jobs, stages, tasks, input,
shuffle write/read bytes, and the largest task vs the median task (skew).

usage: python tools/stage_summary.py <event log file or eventlog_v2_* folder>
"""
import io
import json
import os
import re
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    files = [path]
    if os.path.isdir(path):  # rolling event log: events_<n>_<app>[.zstd]
        files = sorted((os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda f: int(re.match(r".*events_(\d+)_", f).group(1)))
    for fp in files:
        if fp.endswith(".zstd"):
            import zstandard
            with open(fp, "rb") as raw:
                yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
        else:
            with open(fp) as f:
                yield from f


def main(path: str) -> None:
    group_of_job, stage_group = {}, {}
    stats = defaultdict(lambda: {"jobs": 0, "stages": set(), "tasks": 0, "input": 0, "sw": 0, "sr": 0, "dur": []})
    if True:
        for line in _lines(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id", "-")
                group_of_job[e["Job ID"]] = g
                stats[g]["jobs"] += 1
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = g
            elif ev == "SparkListenerTaskEnd":
                g = stage_group.get(e.get("Stage ID"), "-")
                st = stats[g]
                st["stages"].add(e.get("Stage ID"))
                st["tasks"] += 1
                m = e.get("Task Metrics") or {}
                st["input"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                st["sw"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                sr = m.get("Shuffle Read Metrics") or {}
                st["sr"] += sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
                info = e.get("Task Info") or {}
                st["dur"].append(info.get("Finish Time", 0) - info.get("Launch Time", 0))
    mb = 1 << 20
    print(f"{'group':28s} {'jobs':>4s} {'stages':>6s} {'tasks':>6s} {'input MB':>9s} {'shufW MB':>9s} "
          f"{'shufR MB':>9s} {'max/med task':>12s}")
    for g, st in stats.items():
        d = st["dur"] or [0]
        med = statistics.median(d) or 1
        print(f"{g[:28]:28s} {st['jobs']:4d} {len(st['stages']):6d} {st['tasks']:6d} {st['input'] / mb:9.1f} "
              f"{st['sw'] / mb:9.1f} {st['sr'] / mb:9.1f} {max(d) / med:12.1f}")


if __name__ == "__main__":
    main(sys.argv[1])
