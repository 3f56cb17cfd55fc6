"""Slowest stages from a Spark event log (no UI or REST server needed).

Usage: python tools/stage_times.py <event-log file or folder> [top]
"""

from __future__ import annotations

import json
import os
import sys


def _files(path: str):
    if os.path.isfile(path):
        yield path
        return
    for root, _dirs, names in os.walk(path):
        for n in sorted(names):
            if not n.startswith(("appstatus", ".")):
                yield os.path.join(root, n)


def _lines(f: str):
    if f.endswith(".zstd"):
        import io

        import zstandard

        with open(f, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(f) as fh:
            yield from fh


def stages(path: str):
    """(seconds, stage id, tasks, name) of every completed stage (plain, rolling or zstd logs)."""
    for f in _files(path):
        for line in _lines(f):
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                sub, done = info.get("Submission Time"), info.get("Completion Time")
                if sub and done:
                    yield (done - sub) / 1000.0, info["Stage ID"], info["Number of Tasks"], info["Stage Name"]


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = sorted(stages(path), reverse=True)
    total = sum(r[0] for r in rows)
    print(f"{len(rows)} stages, {total:.1f} s of stage time")
    for sec, sid, ntask, name in rows[:top]:
        print(f"{sec:8.2f} s  stage {sid:5d}  tasks {ntask:5d}  {name[:90]}")


if __name__ == "__main__":
    main()
