"""Hand-made event logs, and a literal replay to compare the jobs with."""

from spoorline.schemas import AUDIT_FIELDS, KERNEL_FIELDS

FIELDS = ["run_id", "event_id", "source", "timestamp_unix"] + sorted({*KERNEL_FIELDS, *AUDIT_FIELDS})
NUMBERS = {
    "event_id", "pid", "ppid", "uid", "dest_port", "session_id", "session_start_time", "backend_pid",
}
SCHEMA = ", ".join(
    f"{f} {'double' if f == 'timestamp_unix' else 'long' if f in NUMBERS else 'string'}" for f in FIELDS
)


def k(ts, pid, ppid=0, syscall="execve", run="r", **more):
    return dict(run_id=run, source="kernel", timestamp_unix=float(ts), pid=pid, ppid=ppid,
                syscall=syscall, comm=more.pop("comm", "sh"), arg=more.pop("arg", "a"), **more)


def a(ts, sid, query="SELECT 1", event_type="ExecutorStart", run="r", **more):
    return dict(run_id=run, source="postgres", timestamp_unix=float(ts), pid=sid, session_id=sid,
                event_type=event_type, query=query, **more)


def numbered(rows):
    """Stable time order per run, kernel before audit on equal times."""
    out = []
    for run in sorted({r["run_id"] for r in rows}):
        mine = [r for r in rows if r["run_id"] == run]
        mine.sort(key=lambda r: (r["timestamp_unix"], r["source"] == "postgres"))
        out += [dict(r, event_id=i) for i, r in enumerate(mine)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], SCHEMA)


def replay(rows, d_max=8, window=20.0):
    """Pairs (run, event, session) by stepping through the log."""
    out = {}
    for run in {r["run_id"] for r in rows}:
        active, parent, waiting = set(), {}, []

        def trace(pid):
            for _ in range(d_max):
                if not pid:
                    return None
                if pid in active:
                    return pid
                pid = parent.get(pid)
            return None

        for r in (x for x in rows if x["run_id"] == run):
            if r["source"] == "kernel":
                if r["pid"] and r.get("ppid"):
                    parent[r["pid"]] = r["ppid"]
                found = trace(r["pid"])
                if found is None:
                    waiting.append(r)
                else:
                    out[run, r["event_id"]] = found
                continue
            active.add(r["session_id"])
            out[run, r["event_id"]] = r["session_id"]
            still = []
            for w in waiting:
                if r["timestamp_unix"] - w["timestamp_unix"] > window:
                    continue
                found = trace(w["pid"])
                if found is None:
                    still.append(w)
                else:
                    out[run, w["event_id"]] = found
            waiting = still
    return out
