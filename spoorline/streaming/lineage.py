"""Attribution and session life cycle of growing logs, kept as state per run.

A run is a host; its log is one sequence, so it is one key of the stream, and the
hosts spread over the cluster. Every run has its own clock. Rows wait until they
are ``reorder_s`` older than the run's newest one and are then taken in the order of
time, so a result depends on the log alone and not on how it was cut into
micro-batches:

* A LOGGING_START re-anchors the kernel clock; kernel rows before any are dropped.
* A kernel event belongs to the first open session on the way from its pid to its
  parents (`operators.attribution` states the rules). If there is none it waits, and is
  tried again at each audit event for at most ``retry_s`` seconds.
* A SESSION_END takes its place in the sequence. Once the run's clock is ``settle_s`` beyond
  it the session closes and is forgotten: the next event of its pid opens another session.
  Events that come later but lie up to ``late_s`` behind the end are reported as late.
* A session without events for ``idle_s`` closes too, but stays open for more; after
  ``forget_s`` it is forgotten.
* A run that is silent has no clock. Its timer fires ``quiet_s`` after its last rows arrived,
  by the arrival times of all runs; then all that waits is taken and its idle sessions close.
* A DRAIN row (`drain_rows`) takes all that waits and closes every session.

State: parents and sessions are maps in pages of neighbouring keys, as a call for one key costs as much
as a page; held and waiting events are lists, which no run has for longer than the reorder delay and
the retry window. Pages of parents are read as they are needed. In Python a row costs by its columns, so
one text holds what the rules read (`READ`), and another passes through with the event (`BODY`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spoorline.operators.attribution import D_MAX, RETRY_WINDOW_S
from spoorline.schemas import AUDIT_FIELDS, AUDIT_RAW, KERNEL_FIELDS, KERNEL_RAW

PAYLOAD = [f for f in KERNEL_FIELDS + AUDIT_FIELDS if f not in ("pid", "backend_pid")]
_TYPES = {f.name: f.dataType for f in [*AUDIT_RAW.fields, *KERNEL_RAW.fields]}
#: What the rules read of a row, and the fields of its event; each a JSON text.
READ = ["source", "file", "block", "line", "marker", "timestamp", "pid", "backend_pid", "ppid", "session_id"]
BODY = T.StructType([T.StructField(f, _TYPES[f]) for f in ["pid", "backend_pid", *PAYLOAD]])

#: A row on the wall clock; ``rank`` puts kernel rows before audit rows, and marks before both.
EVENT = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("no", T.LongType()),
        T.StructField("id", T.LongType()),
        *[T.StructField(f, T.LongType()) for f in ("pid", "backend_pid", "ppid", "session_id")],
        T.StructField("body", T.StringType()),
    ]
)
TS, RANK, NO, ID, PID, BACKEND, PPID, SID, TEXT = range(len(EVENT))
MARK, KERNEL, AUDIT = -1, 0, 1

#: What the stream gives: events of sessions, and what becomes of sessions.
MOVES = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # event, late, close, clock
        T.StructField("run_id", T.StringType()),
        T.StructField("session_key", T.LongType()),
        T.StructField("opened", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("resolved_at", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp_unix", T.DoubleType()),
        T.StructField("reason", T.StringType()),  # of a close: end, idle, drain, forgotten
        T.StructField("n_events", T.LongType()),
        T.StructField("body", T.StringType()),
    ]
)
_MOVE = Row(*MOVES.names)
#: Neighbouring keys of a map state that are read and written together, as a power of two.
PAGE_BITS = 8


@dataclass(frozen=True)
class Rules:
    reorder_s: float = 1.0
    retry_s: float = RETRY_WINDOW_S
    #: After a SESSION_END, beyond the reorder delay.
    settle_s: float = 0.5
    late_s: float = 5.0
    idle_s: float = 60.0
    forget_s: float = 86_400.0
    quiet_s: float = 60.0
    d_max: int = D_MAX


class _Pages:
    """A map state in pages: read page by page as needed, or all at once, and written at the end of a call."""

    def __init__(self, state, whole: bool = False):
        self.state, self.whole, self.pages, self.changed = state, whole, {}, set()
        if whole:
            for (no,), page in state.iterator():
                self.pages[no] = self._rows(page)

    @staticmethod
    def _rows(page) -> dict:
        keys, *columns = page
        return dict(zip(keys, zip(*columns, strict=True), strict=True))

    def _page(self, no):
        page = self.pages.get(no)
        if page is None:
            stored = None if self.whole else self.state.getValue((no,))
            page = self.pages[no] = self._rows(stored) if stored else {}
        return page

    def get(self, key):
        return self._page(key and key >> PAGE_BITS).get(key)

    def set(self, key, value):
        no = key and key >> PAGE_BITS
        page = self._page(no)
        if page.get(key) != value:
            if value is None:
                del page[key]
            else:
                page[key] = value
            self.changed.add(no)

    def items(self):
        return [item for page in self.pages.values() for item in page.items()]

    def flush(self):
        for no in self.changed:
            page = self.pages[no]
            if page:
                self.state.updateValue((no,), (list(page), *map(list, zip(*page.values(), strict=True))))
            else:
                self.state.removeKey((no,))


class Lineage(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # offset of the kernel clock, a start mark that waits for its first event, newest and
        # current time of the run, next event number, next row number, timer
        self.clock = handle.getValueState(
            "clock", "offset double, start double, newest double, now double, next_id long, next_no long, timer long"
        )
        self.parents = handle.getMapState("parents", "page long", "pids array<long>, ppids array<long>")
        # of each open session: first event, time of its newest one, events, whether it closed as idle
        self.sessions = handle.getMapState(
            "sessions",
            "page long",
            "session_keys array<long>, opened array<long>, last_ts array<double>, n_events array<long>, idle array<boolean>",
        )
        # ends that settle, and ends of closed sessions while an event may still be late
        self.ends = handle.getMapState(
            "ends", "page long", "session_keys array<long>, end_ts array<double>, closed array<boolean>"
        )
        self.held = handle.getListState("held", EVENT)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        call = _Call(self, key[0])
        arrived, taken = None, []
        for r in rows:
            arrived = r.arrival if arrived is None else max(arrived, r.arrival)
            taken.append((json.loads(r.text), r.body))
        for fields, body in sorted(taken, key=lambda t: (t[0]["file"], t[0]["block"], t[0]["line"])):
            call.receive(fields, body)
        yield from call.release(call.newest - self.rules.reorder_s)
        if call.draining:
            yield from call.drain()
        if call.timer:
            self.handle.deleteTimer(call.timer)
        call.timer = int(arrived.timestamp() * 1000) + int(self.rules.quiet_s * 1000)
        self.handle.registerTimer(call.timer)
        yield from call.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        call = _Call(self, key[0])
        call.timer = 0
        yield from call.release(call.newest)
        yield from call.silent()
        yield from call.save()

    def close(self) -> None:
        pass


class _Call:
    """One call for a run: its state in memory."""

    def __init__(self, of: Lineage, run: str):
        self.of, self.rules, self.run = of, of.rules, run
        clock = of.clock.get()  # none: null or nothing, without a call to ask first
        low = float("-inf")
        self.offset, self.start, self.newest, self.now, self.next_id, self.next_no, self.timer = (
            tuple(clock) if clock else (None, None, low, low, 0, 0, 0)
        )
        self.parents = _Pages(of.parents)
        self.sessions, self.ends = _Pages(of.sessions, whole=True), _Pages(of.ends, whole=True)
        self.held, self.waiting = ([tuple(e) for e in state.get()] for state in (of.held, of.waiting))
        self.had = bool(self.held), bool(self.waiting)
        self.draining = False
        self.due = low

    # -- rows as they arrive

    def receive(self, r: dict, body: str) -> None:
        """A row as its `READ` fields, nulls left out, and the text of its event."""
        no, self.next_no = self.next_no, self.next_no + 1
        kernel = r["source"] == "kernel"
        marker, backend = r.get("marker"), r.get("backend_pid")
        if marker is not None:
            if marker == "DRAIN":
                self.draining = True
            elif kernel and marker == "LOGGING_START":
                self.start = float(r["timestamp"])
            elif kernel and marker == "SESSION_END":
                self._hold((float(r["timestamp"]), MARK, no, -1, None, backend, None, None, None))
            return
        if kernel:
            seconds = int(r["timestamp"]) / 1e9
            if self.start is not None:
                self.offset, self.start = self.start - seconds, None
            if self.offset is None:
                return  # cannot be placed in time
            ts, rank, pid = seconds + self.offset, KERNEL, r.get("pid")
        else:
            ts, rank, pid = float(r["timestamp"]), AUDIT, backend
        self._hold((ts, rank, no, -1, pid, backend, r.get("ppid"), r.get("session_id"), body))

    def _hold(self, event: tuple) -> None:
        self.held.append(event)
        self.newest = max(self.newest, event[TS])

    # -- rows in the order of time

    def release(self, until: float) -> Iterator[Row]:
        ready = sorted((e for e in self.held if e[TS] <= until), key=lambda e: e[: NO + 1])
        self.held = [e for e in self.held if e[TS] > until]
        for e in ready:
            self.now = max(self.now, e[TS])
            yield from self.life_cycle()
            if e[RANK] == MARK:
                self.ends.set(e[BACKEND], (e[TS], False))
                self.due = float("-inf")
                continue
            e = (*e[:ID], self.next_id, *e[ID + 1 :])
            self.next_id += 1
            if e[RANK] == AUDIT:
                yield from self.attach(e[SID] if e[SID] is not None else e[PID], e, e[ID])
                yield from self.retry(e)
            else:
                if e[PID] and e[PPID]:
                    self.parents.set(e[PID], (e[PPID],))
                found = self.walk(e[PID])
                if found is None:
                    self.waiting.append(e)
                else:
                    yield from self.attach(found, e, e[ID])

    def walk(self, pid: int | None) -> int | None:
        for _ in range(self.rules.d_max):
            if not pid:
                return None
            if self.sessions.get(pid) is not None:
                return pid
            up = self.parents.get(pid)
            pid = up[0] if up else None
        return None

    def retry(self, audit: tuple) -> Iterator[Row]:
        still = []
        for e in self.waiting:
            if audit[TS] - e[TS] > self.rules.retry_s:
                continue
            found = self.walk(e[PID])
            if found is None:
                still.append(e)
            else:
                yield from self.attach(found, e, audit[ID])
        self.waiting = still

    def attach(self, key: int, e: tuple, at: int) -> Iterator[Row]:
        end = self.ends.get(key)
        if end is not None and end[1] and e[TS] <= end[0] + self.rules.late_s:
            yield self.row("late", key, None, e[ID], at, e[TS], "end", None)
        opened, last, n, _ = self.sessions.get(key) or (e[ID], float("-inf"), 0, False)
        self.sessions.set(key, (opened, max(last, e[TS]), n + 1, False))
        self.due = min(self.due, e[TS] + self.rules.idle_s)
        source = "postgres" if e[RANK] == AUDIT else "kernel"
        yield self.row("event", key, opened, e[ID], at, e[TS], None, None, source, e)

    def life_cycle(self) -> Iterator[Row]:
        """Closes all that is due at the run's clock, in the order of the times at which it is due."""
        if self.now < self.due:
            return
        r, due = self.rules, []
        for key, (end, closed) in self.ends.items():
            if not closed and end + r.settle_s < self.now:
                due.append((end + r.settle_s, "end", key))
            elif closed and end + r.late_s + r.retry_s < self.now:
                self.ends.set(key, None)
        for key, (_, last, _, idle) in self.sessions.items():
            if not idle and last + r.idle_s <= self.now:
                due.append((last + r.idle_s, "idle", key))
            elif idle and last + r.forget_s <= self.now:
                due.append((last + r.forget_s, "forgotten", key))
        for _, reason, key in sorted(due):
            yield from self.close(key, reason)
        self.due = self.next_due()

    def next_due(self) -> float:
        r, times = self.rules, [float("inf")]
        times += [end + (r.late_s + r.retry_s if closed else r.settle_s) for _, (end, closed) in self.ends.items()]
        times += [last + (r.forget_s if idle else r.idle_s) for _, (_, last, _, idle) in self.sessions.items()]
        return min(times)

    def close(self, key: int, reason: str) -> Iterator[Row]:
        end, session = self.ends.get(key), self.sessions.get(key)
        if reason == "end":
            self.ends.set(key, (end[0], True))
        if session is None:
            return
        opened, last, n, idle = session
        if reason in ("idle", "drain"):
            self.sessions.set(key, (opened, last, n, True))
        else:
            self.sessions.set(key, None)
        yield self.row("close", key, opened, self.next_id, None, last, reason, n)

    def silent(self) -> Iterator[Row]:
        """Nothing has come for long: sessions are idle by the arrival of other runs' rows."""
        for key, (_, _, _, idle) in sorted(self.sessions.items()):
            if not idle:
                yield from self.close(key, "idle")

    def drain(self) -> Iterator[Row]:
        yield from self.release(float("inf"))
        for key, (end, closed) in sorted(self.ends.items()):
            if not closed:
                yield from self.close(key, "end")
        for key, (_, _, _, idle) in sorted(self.sessions.items()):
            if not idle:
                yield from self.close(key, "drain")

    # -- results

    def row(self, kind, key, opened, event_id, at, ts, reason, n, source=None, e=None) -> Row:
        return _MOVE(kind, self.run, key, opened, event_id, at, source, ts, reason, n, e and e[TEXT])

    def save(self) -> Iterator[Row]:
        for m in (self.parents, self.sessions, self.ends):
            m.flush()
        for state, now, had in ((self.of.held, self.held, self.had[0]), (self.of.waiting, self.waiting, self.had[1])):
            if now:
                state.put(now)
            elif had:
                state.clear()
        clock = (self.offset, self.start, self.newest, self.now, self.next_id, self.next_no, self.timer)
        self.of.clock.update(clock)
        yield self.row("clock", None, None, self.next_id, None, self.now, None, None)


def numbered_lines(stream: DataFrame) -> DataFrame:
    """Adds ``line``: rows of a file block in their order, before a shuffle loses it."""
    schema = T.StructType([*stream.schema.fields, T.StructField("line", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            lines = pa.array(np.arange(seen, seen + b.num_rows))
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, lines], names=[*b.schema.names, "line"])

    return stream.mapInArrow(task, schema)


def follow(stream: DataFrame, rules: Rules = Rules(), arrival: F.Column | None = None) -> DataFrame:
    """Moves of a stream of raw rows (`streaming.live.raw_stream`); appends, needs RocksDB state.

    They are `MOVES` with the fields of `BODY` in place of the text. ``arrival`` is the time at which a
    row came, by default that of its micro-batch. It never runs behind, so no row is too late for it; it
    only serves the timers of silent runs.
    """
    body = F.to_json(F.struct(*BODY.names)).alias("body")
    read = [c for c in READ if c != "line"]
    lines = numbered_lines(stream.where("_corrupt_record IS NULL").select("run_id", *read, body))
    arrival = F.current_timestamp() if arrival is None else arrival
    arrived = lines.select("run_id", F.to_json(F.struct(*READ)).alias("text"), "body", arrival.alias("arrival"))
    moves = (
        arrived.withWatermark("arrival", "0 seconds")
        .groupBy("run_id")
        .transformWithState(Lineage(rules), MOVES, "Append", "EventTime")
    )
    # as rows of a generator: fields of one plain column would parse the text again, each for itself
    fields = F.inline(F.array(F.from_json("body", BODY)))
    pid = F.when(F.col("source") == "postgres", F.col("backend_pid")).otherwise(F.col("pid")).alias("pid")
    return moves.select("*", fields).select(*MOVES.names[:-1], pid, "backend_pid", *PAYLOAD)
