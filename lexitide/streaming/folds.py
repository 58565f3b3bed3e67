"""Ordered folds by key, as Structured Streaming operators and as batch jobs over the same step functions.

A fold is an initial state (a dict of numbers, strings and flags, at most one short list) and a step ``(state, row) -> rows``;
the step changes the state. A fold may also act without a row: ``due`` names the next time at which it wants to, and ``tick``
is what it does then.

In a stream with event time, rows wait in a list state until the watermark passes them and are then taken in order, so what
comes out does not depend on how rows are spread over micro-batches. Rows travel and wait as Arrow cells. One timer a key, or a
group of keys, wakes it for the next waiting row, the next ``due`` time, or its end: a key without rows for ``idle_ms`` gives
what is left of it, and nothing of it stays in the store. Rows behind the watermark come out as late ones. The batch form runs the same course over a sorted table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegralType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lexitide.functions import rules as R
from lexitide.functions.text import tidied

LIMIT_BYTES = 2048 * 1024 * 1024
#: Folded streams need a store with column families.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_NO_TIME = 1 << 62


@dataclass(frozen=True)
class Fold:
    key: str
    order: tuple[str, ...]
    output: str  # DDL, the key first
    state: str  # DDL of the state's values, in the order of ``initial``
    initial: dict
    step: Callable[[dict, dict], list[tuple]]
    last: Callable[[dict], list[tuple]] = lambda state: []  # what is left when a key ends
    due: Callable[[dict], int | None] = lambda state: None  # ms
    tick: Callable[[dict, int], list[tuple]] = lambda state, now: []
    items: tuple[str, str] | None = None  # name in ``initial`` and DDL of a list of tuples


class _Course:
    """A key's course: rows in order, and what is due between them. A due time goes before a later row, an end before a due time."""

    def __init__(self, fold: Fold, idle_ms: int | None, state: dict | None = None, seen: int = 0):
        self.fold, self.idle_ms, self.state, self.seen = fold, idle_ms, state, seen

    def wake(self) -> int:
        """The next time at which something is due."""
        if self.state is None:
            return _NO_TIME
        due = self.fold.due(self.state)
        return min(_NO_TIME if due is None else due, self.seen + self.idle_ms if self.idle_ms else _NO_TIME)

    def until(self, now: int) -> list[tuple]:
        out: list[tuple] = []
        while (at := self.wake()) < now:
            if self.idle_ms and at == self.seen + self.idle_ms:
                out += self.fold.last(self.state)
                self.state = None
            else:
                out += self.fold.tick(self.state, at)
        return out

    def step(self, row: dict, now: int) -> list[tuple]:
        out = self.until(now)
        if self.state is None:
            self.state = deepcopy(self.fold.initial)
        self.seen = now
        return out + self.fold.step(self.state, row)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _values(fold: Fold) -> list[str]:
    return [n for n in fold.initial if not fold.items or n != fold.items[0]]


class _States:
    """A key's state in the store: a row of values, and a list to which is appended where it only grows."""

    def __init__(self, fold: Fold, handle: StatefulProcessorHandle):
        self.fold, self.names = fold, _values(fold)
        self.values = handle.getValueState("state", fold.state)
        self.items = handle.getListState("items", fold.items[1]) if fold.items else None

    def load(self) -> dict | None:
        if not self.values.exists():
            return None
        state = dict(zip(self.names, self.values.get()))
        if self.items:
            state[self.fold.items[0]] = [tuple(x) for x in self.items.get()] if self.items.exists() else []
        self.loaded = list(state[self.fold.items[0]]) if self.items else []
        return state

    def store(self, state: dict) -> None:
        self.values.update(tuple(state[n] for n in self.names))
        if self.items:
            held, n = state[self.fold.items[0]], len(getattr(self, "loaded", []))
            if n and held[:n] == self.loaded:
                if held[n:]:
                    self.items.appendList(held[n:])
            elif held:
                self.items.put(held)
            else:
                self.items.clear()
            self.loaded = []


class _Arriving(StatefulProcessor):
    """Rows in the order of their micro-batches."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = _States(self.fold, handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.states.load() or deepcopy(self.fold.initial)
        frame = pd.concat(list(rows)).sort_values(list(self.fold.order))
        out = [(key[0], *r) for row in frame.to_dict("records") for r in self.fold.step(state, row)]
        self.states.store(state)
        yield pd.DataFrame(out, columns=_names(self.fold.output))

    def close(self) -> None:
        pass


PACKED_ROWS, OUT_ROWS = 1 << 18, 1 << 14


def _bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a group, the first column, as one cell for up to ``PACKED_ROWS`` rows of the task."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        table, starts = table.take(pa.array(order)), np.flatnonzero(np.diff(codes[order], prepend=-1))
        rows = table.remove_column(0)
        cells = [_bytes(rows.slice(at, n)) for at, n in zip(starts, np.diff(starts, append=len(codes)))]
        return pa.RecordBatch.from_arrays([table.column(0).take(pa.array(starts)).combine_chunks(), pa.array(cells, pa.binary())], names=[table.schema.names[0], "rows"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACKED_ROWS:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


class _InOrder(StatefulProcessor):
    """Rows in the order of event time, whatever micro-batch brought them. What the store has under a key is of a group of keys."""

    def __init__(self, fold: Fold, rows: StructType, ts: str, idle_ms: int):
        self.fold, self.ts, self.idle_ms, self.values = fold, ts, idle_ms, _values(fold)
        self.names = [*_names(fold.output), "late"]
        items = [StructField(fold.items[0], ArrayType(StructType.fromDDL(fold.items[1])))] if fold.items else []
        own = StructType([StructField("key", rows[fold.key].dataType), StructField("seen", LongType()), *StructType.fromDDL(fold.state), *items])
        self.kept = StructType([StructField("keys", ArrayType(own))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.keys = handle.getValueState("state", "wake long"), handle.getValueState("keys", self.kept)
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = watermark * 1000 if watermark else -_NO_TIME  # it is 0 as long as there is none
        good, late, first = [], [], _NO_TIME
        for frame in rows:
            for cell in frame["rows"]:
                table = pa.ipc.open_stream(cell).read_all()
                ahead = pc.fill_null(pc.greater(table[self.ts], passed), False)
                kept, lost = table.filter(ahead), table.filter(pc.invert(ahead))
                if kept.num_rows:
                    good.append((_bytes(kept) if lost.num_rows else cell,))
                    first = min(first, pc.min(kept[self.ts]).as_py())
                late += zip(lost[self.fold.key].to_pylist(), lost[self.ts].to_pylist())
        if good:
            self.waiting.appendList(good)
            was, at = self.state.get()[0] if self.state.exists() else 0, max(1, -(-first // 1000))
            if not was or at < was:
                self._wake(was, at)
        none = (None,) * (len(self.names) - 2)
        yield self._out([(k, *none, None if us is None else pd.Timestamp(us, unit="us")) for k, us in late])

    def _wake(self, was: int, at: int) -> None:
        """One timer a group, at its next time."""
        if was:
            self.handle.deleteTimer(was)
        self.handle.registerTimer(at)
        self.state.update((at,))

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names, dtype=object)

    def _courses(self) -> dict:
        courses = {}
        for key, seen, *own in self.keys.get()[0] if self.keys.exists() else ():
            state = dict(zip(self.values, own))
            if self.fold.items:
                state[self.fold.items[0]] = [tuple(x) for x in own[-1]]
            courses[key] = _Course(self.fold, self.idle_ms, state, seen)
        return courses

    def _keep(self, courses: dict) -> None:
        names = [*self.values, *([self.fold.items[0]] if self.fold.items else [])]
        kept = [(key, c.seen, *(c.state[n] for n in names)) for key, c in courses.items() if c.state is not None]
        if kept:
            self.keys.update((kept,))
        else:
            self.keys.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, courses, out = timerValues.getCurrentWatermarkInMs(), self._courses(), []
        first = _NO_TIME
        cells = [pa.ipc.open_stream(cell).read_all() for (cell,) in self.waiting.get()] if self.waiting.exists() else []
        if cells:
            rows = pa.concat_tables(cells)
            ready = pc.less_equal(rows[self.ts], now * 1000)
            rows, left = rows.filter(ready), rows.filter(pc.invert(ready))
            if left.num_rows:
                first = -(-pc.min(left[self.ts]).as_py() // 1000)
            if rows.num_rows:
                self.waiting.put([(_bytes(left),)]) if left.num_rows else self.waiting.clear()
                order = [(c, "ascending") for c in (self.fold.key, *self.fold.order)]
                rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
                for row in _dicts(rows):
                    own, us = row[self.fold.key], row[self.ts]
                    if (course := courses.get(own)) is None:
                        course = courses[own] = _Course(self.fold, self.idle_ms)
                    row[self.ts] = pd.Timestamp(us, unit="us")
                    out += [(own, *r, None) for r in course.step(row, _nearest_ms(us))]
                    if len(out) >= OUT_ROWS:
                        yield self._out(out)
                        out = []
        for own, course in courses.items():
            out += [(own, *r, None) for r in course.until(now)]
            first = min(first, course.wake() + 1)
            if len(out) >= OUT_ROWS:
                yield self._out(out)
                out = []
        self._keep(courses)
        if first < _NO_TIME:
            self.handle.registerTimer(max(1, first))
            self.state.update((max(1, first),))
        else:
            self.state.clear()
        yield self._out(out)

    def close(self) -> None:
        pass


def _dicts(rows: pa.Table) -> Iterator[dict]:
    names = rows.schema.names
    for batch in rows.to_batches(max_chunksize=OUT_ROWS):
        for values in zip(*[c.to_pylist() for c in batch.columns]):
            yield dict(zip(names, values))


def fold_stream(rows: DataFrame, fold: Fold, ts: str | None = None, late: str = "10 minutes", idle_ms: int = 0, groups: int | None = None) -> DataFrame:
    """The fold over a stream; the state store provider must be RocksDB's (``ROCKS``).

    Without ``ts`` rows count as they arrive. With a timestamp column ``ts`` they count in its order once the watermark, ``late``
    behind the latest, has passed them; ``ts`` must be the first of ``order``, or agree with it. Column ``late`` is added: the
    time of a row that came behind the watermark (or has none), whose other columns but the key are null.

    ``groups``: keys are dealt by hash into so many groups, and the store has an entry and a timer for each group. Where there
    are very many keys with few rows each, that saves nearly all calls to the store. A micro-batch reads and writes the states of
    all live keys of the groups that it touches, and a task holds a group's waiting rows; the number is fixed with the checkpoint.
    """
    if ts is None:
        return rows.groupBy(fold.key).transformWithStateInPandas(_Arriving(fold), outputStructType=fold.output, outputMode="Append", timeMode="None")
    # The time travels as a number, which the engine does not hold against the watermark: late rows reach the processor.
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(*[F.unix_micros(ts).alias(c) if c == ts else F.col(c) for c in rows.columns])
    group, name = (F.pmod(F.xxhash64(fold.key), F.lit(groups)), "group") if groups else (F.col(fold.key), fold.key)
    kind = StructType([StructField(name, LongType() if groups else timed.schema[fold.key].dataType), StructField("rows", BinaryType())])
    packed = timed.select(group.alias("__group"), *timed.columns).mapInArrow(_packs, StructType([StructField("__group", kind[0].dataType), kind[1]])).withColumnRenamed("__group", name)
    return packed.groupBy(name).transformWithStateInPandas(_InOrder(fold, timed.schema, ts, idle_ms), outputStructType=f"{fold.output}, late timestamp", outputMode="Append", timeMode="EventTime")


def stream_fold(rows: DataFrame, fold: Fold, path: str, checkpoint: str, ts: str = "ts", late: str = "10 minutes", idle_ms: int = 24 * 3600 * 1000, groups: int | None = None):
    """A fold by event time whose rows go to the table ``path``, and its late rows, counted by key and time, to ``path`` + ``_late``.

    Both are committed under the number of the micro-batch, so one that is run again adds nothing.
    """
    from lexitide.sources.tables import VersionedTable

    folded = fold_stream(rows, fold, ts, late, idle_ms, groups)
    lost = StructType([f for f in folded.schema if f.name in (fold.key, "late")]).add("n", "long")
    kept = StructType([f for f in folded.schema if f.name != "late"])

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        VersionedTable(spark, path, kept, fold.key).commit(batch.where("late is null").drop("late"), ("fold", number))
        counts = batch.where("late is not null").groupBy(fold.key, "late").agg(F.count("*").alias("n"))
        if not counts.isEmpty():
            VersionedTable(spark, f"{path}_late", lost, fold.key).commit(counts, ("fold", number))
        batch.unpersist()

    return folded.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def fold_batch(rows: DataFrame, fold: Fold, ts: str | None = None, idle_ms: int = 0) -> DataFrame:
    """The fold over a table: keys are dealt over tasks, and each task reads its rows in order, one key after another.

    With ``ts`` the fold also acts between rows, and a key that has no row for ``idle_ms`` ends and begins anew, as in a stream.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, key, names = False, None, _names(fold.output)
        course = _Course(fold, idle_ms)
        rest = lambda: course.until(_NO_TIME) if ts and idle_ms else fold.last(course.state)
        for frame in frames:
            out: list[tuple] = []
            columns, at = list(frame.columns), frame.columns.get_loc(fold.key)
            none = frame[fold.key].isna().tolist()
            for values, null in zip(zip(*[frame[c].tolist() for c in columns]), none):
                row, own = dict(zip(columns, values)), None if null else values[at]  # null keys are one key
                if not begun or own != key:
                    if begun:
                        out += [(key, *r) for r in rest()]
                    begun, key, course = True, own, _Course(fold, idle_ms, None if ts else deepcopy(fold.initial))
                out += [(key, *r) for r in (course.step(row, _ms(row[ts])) if ts else fold.step(course.state, row))]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(key, *r) for r in rest()] if begun else [], columns=names)

    # A window lays the rows of a key together and in order; rows that are dealt by the key already are not moved for it.
    place = F.row_number().over(Window.partitionBy(fold.key).orderBy(*fold.order))
    return rows.withColumn("__place", place).mapInPandas(run, fold.output)


@contextmanager
def rocks(spark: SparkSession, *more: tuple[str, str]) -> Iterator[None]:
    """Sets the store that folded streams need, and other settings, for as long as the context lasts."""
    before = {name: spark.conf.get(name) for name, _ in (ROCKS, *more)}
    for name, value in (ROCKS, *more):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _ms(t) -> int:
    return _nearest_ms(int(pd.Timestamp(t).value) // 1000)


def _nearest_ms(us: int) -> int:
    """Microseconds as the nearest whole milliseconds, half a one away from zero: so SQL's ``epoch_ms`` counts them."""
    return (us + 500) // 1000 if us >= 0 else -((500 - us) // 1000)


# ---- uploads: a chunk counts only at the expected offset ------------------------------------------------------------


def _upload(state: dict, row: dict) -> list[tuple]:
    total, start, length = int(row["total_bytes"]), int(row["start"]), int(row["length"])
    if state["total"] is None:
        state["total"] = total
    if total != state["total"]:
        verdict = "size conflict"
    elif not 0 < total <= LIMIT_BYTES or length <= 0:
        verdict = "invalid"
    elif state["complete"]:
        verdict = "complete"
    elif start != state["offset"]:
        verdict = "offset mismatch"
    elif start + length > total:
        verdict = "too long"
    else:
        state["offset"] = start + length
        verdict = "accepted"
        if state["offset"] == total:
            good = row.get("hash_ok", True)
            state["complete"], state["offset"] = bool(good), total if good else 0
            verdict = "complete" if good else "hash mismatch"
    return [(int(row["seq"]), verdict, state["offset"], state["complete"])]


UPLOADS = Fold("upload_id", ("seq",), "upload_id string, seq long, verdict string, offset long, complete boolean", "offset long, total long, complete boolean", {"offset": 0, "total": None, "complete": False}, _upload)

# ---- tasks: status, progress, failures -----------------------------------------------------------------------------


def _task(state: dict, row: dict) -> list[tuple]:
    kind, given = row["kind"], row.get("progress")
    given = None if given is None or pd.isna(given) else int(given)
    if state["status"] in ("paused", "canceled") and kind not in ("resumed", "queued"):
        pass  # a task that is paused or cancelled stops work
    elif kind == "running":
        state.update(status="running", error=None, progress=max(1, state["progress"]) if given is None else given)
    elif kind == "progress":
        state.update(status="running", progress=state["progress"] if given is None else max(0, min(100, given)))
    elif kind == "done":
        state.update(status="done", progress=100, failures=0, error=None)
    elif kind == "failure":
        n = state["failures"] + 1
        state.update(status="queued" if n < 5 else "failed", failures=n, progress=min(99, state["progress"]) if n < 5 else state["progress"], error="failure")
    elif kind == "prepared":
        state.update(status="queued", progress=30, error=None)
    elif kind == "submitted":
        state.update(status="queued", progress=max(30, state["progress"]), error=None)
    elif kind in ("waiting", "resumed", "queued"):
        state.update(status="queued", error=None, **({"progress": 0, "failures": 0} if kind == "queued" else {}))
    elif kind in ("paused", "canceled"):
        state["status"] = kind
    return [(int(row["event_id"]), state["status"], state["progress"], state["failures"], state["error"])]


TASKS = Fold("user_id", ("ts", "event_id"), "user_id long, event_id long, status string, progress long, failures long, error string", "status string, progress long, failures long, error string", {"status": "queued", "progress": 0, "failures": 0, "error": None}, _task)

# ---- progress: only news -------------------------------------------------------------------------------------------


def _progress(state: dict, row: dict) -> list[tuple]:
    """Out at a change of stage or a failure or success; else only a new percent or after 700 ms, and 300 ms after the last."""
    now, kind, given = _ms(row["ts"]), row["kind"], row.get("progress")
    given = None if given is None or pd.isna(given) else int(given)
    force = (kind, given) != (state["kind"], state["given"]) and (kind != state["kind"] or kind in ("failure", "done"))
    fresh = given is not None and given != state["percent"]
    if not force and (now - state["sent"] < 300 or not fresh and now - state["sent"] < 700):
        return []
    state.update(kind=kind, given=given, sent=now, percent=state["percent"] if given is None else given)
    return [(int(row["event_id"]), kind, state["percent"])]


PROGRESS = Fold("user_id", ("ts", "event_id"), "user_id long, event_id long, kind string, percent long", "kind string, given long, percent long, sent long", {"kind": None, "given": None, "percent": None, "sent": -(10**15)}, _progress)


def _held_progress(state: dict, row: dict) -> list[tuple]:
    """As above, but what is not sent waits, the latest of it, until it may go out."""
    out = _progress(state, row)
    given = row.get("progress")
    if out:
        state.update(held=None, held_kind=None, held_given=None)
        return [(row["ts"], *r, False) for r in out]
    state.update(held=int(row["event_id"]), held_kind=row["kind"], held_given=None if given is None or pd.isna(given) else int(given))
    return []


def _progress_due(state: dict) -> int | None:
    fresh = state["held_given"] is not None and state["held_given"] != state["percent"]
    return None if state["held"] is None else state["sent"] + (300 if fresh else 700)


def _late_progress(state: dict, now: int) -> list[tuple]:
    event, kind, given = state["held"], state["held_kind"], state["held_given"]
    state.update(kind=kind, given=given, sent=now, percent=state["percent"] if given is None else given, held=None, held_kind=None, held_given=None)
    return [(pd.Timestamp(now, unit="ms"), event, kind, state["percent"], True)]


TRAILING = Fold(
    "user_id",
    ("ts", "event_id"),
    "user_id long, ts timestamp, event_id long, kind string, percent long, trailing boolean",
    "kind string, given long, percent long, sent long, held long, held_kind string, held_given long",
    {**PROGRESS.initial, "held": None, "held_kind": None, "held_given": None},
    _held_progress,
    due=_progress_due,
    tick=_late_progress,
)

# ---- playback: a state at most every 3 s ---------------------------------------------------------------------------


def _playback(state: dict, row: dict) -> list[tuple]:
    now = _ms(row["ts"])
    if row.get("playing_example") or now - state["saved"] < 3000:
        return []
    state["saved"] = now
    return [(row["ts"], max(0, int(row["position_ms"])))]


# Events that agree in time and number come by position, so that nothing in the output is left to chance.
PLAYBACK = Fold("video_id", ("ts", "event_id", "position_ms"), "video_id string, ts timestamp, position_ms long", "saved long", {"saved": -(10**15)}, _playback)

# ---- captions from words: one word of look-ahead -------------------------------------------------------------------


def _words(state: dict, row: dict) -> list[tuple]:
    """A caption goes out at a sentence end, at a long silence, or when the next word would pass a limit."""
    out, held, word = [], state["held"], (int(row["idx"]), int(row["start_ms"]), int(row["end_ms"]), row["text"])
    if held:
        ended = held[-1][3].rstrip("\"')]")[-1:] in (".", "!", "?")
        if ended or word[1] - held[-1][2] >= R.FORCED_GAP_MS or word[2] - held[0][1] > R.MAX_MS or len(held) >= R.MAX_WORDS or _too_long(held, word):
            out, held = _left({"held": held}), []
    state["held"], state["words"] = [*held, word], state["words"] + 1
    return out


def _too_long(held: list[tuple], word: tuple) -> bool:
    """Tidying only shortens a text, so that it is done only where the words as they are would be too long."""
    texts = [w[3] for w in held] + [word[3]]
    return sum(map(len, texts)) + len(held) > R.MAX_CHARS and len(tidied(texts)) > R.MAX_CHARS


def _left(state: dict) -> list[tuple]:
    held = state["held"]
    return [(held[0][0], held[-1][0] + 1, held[0][1], held[-1][2], tidied(w[3] for w in held))] if held else []


CAPTIONS = Fold("video_id", ("idx",), "video_id string, word_start long, word_end long, start_ms long, end_ms long, text string", "words long", {"words": 0, "held": []}, _words, _left, items=("held", "idx long, start_ms long, end_ms long, text string"))

# ---- status log: a row when the status changes, or after 60 s without one --------------------------------------------


def _changes(state: dict, row: dict) -> list[tuple]:
    now = _ms(row["ts"])
    if row["kind"] == state["kind"] and now - state["sent"] < 60_000:
        return []
    state.update(kind=row["kind"], sent=now)
    return [(int(row["event_id"]), row["kind"])]


CHANGES = Fold("user_id", ("ts", "event_id"), "user_id long, event_id long, kind string", "kind string, sent long", {"kind": None, "sent": -(10**15)}, _changes)
HEARTBEAT_MS = 60_000


def _status(state: dict, row: dict) -> list[tuple]:
    return [(row["ts"], *r, False) for r in _changes(state, row)]


def _heartbeat(state: dict, now: int) -> list[tuple]:
    state["sent"] = now
    return [(pd.Timestamp(now, unit="ms"), None, state["kind"], True)]


#: The status log with the rows that come without an event, one a minute until the key is idle too long.
STATUS_LOG = Fold("user_id", ("ts", "event_id"), "user_id long, ts timestamp, event_id long, kind string, heartbeat boolean", CHANGES.state, CHANGES.initial, _status, due=lambda state: state["sent"] + HEARTBEAT_MS, tick=_heartbeat)

# ---- retries: failures since the last success ------------------------------------------------------------------------

MOST_FAILURES = 5


def _retry(state: dict, row: dict) -> list[tuple]:
    """A failure queues a task again, at 99 at most, until the last that it may have; a success begins anew."""
    kind, given = row["kind"], row.get("progress")
    if given is not None and not pd.isna(given):
        state["progress"] = max(0, min(100, int(given)))
    if kind == "failure":
        n = state["failures"] + 1
        state.update(failures=n, status="queued" if n < MOST_FAILURES else "failed", progress=min(99, state["progress"]) if n < MOST_FAILURES else state["progress"])
    else:
        state["status"] = kind
        if kind == "done":
            state.update(failures=0, progress=100)
    return [(row["ts"], int(row["event_id"]), state["status"], state["failures"], state["progress"])]


RETRIES = Fold("user_id", ("ts", "event_id"), "user_id long, ts timestamp, event_id long, status string, failures long, progress long", "status string, failures long, progress long", {"status": "queued", "failures": 0, "progress": 0}, _retry)


def without_repeats(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without late and repeated events; state is bounded by the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


JOB_STATE = "user_id long, status string, status_at struct<ts: timestamp, event_id: bigint>, progress long, progress_at struct<ts: timestamp, event_id: bigint>"


def job_table(spark: SparkSession, path: str):
    """The table of a job's latest status and progress, each with the event that it is from."""
    from lexitide.sources.tables import VersionedTable, newest_fields

    return VersionedTable(spark, path, JOB_STATE, "user_id", newest_fields("user_id", {"status": "status_at", "progress": "progress_at"}))


def stream_job_state(events: DataFrame, path: str, checkpoint: str):
    """Events merged into ``job_table``: of each field the latest value that is not null, in whatever order they come.

    A micro-batch is one row a user before it is committed, under its number. The stream keeps no state of its own.
    """
    order = F.struct("ts", "event_id")

    def merge(batch: DataFrame, number: int) -> None:
        known = lambda c: F.when(F.col(c).isNotNull(), order)
        rows = batch.groupBy("user_id").agg(*[x for c, name in (("kind", "status"), ("progress", "progress")) for x in (F.max_by(c, known(c)).alias(name), F.max(known(c)).alias(f"{name}_at"))])
        job_table(batch.sparkSession, path).commit(rows, ("events", number))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def retry_table(spark: SparkSession, path: str):
    """The table into which ``stream_fold`` puts ``RETRIES``, read as the latest state of each user."""
    from lexitide.sources.tables import VersionedTable, newest_rows

    return VersionedTable(spark, path, RETRIES.output, "user_id", newest_rows("user_id", [F.desc("ts"), F.desc("event_id")]))


class _Complete(StatefulProcessor):
    """The rows of unfinished and of lately published videos, by number; a video comes out when all its rows are translated."""

    def __init__(self, schema: StructType, total: str | None, keep_ms: int):
        self.schema, self.total, self.keep_ms = schema, total, keep_ms
        self.names = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.rows = handle.getMapState("rows", "idx long", fields, self.keep_ms)
        self.counts = handle.getValueState("counts", "n long, missing long, total long", self.keep_ms)
        self.whole = [isinstance(f.dataType, (IntegralType, BooleanType)) for f in self.schema]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, text = self.names.index("idx"), self.names.index("chinese_text")
        n, missing, total = self.counts.get() if self.counts.exists() else (0, 0, None)
        blank = lambda values: not (values[text] or "").strip()
        for frame in rows:
            for row in frame.itertuples(index=False, name=None):
                values = tuple(None if pd.isna(v) else int(v) if w and not isinstance(v, bool) else v for v, w in zip(row, self.whole))
                if self.rows.containsKey((values[at],)):
                    missing -= blank(tuple(self.rows.getValue((values[at],))))
                else:
                    n += 1
                missing += blank(values)
                self.rows.updateValue((values[at],), values)
                if self.total and values[self.names.index(self.total)] is not None:
                    total = max(total or 0, values[self.names.index(self.total)])
        self.counts.update((n, missing, total))
        done = missing == 0 and (self.total is None or total is not None and n >= total)
        yield pd.DataFrame([tuple(v) for v in self.rows.values()] if done else [], columns=self.names).astype(object)

    def close(self) -> None:
        pass


def stream_publish(captions: DataFrame, path: str, checkpoint: str, total: str | None = None, keep: dt.timedelta = dt.timedelta(days=30)):
    """Publish videos once all their rows have a translation, into the caption table at ``path``; the store must be RocksDB's.

    A video's rows may come in several micro-batches: they stay in the state, the latest of rows with the same number, so a
    batch reads the rows of the videos it touches and no others (a stream that ends by itself needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, as rows could go at any time). With ``total``, a column that has a video's number of
    captions, a video is published only when all have come. Rows are forgotten ``keep`` after they came. A batch that is
    run again adds nothing.
    """
    from lexitide.sources.files import caption_table

    schema = captions.schema
    whole = captions.groupBy("video_id").transformWithStateInPandas(_Complete(schema, total, int(keep.total_seconds() * 1000)), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")

    def publish(batch: DataFrame, number: int) -> None:
        caption_table(batch.sparkSession, path, schema).commit(batch, ("captions", number))

    return whole.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def wordbook_table(spark: SparkSession, path: str, schema: StructType | str, most: int = 1000):
    """The newest ``most`` entries of each user."""
    from lexitide.sources.tables import VersionedTable, newest_rows

    return VersionedTable(spark, path, schema, "user_id", newest_rows("user_id", [F.desc("time"), F.desc("event_id")], most))


def stream_wordbook(entries: DataFrame, path: str, checkpoint: str, most: int = 1000):
    """Entries committed to ``wordbook_table``; what a user has beyond the newest ``most`` goes when parts are merged."""
    schema = entries.schema

    def keep(batch: DataFrame, number: int) -> None:
        wordbook_table(batch.sparkSession, path, schema, most).commit(batch, ("entries", number))

    return entries.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
