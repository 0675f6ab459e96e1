"""Live series and progress as Structured Streaming: the semantics of the batch operators, by event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.recursion import decayed
from ..operators.segments import normalize_tags, paragraph_pause_suppress

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_frames(rows: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """rows(series_id, ts, value): RMS per tumbling window; rows later than `late` are dropped. Append mode."""
    level = F.sqrt(F.avg(F.col("value") * F.col("value")))
    frames = rows.withWatermark("ts", late).groupBy("series_id", F.window("ts", window).alias("w")).agg(level.alias("rms"), F.count(F.lit(1)).alias("n"))
    return frames.select("series_id", F.col("w.start").alias("start"), "rms", "n")


def stream_phrases(rows: DataFrame, threshold: float, gap: str = "30 minutes", least_sec: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Sessions of rows above the threshold; gaps under `gap` are bridged, sessions under `least_sec` dropped. Append mode."""
    loud = rows.filter(F.abs("value") > threshold).withWatermark("ts", late)
    spans = loud.groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return spans.filter(F.col("end").cast("double") - F.col("start").cast("double") >= least_sec).select("series_id", "start", "end", "n")


class _InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, then go to `fold` in order of time and number, each once.

    fold(key, numbers, values, carry) gives (carry, output); carry is None at a key's beginning. Rows wait as packed records, one
    state entry per batch. A key has one timer: at its earliest waiting row, or `idle_ms` behind its last one, where its state
    ends. A silence longer than that begins the key anew however rows were batched.
    """

    def __init__(self, fold: Callable, number: str, value: str, integer: bool, idle_ms: int | None) -> None:
        self.fold, self.number, self.value, self.idle = fold, number, value, idle_ms
        self.record = np.dtype([("ts", "<i8"), ("number", "<i8"), ("value", "<i8" if integer else "<f8")])
        self.carried = f"carry {'long' if integer else 'double'}, last long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.carry = handle.getValueState("carry", self.carried)
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int | None) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows))
        packed = np.empty(len(p), self.record)
        packed["ts"] = p.ts.to_numpy("datetime64[ms]").astype("i8")
        packed["number"], packed["value"] = p[self.number].to_numpy("i8"), p[self.value].fillna(0)
        waits = self.waiting.exists()
        self.waiting.appendValue((packed.tobytes(),))
        first = int(packed["ts"].min()) - 1  # a timer goes off when the watermark is behind it
        if not waits or first < self.due.get()[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = np.frombuffer(b"".join(r[0] for r in self.waiting.get()), self.record)
        if not len(rows):
            self.carry.clear()
            self.due.clear()
            return
        ready, rest = rows[rows["ts"] <= until], rows[rows["ts"] > until]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
        ready = ready[np.lexsort((ready["number"], ready["ts"]))]
        carry, last = self.carry.get() if self.carry.exists() else (None, None)
        times = ready["ts"]
        silent = np.diff(np.r_[times[:1] if last is None else last, times]) > self.idle if self.idle is not None else np.zeros(len(ready), bool)
        cuts = np.flatnonzero(silent).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(ready)], strict=True):
            carry = None if a in cuts else carry
            if b > a:
                carry, out = self.fold(key, ready["number"][a:b], ready["value"][a:b], carry)
                yield out
        if len(ready):
            last = int(times[-1])
            self.carry.update((carry, last))
        self._wake(int(rest["ts"].min()) - 1 if len(rest) else None if self.idle is None else last + self.idle)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, by: str, number: str, value: str, late: str, fold: Callable, schema: str, integer: bool = False, idle_sec: float | None = None) -> DataFrame:
    """`fold` over each key's rows in order of `ts` (whole milliseconds) and `number`; rows later than `late`, or without a time, are dropped."""
    timed = rows.filter(F.col("ts").isNotNull()).withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", late)
    held = _InOrder(fold, number, value, integer, None if idle_sec is None else int(idle_sec * 1000))
    return timed.select(by, "ts", number, value).groupBy(by).transformWithStateInPandas(held, schema, "Append", "EventTime")


class _Envelope(StatefulProcessor):
    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        start = self.last.get()[0] if self.last.exists() else 0.0
        mean = decayed(p.value.to_numpy(float) ** 2, self.alpha, start)
        self.last.update((float(mean[-1]),))
        yield pd.DataFrame({"series_id": p.series_id, "event_id": p.event_id, "env": np.sqrt(np.maximum(mean, 1e-12))})

    def close(self) -> None:
        pass


def stream_envelope(rows: DataFrame, alpha: float, late: str | None = None, idle_sec: float | None = None) -> DataFrame:
    """rows(series_id, event_id, ts, value): the recursive envelope, kept per series from batch to batch.

    Without `late`, rows must come batch by batch in order. With it, rows up to `late` behind the newest wait for the watermark
    and the result is that of the batch operator; a series silent for more than `idle_sec` begins anew and its state ends.
    """
    schema = "series_id string, event_id long, env double"
    if late is None:
        return rows.groupBy("series_id").transformWithStateInPandas(_Envelope(alpha), schema, "Append", "None")

    def fold(key, numbers, values, carry):
        mean = decayed(values**2, alpha, carry or 0.0)
        return float(mean[-1]), pd.DataFrame({"series_id": key[0], "event_id": numbers, "env": np.sqrt(np.maximum(mean, 1e-12))})

    return _in_order(rows, "series_id", "event_id", "value", late, fold, schema, idle_sec=idle_sec)


class _Silence(StatefulProcessor):
    def __init__(self, threshold: float, limit_ms: int) -> None:
        self.threshold, self.limit = threshold, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "ms long, alerted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Gaps that the rows themselves close are told at once; a timer waits behind the latest loud row."""
        p = pd.concat(list(rows))
        loud = sorted(t.value // 1_000_000 for t in p.ts[p.value.abs() > self.threshold])
        last, alerted = self.heard.get() if self.heard.exists() else (None, False)
        quiet = []
        for t in loud:
            if last is None or t > last:
                if last is not None and t - last > self.limit and not alerted:
                    quiet.append(pd.Timestamp(last, unit="ms"))
                last, alerted = t, False
        if loud and (not self.heard.exists() or last > self.heard.get()[0]):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.heard.update((last, False))
            self.handle.registerTimer(last + self.limit)
        yield pd.DataFrame({"series_id": pd.Series([key[0]] * len(quiet), dtype=str), "quiet_since": pd.Series(quiet, dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.heard.get()[0]
        self.heard.update((last, True))
        yield pd.DataFrame({"series_id": [key[0]], "quiet_since": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def stream_silence_alert(rows: DataFrame, threshold: float, limit_sec: float = 15.0, late: str = "10 minutes") -> DataFrame:
    """One alert when a series has not been above the threshold for `limit_sec` of event time."""
    marked = rows.withWatermark("ts", late)
    return marked.groupBy("series_id").transformWithStateInPandas(_Silence(threshold, int(limit_sec * 1000)), "series_id string, quiet_since timestamp", "Append", "EventTime")


class _Budget(StatefulProcessor):
    def __init__(self, target: int) -> None:
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values("seq")
        so_far = self.total.get()[0] if self.total.exists() else 0
        before = so_far + p.bytes.cumsum() - p.bytes
        aligned = self.target - self.target % 4
        p = p.assign(kept=np.maximum(np.minimum(p.bytes, aligned - before), 0))
        self.total.update((int(so_far + p.bytes.sum()),))
        yield p[before < self.target][["session", "seq", "kept"]]

    def close(self) -> None:
        pass


def stream_byte_budget(blocks: DataFrame, target_bytes: int, late: str | None = None, idle_sec: float | None = None) -> DataFrame:
    """blocks(session, seq, bytes): blocks until the session's target; later ones are refused, the last is cut on a whole frame.

    Without `late`, blocks must come batch by batch in order. With it (and a column ts), blocks up to `late` behind the newest
    wait for the watermark and go out in order of ts and seq, whatever batch brought them, as `byte_budget_cutoff` gives them;
    equal ones count each, null bytes are 0. A session silent for more than `idle_sec` has ended: its state goes, and blocks
    that follow are a new session's.
    """
    schema = "session long, seq long, kept long"
    if late is None:
        return blocks.groupBy("session").transformWithStateInPandas(_Budget(target_bytes), schema, "Append", "None")
    aligned = target_bytes - target_bytes % 4

    def fold(key, numbers, values, carry):
        total = (carry or 0) + np.cumsum(values)
        before = total - values
        out = pd.DataFrame({"session": key[0], "seq": numbers, "kept": np.maximum(np.minimum(values, aligned - before), 0)})
        return int(total[-1]), out[before < target_bytes]

    return _in_order(blocks, "session", "seq", "bytes", late, fold, schema, integer=True, idle_sec=idle_sec)


def stream_progress(events: DataFrame) -> DataFrame:
    """events(job_id, fraction, message): the furthest message per job. Update mode."""
    return events.groupBy("job_id").agg(F.max("fraction").alias("fraction"), F.max_by("message", F.struct("fraction", "message")).alias("message"))


#: So many batches after a full version the next full one is written.
COMPACT = 20


def upsert_latest(path: str):
    """A foreachBatch sink: each batch is a Parquet version of its own with the changed jobs; every COMPACT-th holds all jobs. Read by `latest`."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number and number % COMPACT == 0:
            old = latest(batch.sparkSession, path, before=number)
            rows = old.join(batch.select("job_id"), "job_id", "left_anti").select(*batch.columns).unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def latest(spark, path: str, before: int | None = None) -> DataFrame:
    """The newest row of each job: the last full version (below `before`) and the batches behind it; older files are not read."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if before is None else rows.filter(F.col("v") < before)
    newest = rows.agg(F.max("v")).first()[0] or 0
    rows = rows.filter(F.col("v") >= newest - newest % COMPACT)
    columns = [c for c in rows.columns if c not in ("v", "job_id")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*columns), "v").alias("r")).select("job_id", "r.*")


def stream_scripts(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """files(script_id, ts, text): each script once, its tags and paragraph breaks written out, all within the row."""
    once = files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["script_id"])
    return paragraph_pause_suppress(normalize_tags(once)).select("script_id", "text")
