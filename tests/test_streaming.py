"""Streams in several batches give what a batch over the same rows gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.functions.recursion import linear_ema
from quillwave.sources.assets import byte_budget_cutoff
from quillwave.streaming import operators as O

SCHEMA = "series_id string, event_id long, ts timestamp, value double"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """(folder with four files in order of time, the rows)."""
    spark.conf.set(*O.STATE_STORE)
    r = np.random.default_rng(0)
    ts = 1_700_000_000 + np.cumsum(r.integers(1, 40, 400))
    data = [(f"s{i % 2}", i, int(t), float(v if not 150 < i < 230 else 0.0)) for i, (t, v) in enumerate(zip(ts, r.normal(size=400), strict=True))]
    folder = str(tmp_path_factory.mktemp("stream"))
    for k in range(4):
        part = spark.createDataFrame(data[k * 100 : k * 100 + 100], "series_id string, event_id long, t long, value double")
        part.select("series_id", "event_id", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(folder)
    return folder, data


def run(spark, rows, change, tmp_path):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(rows[0])
    out = change(source)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_envelope_is_kept_between_batches(spark, rows, tmp_path):
    got = {r.event_id: r.env for r in run(spark, rows, lambda s: O.stream_envelope(s, 0.9), tmp_path)}
    series = spark.createDataFrame([(s, i // 2, v * v) for s, i, _, v in rows[1]], "series_id string, pos long, value double")
    want = {(r.series_id, r.pos): r.smooth for r in linear_ema(series, 0.9).collect()}
    assert len(got) == 400 and all(np.isclose(got[i], max(want[s, i // 2], 1e-12) ** 0.5) for s, i, _, _ in rows[1])


def test_frames(spark, rows, tmp_path):
    got = {(r.series_id, r.start.timestamp()): r.n for r in run(spark, rows, lambda s: O.stream_frames(s, "10 minutes", "1 minute"), tmp_path)}
    want, newest = {}, max(t for _, _, t, _ in rows[1])
    for s, _, t, _ in rows[1]:
        want[s, float(t // 600 * 600)] = want.get((s, float(t // 600 * 600)), 0) + 1
    assert got == {k: n for k, n in want.items() if k[1] + 600 <= newest - 60}


def test_silence_alerts(spark, rows, tmp_path):
    got = {(r.series_id, r.quiet_since.timestamp()) for r in run(spark, rows, lambda s: O.stream_silence_alert(s, 0.0, 600.0, "1 second"), tmp_path)}
    want = set()
    for name in ("s0", "s1"):
        loud = [t for s, _, t, v in rows[1] if s == name and v != 0]
        want |= {(name, float(a)) for a, b in zip(loud, loud[1:], strict=False) if b - a > 600}
        want |= {(name, float(loud[-1]))} if loud[-1] + 600 <= max(t for _, _, t, _ in rows[1]) - 1 else set()
    assert want and got == want


def test_budget(spark, rows, tmp_path):
    blocks = lambda s: O.stream_byte_budget(s.select(F.col("event_id").cast("long").alias("x"), F.lit(1).cast("long").alias("session"), F.col("event_id").alias("seq"), F.lit(10).cast("long").alias("bytes")).drop("x"), 1_503)
    got = sorted((r.seq, r.kept) for r in run(spark, rows, blocks, tmp_path))
    assert len(got) == 151 and sum(k for _, k in got) == 1_500


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """(folder with six files, rows out of order within and between neighbouring files, the rows): (key, number, second, bytes)."""
    r = np.random.default_rng(5)
    ts = 1_700_000_000 + np.cumsum(r.integers(0, 4, 600))
    data = [(int(r.random() < 0.3), i, int(t), int(r.integers(0, 40))) for i, t in enumerate(ts)]
    data += [(9, 600, int(ts[-1]) + 10_000, 1)]  # moves the watermark past all others
    order = sorted(range(600), key=lambda i: i + r.integers(0, 120)) + [600]
    folder = str(tmp_path_factory.mktemp("shuffled"))
    for k in range(6):
        part = spark.createDataFrame([data[i] for i in order[k * 101 : k * 101 + 101]], "session long, seq long, t long, bytes long")
        part.select("session", "seq", F.timestamp_seconds("t").alias("ts"), "bytes").coalesce(1).write.mode("append").parquet(folder)
    return folder, data


BLOCKS = "session long, seq long, ts timestamp, bytes long"


def run_blocks(spark, folder, change, tmp_path):
    spark.conf.set(*O.STATE_STORE)
    out = change(spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 1).parquet(folder))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.batchId >= 5  # several batches
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_budget_of_blocks_out_of_order_is_that_of_the_batch(spark, shuffled, tmp_path):
    got = run_blocks(spark, shuffled[0], lambda s: O.stream_byte_budget(s, 2_003, late="10 minutes"), tmp_path)
    batch = spark.createDataFrame([(k, i, n) for k, i, _, n in shuffled[1] if k != 9], "session long, seq long, bytes long")
    want = byte_budget_cutoff(batch, 2_003).select("session", "seq", "kept")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 150


def test_envelope_of_rows_out_of_order_is_that_of_the_batch(spark, shuffled, tmp_path):
    rows = lambda s: s.selectExpr("cast(session as string) AS series_id", "seq AS event_id", "ts", "cast(bytes as double) AS value")
    got = {(r.series_id, r.event_id): r.env for r in run_blocks(spark, shuffled[0], lambda s: O.stream_envelope(rows(s), 0.9, late="10 minutes"), tmp_path).collect()}
    mean, want = {}, {}
    for k, i, _, n in shuffled[1]:
        mean[k] = 0.9 * mean.get(k, 0.0) + (1 - 0.9) * n * n
        want[str(k), i] = max(mean[k], 1e-12) ** 0.5
    got.pop(("9", 600), None)
    assert len(got) == 600 and all(np.isclose(got[k], want[k]) for k in got)


def test_silent_sessions_end_however_batched(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = 1_700_000_000
    for part in ([(1, 0, at, 8), (1, 2, at + 20, 8)], [(1, 1, at + 10, 8), (1, 3, at + 200, 8)], [(1, 4, at + 210, 8), (2, 0, at + 5_000, 4)], [(1, 5, at + 150, 99), (2, 1, None, 4), (2, 2, at + 9_000, None)]):
        rows = spark.createDataFrame(part, "session long, seq long, t long, bytes long").select("session", "seq", F.timestamp_seconds("t").alias("ts"), "bytes")
        rows.coalesce(1).write.mode("append").parquet(folder)
    got = run_short(spark, folder, lambda s: O.stream_byte_budget(s, 12, late="30 seconds", idle_sec=100.0), tmp_path)
    # session 1 keeps 8 and 4 of its first blocks; after the silence the count begins anew; block 5 is too late
    assert got == [(1, 0, 8), (1, 1, 4), (1, 3, 8), (1, 4, 4), (2, 0, 4)]


def run_short(spark, folder, change, tmp_path):
    spark.conf.set(*O.STATE_STORE)
    out = change(spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 1).parquet(folder))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())


def test_latest_message_wins(spark, rows, tmp_path):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(rows[0])
    events = source.select(F.col("series_id").alias("job_id"), (F.col("event_id") / 400).alias("fraction"), F.col("event_id").cast("string").alias("message"))
    query = O.stream_progress(events).writeStream.outputMode("update").foreachBatch(O.upsert_latest(str(tmp_path / "p"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.job_id, r.message) for r in O.latest(spark, str(tmp_path / "p")).collect()} == {("s0", "398"), ("s1", "399")}


def test_versions_hold_changed_jobs_and_now_and_then_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "COMPACT", 3)
    write = O.upsert_latest(str(tmp_path))
    state = {}
    for number in range(8):
        batch = {f"j{number % 4}": f"m{number}", "always": f"a{number}"}
        state |= batch
        write(spark.createDataFrame(list(batch.items()), "job_id string, message string"), number)
        assert {r.job_id: r.message for r in O.latest(spark, str(tmp_path)).collect()} == state
    sizes = [spark.read.parquet(f"{tmp_path}/v={k}").count() for k in range(8)]
    assert sizes == [2, 2, 2, 5, 2, 2, 5, 2]
