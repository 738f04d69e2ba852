import numpy as np
import pandas as pd
from tickweave.plans.all_queries import QUERIES
from conftest import random_bars, rows_of
from pyspark.sql import functions as F

from tickweave.operators import indicators as ind
from tickweave.operators.frames import in_frames
from tickweave.sources.bars import BAR_SCHEMA
from tickweave.streaming import stateful, windows
from tickweave.streaming.run import drain, read_folder

TICKS = "symbol string, ts timestamp, price double, event_id long"


def write_parts(spark, frames, folder):
    """One file per micro-batch, oldest first."""
    import os
    import time
    for k, (pdf, schema) in enumerate(frames):
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("done-"):
                os.rename(f"{folder}/{f}", f"{folder}/done-{k}.parquet")
                os.utime(f"{folder}/done-{k}.parquet", (time.time() - 1000 + 10 * k,) * 2)
    return str(folder)


def test_indicators_continue_over_micro_batches(spark, tmp_path):
    pdf = random_bars(90)
    parts = [(pdf[a:b][BAR_SCHEMA.names], BAR_SCHEMA) for a, b in ((0, 30), (25, 60), (60, 90))]
    stream = read_folder(spark, write_parts(spark, parts, tmp_path / "in"), BAR_SCHEMA, files_per_batch=1)
    got = drain(stateful.indicators(stream), "ind").toPandas().sort_values("ts").reset_index(drop=True)
    want = in_frames(spark.createDataFrame(pdf), ind.add_core, before=ind.core_margin()).toPandas().sort_values("ix").reset_index(drop=True)
    assert len(got) == 90
    for c in ("atr", "rsi", "ema_9", "ema_200"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9)


def test_traps_continue_over_micro_batches(spark, tmp_path):
    pdf = random_bars(120, 3)
    parts = [(pdf[a:b][BAR_SCHEMA.names], BAR_SCHEMA) for a, b in ((0, 40), (40, 41), (41, 120))]
    stream = read_folder(spark, write_parts(spark, parts, tmp_path / "in"), BAR_SCHEMA, files_per_batch=1)
    got = drain(stateful.false_breakouts(stream), "traps").select(F.date_format("ts", "yyyy-MM-dd HH").alias("t"), "signal")
    top, low, later = pdf["high"].rolling(10).max().shift(1), pdf["low"].rolling(10).min().shift(1), pdf["close"].shift(-2)
    sig = np.where((pdf["low"] < low) & (later > low), 1, np.where((pdf["high"] > top) & (later < top), -1, 0))
    assert rows_of(got, "t", "signal") == [(t.strftime("%Y-%m-%d %H"), int(s)) for t, s in zip(pdf["ts"], sig) if s]


def test_files_out_of_time_order(spark, tmp_path):
    pdf = random_bars(120, 3)
    end = pdf[-1:].assign(ts=pdf["ts"].max() + pd.Timedelta(days=30))
    names = BAR_SCHEMA.names
    parts = [(x[names], BAR_SCHEMA) for x in (pdf[60:], pdf[:60], end)]
    folder = write_parts(spark, parts, tmp_path / "in")
    stream = read_folder(spark, folder, BAR_SCHEMA, files_per_batch=1)
    got = drain(stateful.indicators(stream, delay="10 days"), "ind").toPandas().sort_values("ts").reset_index(drop=True)
    want = in_frames(spark.createDataFrame(pdf), ind.add_core, before=ind.core_margin()).toPandas().sort_values("ix").reset_index(drop=True)
    assert len(got) == 120
    for c in ("atr", "rsi", "ema_9", "ema_200"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9)
    traps = lambda f, **k: rows_of(drain(stateful.false_breakouts(read_folder(spark, f, BAR_SCHEMA, files_per_batch=1), **k), "traps"), "ts", "available_ts", "signal", "entry")
    assert traps(folder, delay="10 days") == traps(write_parts(spark, [(pdf[names], BAR_SCHEMA)], tmp_path / "one")) != []


def ticks(rows):
    return pd.DataFrame([("S", pd.Timestamp(f"2024-01-0{d} {t}"), float(p), k) for k, (d, t, p) in enumerate(rows)], columns=["symbol", "ts", "price", "event_id"])


def test_ticks_behind_the_watermark_are_dropped(spark, tmp_path):
    first = ticks([(1, "10:00:00", 1), (1, "10:30:00", 2), (1, "12:00:00", 3)])
    # The hour from 10 is emitted with the second file, so the third is too late for it.
    second = ticks([(1, "12:10:00", 3)])
    late = ticks([(1, "10:45:00", 99), (1, "12:30:00", 4), (1, "14:00:00", 5)])
    stream = read_folder(spark, write_parts(spark, [(first, TICKS), (second, TICKS), (late, TICKS)], tmp_path / "in"), TICKS, files_per_batch=1)
    got = drain(windows.bars(stream, "1h"), "bars").select(F.hour("ts").alias("h"), "open", "close", "volume")
    assert rows_of(got, "h", "open", "close", "volume") == [(10, 1.0, 2.0, 2.0), (12, 3.0, 4.0, 3.0)]


def test_a_signal_fires_once_per_hour(spark, tmp_path):
    schema = "symbol string, direction string, entry double, ts timestamp"
    rows = [("S", "buy", 1.231, pd.Timestamp("2024-01-01 10:01:00")), ("S", "buy", 1.234, pd.Timestamp("2024-01-01 10:31:00")), ("S", "buy", 1.231, pd.Timestamp("2024-01-01 11:01:00"))]
    parts = [(pd.DataFrame([r], columns=["symbol", "direction", "entry", "ts"]), schema) for r in rows]
    stream = read_folder(spark, write_parts(spark, parts, tmp_path / "in"), schema, files_per_batch=1)
    assert rows_of(drain(windows.dedupe(stream), "d").select(F.hour("ts").alias("h")), "h") == [(10,), (11,)]


def test_caps_hold_over_micro_batches(spark, tmp_path):
    schema = "symbol string, ts timestamp, session string, signal int"
    rows = [(f"s{k}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=50 * k), "asia" if k < 8 else "london", 1) for k in range(16)]
    frames = [(pd.DataFrame(rows[a:b], columns=["symbol", "ts", "session", "signal"]), schema) for a, b in ((0, 2), (2, 10), (10, 16))]
    stream = read_folder(spark, write_parts(spark, frames, tmp_path / "in"), schema, files_per_batch=1)
    assert rows_of(drain(stateful.trade_limits(stream), "caps"), "symbol") == [("s0",), ("s1",), ("s2",), ("s8",), ("s9",)]


def test_trades_advance_and_close(spark, tmp_path):
    names = [c.split()[0] for c in stateful.EVENT_COLUMNS.split(", ")]

    def event(minute, kind, ident="", price=None):
        side = ("buy", 100.0, 90.0, 115.0, 125.0, 135.0) if kind == "signal" else (None,) * 6
        return ("S", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute), kind, ident, *side, price)

    first = [event(0, "signal", "a"), event(1, "price", price=116.0), event(2, "price", price=110.0)]
    second = [event(3, "price", price=99.0), event(4, "signal", "b"), event(5, "price", price=140.0)]
    third = [event(6, "price", price=140.0), event(7, "price", price=140.0), event(8, "signal", "c"), event(9, "price", price=80.0)]
    want = [
        ("a", 0, "open", None, None, 0), ("a", 1, "open", None, None, 1), ("a", 3, "closed", "win", 0.0, 1),
        ("b", 4, "open", None, None, 0), ("b", 5, "open", None, None, 1), ("b", 6, "open", None, None, 2), ("b", 7, "closed", "win", 3.5, 3),
        ("c", 8, "open", None, None, 0), ("c", 9, "closed", "loss", -1.0, 0)]
    # in time order, and in files that arrive in any order within the delay
    for turn, (files, delay) in enumerate((((first, second, third), "0 seconds"), ((third, first, second), "10 minutes"), ((second[::-1], third, first), "10 minutes"))):
        end = [event(30, "price", price=100.0)] if turn else []
        frames = [(pd.DataFrame(f, columns=names), stateful.EVENT_COLUMNS) for f in (*files, *[end] * bool(end))]
        stream = read_folder(spark, write_parts(spark, frames, tmp_path / f"in{turn}"), stateful.EVENT_COLUMNS, files_per_batch=1)
        got = drain(stateful.track_trades(stream, delay), "t").select("id", F.minute("ts").alias("m"), "status", "result", "actual_rr", "level")
        assert [tuple(r) for r in got.orderBy("id", "m").collect()] == want


def test_levels_touch_only_crossed_trades():
    rng = np.random.default_rng(4)
    trades = {f"t{k}": [side, e, e - side * d, e + side * d, e + side * 2 * d, e + side * 3 * d, int(lv)] for k, (side, e, d, lv) in enumerate(zip(rng.choice([1.0, -1.0], 300), rng.normal(100, 5, 300), rng.uniform(1, 9, 300), rng.integers(0, 3, 300)))}
    levels = stateful.Levels({k: list(v) for k, v in trades.items()})
    open_ = {k: list(v) for k, v in trades.items()}
    for price in rng.normal(100, 8, 200):
        want = sorted(k for k, (s, e, stop, *t, lv) in open_.items() if s * (price - t[lv]) >= 0 or s * (price - (e if lv else stop)) <= 0)
        assert levels.crossed(price) == want
        for k in want:
            change = stateful.Tracker._advance(open_[k], price)
            levels.trades[k] = list(open_[k])
            if change[0] == "closed":
                del open_[k], levels.trades[k]
            else:
                levels.watch(k)


def test_delayed_ticks_wait_for_the_watermark(spark, tmp_path):
    first = ticks([(1, "10:00:10", 1), (1, "10:20:10", 2)])
    second = ticks([(1, "11:00:00", 3)])
    stream = read_folder(spark, write_parts(spark, [(first, TICKS), (second, TICKS)], tmp_path / "in"), TICKS, files_per_batch=1)
    got = drain(stateful.delayed_feed(stream, 30), "delay")
    assert rows_of(got, "price") == [(1.0,)]


def test_delayed_ticks_leave_once_when_due(spark, tmp_path, monkeypatch):
    """Values of a few rows, most of them due in part, over batches whose times overlap within the lateness."""
    monkeypatch.setattr(stateful, "HELD_ROWS", 7)
    monkeypatch.setattr(stateful, "RELEASED_ROWS", 20)
    rng = np.random.default_rng(5)
    frames = []
    for k in range(6):
        at = pd.Timestamp("2024-01-01 10:00") + pd.to_timedelta(20 * k * 60 + rng.integers(0, 25 * 60, 300), unit="s")
        part = pd.DataFrame({"symbol": rng.choice(["S", "T"], 300), "ts": at, "price": rng.random(300).round(3), "event_id": rng.integers(0, 200, 300)})
        frames.append(pd.concat([part, part[:40]]))
    for n in (2, 6):
        stream = read_folder(spark, write_parts(spark, [(f, TICKS) for f in frames[:n]], tmp_path / f"in{n}"), TICKS, files_per_batch=1)
        got = rows_of(drain(stateful.delayed_feed(stream, 30, pieces=1), "delay"), "ts", "symbol", "price", "event_id")
        seen = pd.concat(frames[:n])
        due = seen[seen["ts"].dt.floor("min") + pd.Timedelta(minutes=41) <= seen["ts"].max()]
        assert got == sorted(zip(due["ts"], due["symbol"], due["price"], due["event_id"])) and len(got) > 20


def test_delayed_state_does_not_grow_with_minutes(spark, tmp_path):
    rows = pd.DataFrame({"symbol": "S", "ts": pd.date_range("2024-01-01", periods=3000, freq="min"), "price": 1.0, "event_id": range(3000)})
    feed = stateful.delayed_feed(read_folder(spark, write_parts(spark, [(rows, TICKS)], tmp_path / "in"), TICKS), 30)
    query = feed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 1000
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000 - 41


def test_delayed_ticks_without_id_price_or_time(spark, tmp_path):
    part = ticks([(1, "10:00:00", 1), (1, "10:01:00", 2), (1, "10:02:00", 3), (1, "10:03:00", 4), (1, "11:00:00", 5)])
    part["event_id"] = pd.Series([None, 2**53 + 1, 3, 4, 5], dtype=object)
    part.loc[2, "ts"], part.loc[3, "price"] = pd.NaT, None
    stream = read_folder(spark, write_parts(spark, [(part, TICKS)], tmp_path / "in"), TICKS)
    got = drain(stateful.delayed_feed(stream, 30), "delay").orderBy("ts").select("price", "event_id").collect()
    assert [tuple(r) for r in got] == [(1.0, None), (2.0, 2**53 + 1), (None, 4)]


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    for name in ("ss_bars", "ss_late", "ss_delayed_feed"):
        file, folder = (sorted(map(str, QUERIES[name](spark, f"{tmp_path}/{kind}").collect())) for kind in ("file", "folder"))
        assert file == folder and len(file) > 100, name
