import numpy as np
import pandas as pd
import pytest
from conftest import bars_of, random_bars, rows_of
from pyspark.sql import functions as F

from tickweave.operators import indicators as ind
from tickweave.operators import signals
from tickweave.operators.frames import in_frames

FLAT = (10, 11, 9, 10)


def fired(spark, pdf, strategy, before=16, after=2, rows=4096, prepare=None):
    def build(df, w):
        df = prepare(df, w) if prepare else df
        return df.withColumn("signal", strategy(w))
    return in_frames(spark.createDataFrame(pdf), build, before, after, rows=rows).filter("signal <> 0")


def test_trap_needs_lookback_break_and_return(spark):
    trap = [FLAT] * 10 + [(10, 13, 10, 12), (12, 12, 11, 11), (11, 11, 10, 10)] + [FLAT] * 3
    assert rows_of(fired(spark, bars_of(trap), signals.false_breakout()), "ix", "signal") == [(10, -1)]
    stays = [FLAT] * 10 + [(10, 13, 10, 12), (12, 13, 12, 12.5), (12, 13, 12, 12.5)] + [FLAT] * 3
    assert all(ix != 10 for ix, _ in rows_of(fired(spark, bars_of(stays), signals.false_breakout()), "ix", "signal"))
    early = [FLAT] * 9 + [(10, 13, 10, 12), (12, 12, 11, 11), (11, 11, 10, 10)]
    assert rows_of(fired(spark, bars_of(early), signals.false_breakout()), "ix", "signal") == []


def test_buy_overrides_sell_but_both_setups_exist(spark):
    both = [FLAT] * 10 + [(10, 13, 7, 10), FLAT, FLAT, FLAT]
    assert rows_of(fired(spark, bars_of(both), signals.false_breakout()), "ix", "signal") == [(10, 1)]

    def build(df, w):
        return signals.add_false_breakout_setups(df.withColumn("atr", F.lit(2.0)), w)
    setups = in_frames(spark.createDataFrame(bars_of(both)), build, 10, 2)
    assert rows_of(setups, "direction", "available_ix", "entry", "stop_loss", "confidence") == [
        ("buy", 12, 10.0, 8.0, 62.5), ("sell", 12, 10.0, 12.0, 62.5)]
    assert rows_of(signals.pick_best(setups), "direction") == [("sell",)]


@pytest.mark.parametrize("rows", [32, 4096])
def test_signals_do_not_depend_on_the_block_size(spark, rows):
    pdf = random_bars(300)
    strategies = {n: s for n, s in signals.STRATEGIES.items() if n.startswith(("breakout", "vol", "bollinger"))}

    def build(df, w):
        return signals.add_signals(ind.add_volume(ind.add_bollinger(df, w), w), w, strategies)
    got = rows_of(signals.to_long(in_frames(spark.createDataFrame(pdf), build, 60, rows=rows)), "strategy", "ix", "signal")
    top, low = pdf["high"].rolling(20).max().shift(1), pdf["low"].rolling(20).min().shift(1)
    want = [("breakout_20", i, -1 if c < l else 1) for i, (c, t, l) in enumerate(zip(pdf["close"], top, low)) if c > t or c < l]
    assert [r for r in got if r[0] == "breakout_20"] == sorted(want)


def loop_vshape(close, atr):
    out, streak, move = [], 0, 0.0
    for i in range(1, len(close)):
        r = close[i] / close[i - 1] - 1
        if (r > 0 and streak >= 0) or (r < 0 and streak <= 0):
            streak += 1 if r > 0 else -1
            move += abs(r) * close[i - 1]
        else:
            streak, move = (1 if r > 0 else -1), abs(r) * close[i - 1]
        if abs(streak) >= 3 and move > atr[i] * 1.5:
            out.append((i, -1 if streak > 0 else 1))
            streak, move = 0, 0.0
    return out


@pytest.mark.parametrize("rows", [16, 4096])
def test_vshape_matches_a_loop(spark, rows):
    pdf = random_bars(400, 7)
    pdf["close"] = pdf["close"].round(0)
    pdf["atr"] = 0.9
    got = rows_of(signals.vshape(spark.createDataFrame(pdf), rows=rows), "ix", "signal")
    assert got and got == loop_vshape(pdf["close"].to_numpy(), pdf["atr"].to_numpy())


def test_votes_need_agreement(spark):
    pdf = random_bars(60)
    pool = {"a": lambda w: F.when(F.col("ix") < 30, 1).otherwise(-1), "b": lambda w: F.when(F.col("ix") % 2 == 0, 1).otherwise(0), "c": lambda w: F.lit(-1)}
    combos = signals.votes(2, pool=("a", "b", "c"))
    assert list(combos) == ["a + b", "a + c", "b + c"]
    got = in_frames(spark.createDataFrame(pdf), lambda d, w: signals.add_votes(d, w, combos, pool))
    got = signals.to_long(got).groupBy("strategy", "signal").count()
    assert rows_of(got, "strategy", "signal", "count") == [("a + b", 1, 15), ("a + c", -1, 30)]


def test_pandas_strategy_sees_its_margin(spark):
    pdf = random_bars(200)
    func = lambda b: np.sign(b["close"].diff(3)).fillna(0).astype(int)
    got = signals.pandas_strategy(spark.createDataFrame(pdf), "momentum", func, before=3, rows=20)
    want = [(i, int(v)) for i, v in enumerate(np.sign(pdf["close"].diff(3))) if v == v and v != 0]
    assert rows_of(got, "ix", "signal") == want


def gap_week():
    days = pd.date_range("2024-01-01", periods=47, freq="D")
    pdf = bars_of([(100, 101, 99, 100)] * 47, tf="1d", start="2024-01-01").assign(ts=days, atr=2.0)
    pdf.loc[pdf["ts"] == "2024-01-29", "open"] = 103.0
    pdf.loc[pdf["ts"] == "2024-02-05", "open"] = 100.1
    pdf.loc[pdf["ts"] == "2024-02-12", "open"] = 98.0
    return pdf


def test_monday_gap_direction_threshold_and_missing_friday(spark):
    pdf = gap_week()
    got = signals.monday_gap(spark.createDataFrame(pdf), rows=8)
    assert rows_of(got.select(F.date_format("ts", "MM-dd").alias("d"), "gap_type", "signal", "gap_atr"), "d", "gap_type", "signal", "gap_atr") == [
        ("01-29", "up", -1, 1.5), ("02-12", "down", 1, 1.0)]
    # Without the Friday in between, a second Monday after the same Friday is not taken.
    pdf = pdf[pdf["ts"] != "2024-02-02"].assign(ix=range(46))
    pdf.loc[pdf["ts"] == "2024-02-05", "open"] = 104.0
    got = signals.monday_gap(spark.createDataFrame(pdf))
    assert rows_of(got.select(F.date_format("ts", "MM-dd").alias("d")), "d") == [("01-29",), ("02-12",)]


def test_cutting_the_future_changes_no_point_in_time_signal(spark):
    pdf = random_bars(300, 9)
    for name in ("breakout_20", "bollinger_bounce"):
        prepare = ind.add_bollinger
        whole = rows_of(fired(spark, pdf, signals.STRATEGIES[name], 24, 0, prepare=prepare).filter("ix < 200"), "ix", "signal")
        part = rows_of(fired(spark, pdf[:200], signals.STRATEGIES[name], 24, 0, prepare=prepare), "ix", "signal")
        assert whole == part
    # The trap needs two later bars, so its last two bars may differ; it says so in available_ix.
    whole = rows_of(fired(spark, pdf, signals.false_breakout()).filter("ix + 2 < 200"), "ix", "signal")
    assert whole == rows_of(fired(spark, pdf[:200], signals.false_breakout()), "ix", "signal")
def test_one_streak_over_many_blocks(spark):
    """10^5 rising bars, signals now and then, in blocks far shorter than the streak."""
    rng = np.random.default_rng(2)
    close = 100 + np.cumsum(rng.random(100_000) * 0.01 + 1e-6)
    atr = np.where(rng.random(100_000) < 0.02, rng.random(100_000) * 3, 50.0)
    pdf = pd.DataFrame({"symbol": "S", "tf": "1h", "ts": pd.Timestamp("2024-01-01"), "ix": np.arange(100_000), "close": close, "atr": atr})
    want = loop_vshape(close, atr)
    assert len(want) > 50
    got = rows_of(signals.vshape(spark.createDataFrame(pdf), rows=1024, fan=8), "ix", "signal")
    assert got == want


