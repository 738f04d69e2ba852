import numpy as np
import pandas as pd
import pytest
from conftest import bars_of, random_bars

from tickweave.operators import indicators as ind
from tickweave.operators.frames import in_frames


def pandas_core(g: pd.DataFrame) -> pd.DataFrame:
    prev = g["close"].shift(1)
    tr = pd.concat([g["high"] - g["low"], (g["high"] - prev).abs(), (g["low"] - prev).abs()], axis=1).max(axis=1)
    change = g["close"].diff()
    up, down = change.clip(lower=0).ewm(span=14, adjust=False).mean(), (-change.clip(upper=0)).ewm(span=14, adjust=False).mean()
    out = pd.DataFrame({"atr": tr.ewm(span=14, adjust=False).mean(), "rsi": 100 - 100 / (1 + up / down.replace(0, np.nan))})
    for s in (9, 21, 50, 200):
        out[f"ema_{s}"] = g["close"].ewm(span=s, adjust=False).mean()
    return out


def test_exponential_means_over_many_blocks(spark):
    pdf = pd.concat([random_bars(12000, 3, "A", decimals=None), random_bars(700, 4, "B", decimals=None)])
    got = in_frames(spark.createDataFrame(pdf), ind.add_core, before=ind.core_margin(), rows=5120).toPandas()
    for symbol, g in pdf.groupby("symbol"):
        mine = got[got["symbol"] == symbol].sort_values("ix").reset_index(drop=True)
        want = pandas_core(g.reset_index(drop=True))
        pd.testing.assert_frame_equal(mine[list(want)], want, rtol=1e-9)


def test_no_loss_leaves_rsi_unknown(spark):
    pdf = bars_of([(i, i + 1, i, i + 1) for i in range(1, 9)])
    got = in_frames(spark.createDataFrame(pdf), lambda d, w: ind.add_core(d, w, ()), before=ind.core_margin(())).toPandas()
    assert got["rsi"].isna().all()
    got = in_frames(spark.createDataFrame(pdf), lambda d, w: ind.add_rsi_sma(d, w, 3), before=4).toPandas().sort_values("ix")
    assert got["rsi"].isna().sum() == 2 and (got["rsi"].dropna() == 100).all()


@pytest.mark.parametrize("rows", [40, 4096])
def test_rolling_indicators_match_pandas(spark, rows):
    pdf = random_bars(150)

    def build(df, w):
        df = ind.add_atr_sma(df, w)
        df = ind.add_bollinger(df, w)
        df = ind.add_volume(df, w)
        return ind.add_extrema(ind.add_returns(df, w), w, 10)

    got = in_frames(spark.createDataFrame(pdf), build, before=30, rows=rows).toPandas().sort_values("ix").reset_index(drop=True)
    prev = pdf["close"].shift(1)
    tr = np.maximum(pdf["high"] - pdf["low"], np.maximum((pdf["high"] - prev).abs(), (pdf["low"] - prev).abs()))
    want = pd.DataFrame({
        "atr": tr.rolling(14).mean(), "bb_mid": pdf["close"].rolling(20).mean(),
        "bb_upper": pdf["close"].rolling(20).mean() + 2 * pdf["close"].rolling(20).std(),
        "volume_sma": pdf["volume"].rolling(20).mean(), "rvol": pdf["volume"] / pdf["volume"].rolling(20).mean(),
        "return_1d": pdf["close"].pct_change(24), "prev_high_10": pdf["high"].rolling(10).max().shift(1),
        "prev_low_10": pdf["low"].rolling(10).min().shift(1),
    })
    pd.testing.assert_frame_equal(got[list(want)], want, rtol=1e-9)


def test_zero_prices_give_null_not_an_error(spark):
    pdf = bars_of([(0, 1, 0, 0)] * 30)
    got = in_frames(spark.createDataFrame(pdf), ind.add_research, before=ind.core_margin() + 32).toPandas()
    assert got["return_1h"].isna().all() and got["volatility"].isna().all()


def test_live_bars_drop_rows_without_rsi(spark):
    got = ind.live_bars(spark.createDataFrame(random_bars(60))).toPandas()
    assert {"ema_fast", "ema_slow", "ema_trend", "rvol"} <= set(got.columns)
    assert got["ix"].min() >= 1 and got["rsi"].notna().all()
