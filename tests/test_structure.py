import numpy as np
import pytest
from conftest import bars_of, random_bars, rows_of
from pyspark.sql import functions as F

from tickweave.operators import structure
from tickweave.operators.crossing import first_beyond, first_cross


def brute_swings(pdf, k=5):
    out = []
    for i in range(k, len(pdf) - k):
        part = pdf.iloc[i - k:i + k + 1]
        if pdf["high"][i] == part["high"].max():
            out.append(("high", i, pdf["high"][i]))
        if pdf["low"][i] == part["low"].min():
            out.append(("low", i, pdf["low"][i]))
    return out


def test_ties_are_both_swings_and_edges_are_none(spark):
    highs = [5, 6, 7, 8, 9, 20, 8, 20, 8, 7, 6, 5, 5, 30, 5]
    pdf = bars_of([(h - 1, h, h - 2, h - 1) for h in highs])
    got = structure.swings(spark.createDataFrame(pdf)).filter("side = 'high'")
    assert rows_of(got, "ix", "confirmed_ix") == [(5, 10), (7, 12)]


@pytest.mark.parametrize("rows", [11, 4096])
def test_swings_match_a_loop(spark, rows):
    pdf = random_bars(200)
    got = rows_of(structure.swings(spark.createDataFrame(pdf), rows=rows), "side", "ix", "price")
    assert got == sorted(brute_swings(pdf))


@pytest.mark.parametrize("rows, fan", [(7, 3), (16, 256), (4096, 256)])
def test_first_crossing_matches_a_loop(spark, rows, fan):
    pdf = random_bars(300, 5)
    close = pdf["close"].to_numpy()
    ev = pdf[["symbol", "tf", "ix"]].assign(up=close + 3, down=close - 4)
    ev.loc[ev["ix"] % 3 == 0, "down"] = np.nan
    events = spark.createDataFrame(ev).withColumn("down", F.when(~F.isnan("down"), F.col("down")))
    got = dict(rows_of(first_cross(events, spark.createDataFrame(pdf), rows=rows, fan=fan).select("ix", "cross_ix"), "ix", "cross_ix"))
    for i in range(300):
        hits = [j for j in range(i + 1, 300) if close[j] > close[i] + 3 or (i % 3 and close[j] < close[i] - 4)]
        assert got[i] == (hits[0] if hits else None)


def test_crossings_of_one_long_series_spread_over_tasks(spark):
    """One symbol with all rows, most of whose events are met many blocks and ranges later."""
    rng = np.random.default_rng(7)
    close = np.r_[np.linspace(100, 50, 6000), np.linspace(50, 99, 2000)] + rng.normal(0, 0.2, 8000)
    series = spark.createDataFrame([("S", "1h", k, float(c)) for k, c in enumerate(close)], "symbol string, tf string, ix long, close double")
    events = series.select("symbol", "tf", "ix", (F.col("close") + 3).alias("up"), F.lit(None).cast("double").alias("down"))
    got = dict(rows_of(first_cross(events, series, rows=128, fan=8).select("ix", "cross_ix"), "ix", "cross_ix"))
    for i in range(0, 8000, 37):
        later = np.flatnonzero(close[i + 1:] > close[i] + 3)
        assert got[i] == (i + 1 + int(later[0]) if len(later) else None), i
    assert sum(v is not None for v in got.values()) > 4000


@pytest.mark.parametrize("strict", [True, False])
def test_first_beyond(strict):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 65, 300):
        hi, lo = rng.integers(0, 20, n).astype(float), rng.integers(-20, 0, n).astype(float)
        start, up, down = rng.integers(0, n + 1, 50), rng.integers(0, 22, 50).astype(float), rng.integers(-22, 0, 50).astype(float)
        up[::5], down[::7] = np.inf, -np.inf
        beyond = (lambda k, j: hi[j] > up[k] or lo[j] < down[k]) if strict else (lambda k, j: hi[j] >= up[k] or lo[j] <= down[k])
        want = [next((j for j in range(start[k], n) if beyond(k, j)), -1) for k in range(50)]
        assert first_beyond(hi, lo, start, up, down, strict).tolist() == want


def brute_snapshot(pdf):
    """Structure of a prefix, from its definition."""
    sw = brute_swings(pdf)
    highs, lows = [s for s in sw if s[0] == "high"], [s for s in sw if s[0] == "low"]
    close = pdf["close"].to_numpy()
    trend = "ranging"
    if len(highs) > 1 and len(lows) > 1:
        h, l = highs[-1][2] - highs[-2][2], lows[-1][2] - lows[-2][2]
        trend = "bullish" if h > 0 and l > 0 else "bearish" if h < 0 and l < 0 else "ranging"
    found = []
    for side, i, p in highs[-5:] + lows[-5:]:
        hit = [j for j in range(i + 1, len(close)) if (close[j] > p if side == "high" else close[j] < p)]
        if hit:
            found.append((hit[0], "bullish" if side == "high" else "bearish"))
    found.sort(key=lambda b: -b[0])
    bos = next((b for b in found if b[1] == trend), (None, None))
    choch = next((b for b in found if b[1] != trend), (None, None))
    if highs and lows:
        eq = (max(s[2] for s in highs[-3:]) + min(s[2] for s in lows[-3:])) / 2
        zone = "premium" if close[-1] >= eq else "discount"
    else:
        zone = "equilibrium"
    return trend, bos[1], bos[0], choch[1], choch[0], zone


@pytest.mark.parametrize("rows", [32, 4096])
def test_point_in_time_equals_the_snapshot_of_every_prefix(spark, rows):
    pdf = random_bars(160, 11)
    pit = structure.point_in_time(spark.createDataFrame(pdf), rows=rows)
    cols = ["trend", "bos_direction", "bos_ix", "choch_direction", "choch_ix", "price_zone"]
    got = {r["ix"]: tuple(r[c] for c in cols) for r in pit.select("ix", *cols).collect()}
    for i in range(len(pdf)):
        assert got[i] == brute_snapshot(pdf[:i + 1].reset_index(drop=True)), i
    snap = structure.snapshot(spark.createDataFrame(pdf)).select(*cols).collect()[0]
    assert tuple(snap) == got[len(pdf) - 1]


def test_break_labels_swap_with_the_trend():
    assert brute_snapshot(random_bars(160, 11))[0] in ("bullish", "bearish", "ranging")


def test_levels_of_a_calm_symbol_are_exact(spark):
    """3000 prices near a million within less than one tolerance band of each other, in several pieces."""
    from math import fsum
    prices = [round(1e6 + 0.0371 * k, 4) for k in range(3000)]
    points = spark.createDataFrame([("S", "1h", "high", k, p) for k, p in enumerate(prices)], "symbol string, tf string, side string, ix long, price double")
    last = spark.createDataFrame([("S", "1h", 1e6, 1.0)], "symbol string, tf string, close double, atr double")
    got = rows_of(structure.liquidity_zones(points, last, tolerance=2e-5), "level", "strength")
    want = {}
    for k, p in enumerate(prices):
        near = [q for q in prices if abs(q - p) <= 20.0]
        level = np.floor(fsum(near) / len(near) * 1e5 + 0.5) / 1e5
        want.setdefault(np.floor(level * 1000 + 0.5), (level, len(near)))
    assert len(got) == len(want) and all(abs(a[0] - b[0]) <= 1.1e-5 and a[1] == b[1] for a, b in zip(got, sorted(want.values())))


def test_liquidity_levels_match_pairwise_clusters(spark):
    pdf = random_bars(400, 13)
    points = structure.swings(spark.createDataFrame(pdf))
    last = spark.createDataFrame([("S", "1h", 100.0, 1.0)], "symbol string, tf string, close double, atr double")
    got = rows_of(structure.liquidity_zones(points, last, tolerance=0.0051), "kind", "strength", "swept", "level")
    tol, now, atr, seen, want = 0.51, 100.0, 1.0, set(), []
    sw = brute_swings(pdf)
    for side in ("high", "low"):
        own = [s for s in sw if s[0] == side]
        for _, _, p in own:
            cluster = [q for _, _, q in own if abs(q - p) <= tol]
            mean = np.mean(cluster)
            level = np.floor(mean * 1e5 + 0.5) / 1e5 if len(cluster) > 1 else p
            raw = mean if len(cluster) > 1 else p
            key = np.floor(level * 1000 + 0.5)
            if key not in seen:
                seen.add(key)
                kind = f"equal_{side}s" if len(cluster) > 1 else f"swing_{side}"
                want.append((kind, len(cluster), bool(now > raw + atr / 2 if side == "high" else now < raw - atr / 2), level))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], atol=1e-5)
