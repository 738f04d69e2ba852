import numpy as np
import pytest
from conftest import bars_of, random_bars, rows_of
from pyspark.sql import functions as F

from tickweave.operators import open_zones, scoring, structure, zones

FLAT = (100, 100.5, 99.5, 100)


def blocks(spark, rows, atr=2.0):
    return zones.order_blocks(spark.createDataFrame(bars_of(rows).assign(atr=atr)))


def test_order_block_needs_a_body_and_two_atr(spark):
    base = [FLAT] * 4
    exact = [*base, (100, 100.2, 99, 99.5), (99.5, 103, 99.4, 102), (102, 102.5, 101, 102)]
    assert rows_of(blocks(spark, exact), "ix", "kind", "top", "bottom", "mitigated", "strength") == [(4, "bullish", 100.0, 99.0, False, 2.0)]
    less = [*base, (100, 100.2, 99, 99.5), (99.5, 102.99, 99.4, 102), (102, 102.5, 101, 102)]
    assert rows_of(blocks(spark, less), "ix") == []
    doji = [*base, (99.6, 100.2, 99, 99.5), (99.5, 103, 99.4, 102), (102, 102.5, 101, 102)]
    assert rows_of(blocks(spark, doji), "ix") == []


def test_order_block_is_mitigated_by_a_later_close_and_bearish_mirrors(spark):
    rows = [FLAT] * 4 + [(100, 100.2, 99, 99.5), (99.5, 103, 99.4, 102), (102, 102.5, 98, 98.5)]
    got = [r for r in rows_of(blocks(spark, rows), "ix", "kind", "mitigated")]
    assert (4, "bullish", True) in got
    rows = [FLAT] * 4 + [(100, 101, 99.9, 100.5), (100.5, 100.6, 96, 97), (97, 97.5, 96.5, 97)]
    assert rows_of(blocks(spark, rows), "ix", "kind", "top", "bottom", "mitigated") == [(4, "bearish", 101.0, 100.0, False)]


@pytest.mark.parametrize("rows_per_block", [2, 4096])
def test_gap_of_exactly_the_smallest_size_is_kept_and_touch_fills(spark, rows_per_block):
    rows = [(10, 10, 9, 10), (10, 12, 10, 12), (12, 13, 10.5, 12), (12, 13, 11, 12), (12, 13, 10.25, 12)]
    bars = spark.createDataFrame(bars_of(rows).assign(atr=2.0))
    gaps = zones.fair_value_gaps(bars, structure.last_bars(bars, "atr"), 0.25, rows=rows_per_block)
    assert rows_of(gaps, "ix", "kind", "top", "bottom", "filled") == [(2, "bullish", 10.5, 10.0, False)]
    filled = spark.createDataFrame(bars_of([*rows, (12, 12, 10, 11)]).assign(atr=2.0))
    gaps = zones.fair_value_gaps(filled, structure.last_bars(filled, "atr"), 0.25, rows=rows_per_block)
    assert rows_of(gaps.filter("ix = 2"), "filled") == [(True,)]


def setup(spark, **kw):
    row = dict(direction="buy", close=100.0, atr=2.0, price_zone="discount", fib_confluence=False, confirmation="none", bos_direction=None, choch_direction=None)
    row |= kw
    schema = "direction string, close double, atr double, price_zone string, fib_confluence boolean, confirmation string, bos_direction string, choch_direction string"
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)
    ob = row.get("ob")
    zone = "struct<top:double,bottom:double,strength:double,ix:bigint>"
    made = F.lit(None).cast(zone) if ob is None else F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("top", "bottom", "strength"), ob)], F.lit(1).cast("long").alias("ix"))
    return df.withColumns({"ob": made, "fvg": F.lit(None).cast("struct<top:double,bottom:double,ix:bigint>")})


def test_entry_setup_rules(spark):
    got = zones.build_entry(setup(spark, bos_direction="bullish")).collect()[0]
    assert (got["stop_loss"], got["tp1"], got["tp3"], got["rr_tp1"]) == (97.0, 104.5, 110.5, 1.5)
    assert got["reason"] == "ATR-based entry (discount zone), BOS confirmed" and got["atr_fallback"]
    assert zones.build_entry(setup(spark, price_zone="premium")).count() == 0
    assert zones.build_entry(setup(spark, price_zone="equilibrium")).count() == 0
    got = zones.build_entry(setup(spark, price_zone="equilibrium", ob=(100.5, 99.0, 2.5))).collect()[0]
    assert got["stop_loss"] == 98.4 and got["reason"] == "Buy OB (strength 2.50×)" and not got["atr_fallback"]
    sell = zones.build_entry(setup(spark, direction="sell", price_zone="premium")).collect()[0]
    assert (sell["stop_loss"], sell["tp1"]) == (103.0, 95.5)


def test_price_in_zone_buffer_and_fib(spark):
    df = spark.createDataFrame([(100.02,), (100.011,), (98.99,), (98.98,)], "p double")
    got = df.select(zones.price_in_zone(F.col("p"), F.lit(100.0), F.lit(99.0), 0.001).alias("x")).collect()
    assert [r["x"] for r in got] == [False, True, True, False]
    lv = df.limit(1).select(F.inline(zones.fib_levels(F.lit(110.0), F.lit(100.0)))).collect()
    assert [(r["ratio"], r["level"], r["kind"]) for r in lv] == [(0.5, 105.0, "support"), (0.618, 103.82, "support"), (0.786, 102.14, "support")]


def score_row(spark, **kw):
    row = dict(direction="buy", trend="bullish", bos_direction="bullish", choch_direction="bullish", price_zone="discount", fib_confluence=True,
               confirmation="engulfing", session="overlap", ob_strength=2.5, has_fvg=True, rsi_signal="bullish", rsi_divergence=True, ema_bias="bullish", volume_elevated=True)
    row |= kw
    types = {bool: "boolean", float: "double", str: "string"}
    schema = ", ".join(f"{k} {types.get(type(v), 'double')}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def test_score_caps_and_limits(spark):
    best = scoring.score(score_row(spark), news_configured=True).collect()[0]
    assert best["breakdown"] == {"market_structure": 5, "entry_zone": 4, "indicators": 3, "strategy_confluence": 0, "session_timing": 3, "news_clear": 2}
    assert (best["total"], best["max_possible"], best["confidence_pct"], best["passed"], best["reject_reason"]) == (17, 20, 85.0, True, "")
    edge = scoring.score(score_row(spark, bos_direction="bearish", choch_direction="bearish", ob_strength=None, has_fvg=False, rsi_divergence=False)).collect()[0]
    assert (edge["total"], edge["confidence_pct"], edge["passed"]) == (3 + 2 + 3 + 3, 55.0, True)
    poor = scoring.score(score_row(spark, trend="ranging", bos_direction="bearish", choch_direction="bearish", ob_strength=None, has_fvg=False)).collect()[0]
    assert not poor["passed"] and poor["reject_reason"] == "Score 9/20 below threshold (11)"
    weak = scoring.score(score_row(spark, ob_strength=1.5, has_fvg=False, fib_confluence=False, confirmation="none")).collect()[0]
    assert weak["breakdown"]["entry_zone"] == 1


def test_routing(spark):
    cols = "symbol string, tf string, confidence double, strategy string"
    keys = [(s, "1h") for s in "abcdef"]
    smc = spark.createDataFrame([(s, "1h", 60.0, "smc") for s in "abcde"], cols)
    fb = spark.createDataFrame([("a", "1h", 60.0, "fb"), ("b", "1h", 70.0, "fb"), ("c", "1h", 70.0, "fb"), ("d", "1h", 50.0, "fb"), ("f", "1h", 50.0, "fb")], cols)
    regime = spark.createDataFrame([(*k, r) for k, r in zip(keys, ("UNKNOWN", "UNKNOWN", "TRENDING", "QUIET", "QUIET", "VOLATILE"))], "symbol string, tf string, regime string")
    assert rows_of(scoring.route(smc, fb, regime), "symbol", "strategy") == [("a", "smc"), ("b", "fb"), ("c", "smc"), ("d", "fb"), ("e", "smc"), ("f", "fb")]


def slow_zones(pdf, keep):
    """Per bar and direction the open block and gap that hold the close, from the bars up to it alone."""
    o, h, l, c, atr = (pdf[x].to_numpy() for x in ("open", "high", "low", "close", "atr"))
    inside = lambda p, top, bottom: bottom - (top - bottom) * 0.002 - top * 0.0001 <= p <= top + (top - bottom) * 0.002 + top * 0.0001
    out = []
    for t in range(len(c)):
        best = {}
        for i in range(max(3, t - 19), t):
            bull, later = o[i] > c[i], slice(i + 1, min(i + 5, t) + 1)
            if o[i] == c[i] or abs(o[i] - c[i]) < atr[t] * 0.1:
                continue
            impulse = h[later].max() - l[i] if bull else h[i] - l[later].min()
            dead = (c[i + 1 : t + 1] < l[i]).any() if bull else (c[i + 1 : t + 1] > h[i]).any()
            top, bottom = (o[i], l[i]) if bull else (h[i], o[i])
            if impulse >= atr[t] * 2 and not dead and inside(c[t], top, bottom):
                strength = np.floor(min(3.0, impulse / atr[t]) * 100 + 0.5) / 100
                best.setdefault("buy" if bull else "sell", []).append((strength, i))
        tall = [g for i in range(2, t + 1) for g in [(i, 1, l[i], h[i - 2])] * int(h[i - 2] < l[i]) + [(i, -1, l[i - 2], h[i])] * int(l[i - 2] > h[i]) if g[2] - g[3] >= atr[t] * 0.3]
        for name, side in (("buy", 1), ("sell", -1)):
            open_gaps = [i for i, s, top, bottom in tall[-keep:] if s == side and inside(c[t], top, bottom) and not ((l[i + 1 : t + 1] <= bottom).any() if s > 0 else (h[i + 1 : t + 1] >= top).any())]
            out.append((t, name, max(best[name])[1] if name in best else None, open_gaps[-1] if open_gaps else None))
    return out


@pytest.mark.parametrize("rows, fan, keep", [(20, 2, 2), (32, 64, 20), (4096, 64, 3)])
def test_open_zones_match_a_loop_and_know_no_future(spark, rows, fan, keep):
    rng = np.random.default_rng(rows)
    pdf = random_bars(260, 3)
    pdf["atr"] = rng.uniform(0.2, 1.5, len(pdf)) * (pdf["high"] - pdf["low"]).mean()
    found = open_zones.zones_as_of(spark.createDataFrame(pdf), keep=keep, rows=rows, fan=fan)
    got = rows_of(found, "ix", "direction", "ob_ix", "fvg_ix")
    want = slow_zones(pdf, keep)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] is not None for r in want) > 10 and sum(r[3] is not None for r in want) > 10
    part = open_zones.zones_as_of(spark.createDataFrame(pdf[:140]), keep=keep, rows=rows, fan=fan)
    assert sorted(rows_of(part, "ix", "direction", "ob_ix", "fvg_ix"), key=str) == sorted([r for r in want if r[0] < 140], key=str)


def test_skyband_keeps_all_that_can_be_chosen():
    rng = np.random.default_rng(1)
    table = np.stack([np.arange(300), np.ones(300), rng.integers(1, 30, 300), np.zeros(300), np.full(300, np.inf)], axis=1).astype(float)
    band = {int(r[0]) for r in open_zones.skyband(table, 4)}
    for least in range(31):
        tall = [int(r[0]) for r in table if r[2] - r[3] >= least]
        assert set(tall[-4:]) <= band
    assert len(band) < 60
