import numpy as np
import pandas as pd
import pytest
from conftest import bars_of, random_bars, rows_of
from pyspark.sql import functions as F

from tickweave.operators import tradelog, greedy, labels, regime, robustness, stats
from tickweave.operators.frames import block_of, in_frames
from tickweave.plans import research
from tickweave.sources.dims import pairs
from tickweave.operators import signals


def trade(spark, rows, hold=24, **kw):
    pdf = bars_of(rows).assign(atr=2.0, signal=[1] + [0] * (len(rows) - 1))
    framed = in_frames(spark.createDataFrame(pdf), lambda d, w: labels.add_entry(d, w, 1, hold), after=1 + hold)
    return labels.barrier_trades(framed, warm_up=0, **kw).collect()


def test_barriers_tie_time_exit_and_end_of_data(spark):
    head = [(10, 10, 10, 10), (10, 10, 10, 10)]
    # Stop 7, target 14.5 around an entry of 10.
    both = trade(spark, [*head, (10, 15, 6, 10)])[0]
    assert (both["exit_reason"], both["exit_price"], both["pnl_r"], both["exit_ix"]) == ("SL", 7.0, -1.0, 2)
    assert trade(spark, [*head, (10, 15, 6, 10)], sl_first=False)[0]["exit_reason"] == "TP"
    win = trade(spark, [*head, (10, 12, 9, 11), (11, 14.5, 10, 14)])[0]
    assert (win["exit_reason"], win["pnl_r"], win["exit_ix"]) == ("TP", 1.5, 3)
    late = trade(spark, [*head, (10, 12, 9, 11), (11, 12, 9, 11.5), (11, 20, 1, 1)], hold=2)[0]
    assert (late["exit_reason"], late["exit_price"], late["pnl_r"]) == ("TIME_EXIT", 11.5, 0.5)
    assert trade(spark, head)[0]["exit_reason"] == "CLOSE_EXIT"
    assert trade(spark, head[:1]) == []


def brute_trades(pdf, sig, hold=24):
    out = []
    for i in range(15, len(pdf) - 1):
        if sig[i] == 0:
            continue
        entry, d = pdf["open"][i + 1], pdf["atr"][i] * 1.5
        sl, tp, price, why = entry - sig[i] * d, entry + sig[i] * d * 1.5, entry, "CLOSE_EXIT"
        for j in range(i + 2, min(i + 2 + hold, len(pdf))):
            lo, hi = pdf["low"][j], pdf["high"][j]
            if (lo <= sl) if sig[i] > 0 else (hi >= sl):
                price, why = sl, "SL"
                break
            if (hi >= tp) if sig[i] > 0 else (lo <= tp):
                price, why = tp, "TP"
                break
            price, why = pdf["close"][j], "TIME_EXIT"
        out.append((i, why, round(sig[i] * (price - entry) / d, 9)))
    return out


@pytest.mark.parametrize("rows", [32, 4096])
def test_false_breakout_trades_match_a_loop(spark, rows):
    pdf = random_bars(300, 21)
    prev = pdf["close"].shift(1)
    tr = np.maximum(pdf["high"] - pdf["low"], np.maximum((pdf["high"] - prev).abs(), (pdf["low"] - prev).abs()))
    top, low, later = pdf["high"].rolling(10).max().shift(1), pdf["low"].rolling(10).min().shift(1), pdf["close"].shift(-2)
    sig = np.where((pdf["low"] < low) & (later > low), 1, np.where((pdf["high"] > top) & (later < top), -1, 0))
    got = research.false_breakout_trades(spark.createDataFrame(pdf), pairs(spark), rows=rows)
    got = sorted((r["ix"], r["exit_reason"], round(r["pnl_r"], 9)) for r in got.collect())
    assert got and got == brute_trades(pdf.assign(atr=tr.rolling(14).mean()), sig)


def test_costs_are_taken_off_in_units_of_risk(spark):
    got = research.false_breakout_trades(spark.createDataFrame(random_bars(200, 21, "XAUUSD")), pairs(spark)).collect()
    assert got and all(abs((r["pnl_r"] - r["net_pnl_r"]) * r["risk"] - (3.5 + 1.0) * 0.01) < 1e-9 for r in got)


def greedy_loop(trades):
    busy, out = -1, []
    for ix, ex in sorted(trades):
        if ix > busy:
            out.append(ix)
            busy = 10**9 if ex is None else ex
    return out


@pytest.mark.parametrize("rows", [4, 16, 4096])
def test_one_open_trade_at_a_time(spark, rows):
    rng = np.random.default_rng(rows)
    ixs = np.flatnonzero(rng.random(300) < 0.6)
    trades = [(int(i), None if i > 290 and rng.random() < 0.5 else int(i + rng.integers(0, 40))) for i in ixs]
    df = spark.createDataFrame([("S", i, e) for i, e in trades], "symbol string, ix long, exit_ix long")
    got = [ix for (ix,) in rows_of(greedy.non_overlapping(df, ["symbol"], rows=rows), "ix")]
    assert got == greedy_loop(trades)


@pytest.mark.parametrize("rows, fan", [(64, 4), (512, 16)])
def test_greedy_choice_of_a_long_series(spark, rows, fan):
    """10^5 candidates of one symbol in tiny blocks, composed over several levels of the tree."""
    rng = np.random.default_rng(rows)
    ixs = np.flatnonzero(rng.random(140_000) < 0.72)[:100_000]
    exits = ixs + rng.integers(0, 60, len(ixs)) + np.where(rng.random(len(ixs)) < 0.001, 5000, 0)
    trades = list(zip(ixs.tolist(), exits.tolist()))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ix": ixs, "exit_ix": exits}))
    got = [ix for (ix,) in rows_of(greedy.non_overlapping(df, ["symbol"], rows=rows, fan=fan), "ix")]
    assert got == greedy_loop(trades)


def test_signal_on_the_exit_bar_waits(spark):
    df = spark.createDataFrame([("S", 0, 2), ("S", 1, 3), ("S", 2, 4), ("S", 3, 5), ("S", 5, 6), ("S", 6, 7)], "symbol string, ix long, exit_ix long")
    assert rows_of(greedy.non_overlapping(df, ["symbol"]), "ix") == [(0,), (3,), (6,)]


def test_percent_exit_matches_a_loop(spark):
    pdf = random_bars(300, 31)
    close = pdf["close"].to_numpy()
    top, low = pdf["high"].rolling(10).max().shift(1), pdf["low"].rolling(10).min().shift(1)
    got = research.percent_exit_trades(spark.createDataFrame(pdf), signals.breakout(10), rows=64)
    want = []
    for side, name in ((1, "bullish"), (-1, "bearish")):
        entry = None
        for i in range(50, 300):
            fired = (close[i] < low[i]) if side < 0 else (close[i] > top[i] and not close[i] < low[i])
            if entry is None:
                if fired:
                    entry = i
            elif not -0.5 < side * (close[i] / close[entry] - 1) * 100 < 1.0:
                want.append((name, entry, i))
                entry = None
    assert rows_of(got, "direction", "ix", "exit_ix") == sorted(want)


# --- statistics ------------------------------------------------------------------------------

def r_trades(spark, rs, symbol="S", start="2024-01-01"):
    ts = pd.date_range(start, periods=len(rs), freq="7h")
    pdf = pd.DataFrame({"symbol": symbol, "tf": "1h", "ts": ts, "ix": range(len(rs)), "net_pnl_r": np.asarray(rs, dtype=float), "risk": 1.0,
                        "spread_pips": 1.0, "pip_size": 0.01, "year": ts.year, "direction": np.where(np.arange(len(rs)) % 2, "buy", "sell"), "regime": "MIXED"})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("coalesced", ["true", "false"])
@pytest.mark.parametrize("one_day", [False, True])
def test_statistics_match_numpy_whatever_the_pieces(spark, coalesced, one_day):
    rs = np.random.default_rng(3).normal(0.1, 1, 200)
    cum = rs.cumsum()
    mdd = (np.maximum.accumulate(cum) - cum).max()
    trades = r_trades(spark, rs)
    if one_day:
        trades = trades.withColumn("ts", F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("ix")))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        pieces = stats._drawdown_parts(trades, ["symbol"], F.col("net_pnl_r"), ["ts"], {}).count()
        assert pieces > 1 if coalesced == "false" else pieces >= 1
        s = stats.trade_stats(trades, ["symbol"]).collect()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for s in (s,):
        assert s["total_trades"] == 200 and s["wins"] == (rs > 0).sum()
        assert np.isclose(s["mdd_r"], mdd) and np.isclose(s["avg_r"], rs.mean())
        assert np.isclose(s["sharpe"], rs.mean() / rs.std() * np.sqrt(52 * 7 * 24))
        assert np.isclose(s["pf"], rs[rs > 0].sum() / -rs[rs < 0].sum())


def test_only_wins_have_no_profit_factor_and_no_drawdown(spark):
    s = stats.trade_stats(r_trades(spark, [1.0, 0.5, 2.0]), ["symbol"]).collect()[0]
    assert s["pf"] is None and s["mdd_r"] == 0 and s["wr"] == 1


def test_account_compounds_and_draws_down_from_the_start(spark):
    rs = [-1.0, 2.0, -1.0, -1.0, 3.0]
    bal = 10000 * np.cumprod(1 + np.array(rs) * 0.01)
    for rows in (2, 100):
        eq = stats.equity_curve(r_trades(spark, rs), ["symbol"], "net_pnl_r", ["ix"], block_of(rows=rows))
        assert np.allclose([r["equity"] for r in eq.orderBy("ix").collect()], bal)
        acc = stats.account_stats(r_trades(spark, rs).withColumn("hold", F.lit(2)), ["symbol"], "net_pnl_r", "hold", ["ix"], block_of(rows=rows)).collect()[0]
        path = np.r_[10000, bal]
        assert np.isclose(acc["max_drawdown"], ((np.maximum.accumulate(path) - path) / np.maximum.accumulate(path)).max() * 100)
        money = np.diff(path)
        assert np.isclose(acc["best_trade"], money.max()) and np.isclose(acc["profit_factor"], money[money > 0].sum() / -money[money < 0].sum())


def test_as_of_looks_back_over_empty_buckets(spark):
    bars = spark.createDataFrame([("S", "1h", "2024-01-01 00:00:00", "A"), ("S", "1h", "2024-01-05 06:00:00", "B")], "symbol string, tf string, ts string, regime string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ["2023-12-31 00:00:00", "2024-01-01 00:00:00", "2024-01-03 12:00:00", "2024-01-05 05:59:59", "2024-01-05 06:00:00", "2024-01-09 00:00:00"]
    trades = spark.createDataFrame([("S", "1h", r, k) for k, r in enumerate(rows)], "symbol string, tf string, ts string, k int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = rows_of(regime.as_of(trades, bars, bucket_seconds=86400), "k", "regime")
    assert [r for _, r in got] == ["UNKNOWN", "A", "A", "A", "B", "B"]


def test_as_of_by_slots_needs_no_window_over_trades(spark):
    bars = spark.createDataFrame([("S", "1h", "2024-01-01 00:00:00", "A"), ("S", "1h", "2024-01-01 05:00:00", "B")], "symbol string, tf string, ts string, regime string").withColumn("ts", F.col("ts").cast("timestamp"))
    minutes = spark.range(1440).selectExpr("'S' symbol", "'1h' tf", "timestamp'2023-12-31 22:00:00' + make_interval(0, 0, 0, 0, 0, id) ts", "id")  # one symbol, one busy day
    got = regime.as_of_slots(minutes, bars, 3600)
    want = regime.as_of(minutes, bars, bucket_seconds=86400)
    assert rows_of(got, "id", "ts", "regime") == rows_of(want, "id", "ts", "regime")
    counted = dict(rows_of(got.groupBy("regime").count(), "regime", "count"))
    assert counted == {"UNKNOWN": 120, "A": 300, "B": 1020}


# --- robustness ------------------------------------------------------------------------------

RS = np.random.default_rng(5).normal(0.15, 1, 300).round(4)


def test_bootstrap_centres_on_the_sample(spark):
    b = robustness.bootstrap(r_trades(spark, RS), ["symbol"], ["ts"], sims=1500).collect()[0]
    assert b["n_simulations"] == 1500
    assert abs(b["avg_r_mean"] - RS.mean()) < 0.01
    assert abs((b["avg_r_p95"] - b["avg_r_p5"]) / (2 * 1.645) - RS.std() / np.sqrt(len(RS))) < 0.006
    assert b["pf_p5"] < b["pf_median"] < b["pf_p95"]


@pytest.mark.parametrize("rows", [64, 4096])
def test_shuffling_keeps_the_final_balance(spark, rows):
    p = robustness.permutation_drawdown(r_trades(spark, RS), ["symbol"], ["ts"], sims=300, rows=rows).collect()[0]
    final = 1000 * np.prod(1 + RS * 0.01)
    assert p["n_simulations"] == 300 and p["prob_ruin"] == 0
    assert all(np.isclose(p[c], final) for c in ("mean_final", "median_final", "p5_final", "p95_final"))
    rng, dds = np.random.default_rng(0), []
    for _ in range(2000):
        path = np.r_[1.0, np.cumprod(1 + rng.permutation(RS) * 0.01)]
        dds.append(((np.maximum.accumulate(path) - path) / np.maximum.accumulate(path)).max() * 100)
    assert abs(p["mean_max_dd_pct"] - np.mean(dds)) < 0.5 and abs(p["p95_max_dd_pct"] - np.percentile(dds, 95)) < 1.5


@pytest.mark.parametrize("rows", [32, 4096])
def test_removing_winners_never_helps(spark, rows):
    got = robustness.trade_removal(r_trades(spark, RS), ["symbol"], ["ts"], sims=200, rows=rows).orderBy("share").collect()
    wins, losses = RS[RS > 0], -RS[RS < 0].sum()
    base = wins.sum() / losses
    for g, share in zip(got, (0.1, 0.2, 0.3)):
        k = int(len(wins) * share)
        assert g["n_removed"] == k and g["mean_pf"] < base
        assert abs(g["mean_pf"] - (wins.sum() - k * wins.mean()) / losses) < 0.02


def test_resampling_is_one_path_for_every_size(spark):
    trades = r_trades(spark, RS).persist()
    for test in (robustness.permutation_drawdown, robustness.trade_removal):
        small, large = (test(trades, ["symbol"], ["ts"], sims=100, rows=rows).collect() for rows in (40, 300))
        assert len(small) == len(large) > 0
        assert all(np.isclose(a[c], b[c]) for a, b in zip(sorted(small), sorted(large)) for c in a.asDict() if c != "symbol")


def test_walk_forward_uses_equal_folds(spark):
    got = robustness.walk_forward(r_trades(spark, RS), ["symbol"], ["ts"], block_of(rows=50)).orderBy("fold").collect()
    assert [g["fold"] for g in got] == [1, 2, 3, 4, 5] and all(g["train_trades"] == g["test_trades"] == 50 for g in got)
    part = RS[50:100]
    assert np.isclose(got[0]["test_pf"], part[part > 0].sum() / -part[part < 0].sum())
    assert robustness.walk_forward(r_trades(spark, RS[:19]), ["symbol"], ["ts"], block_of()).count() == 0


def test_stress_starts_from_the_net_result(spark):
    got = {r["mult"]: r["avg_r"] for r in robustness.spread_stress(r_trades(spark, RS), ["symbol"]).collect()}
    assert np.isclose(got[1.0], RS.mean()) and np.isclose(got[3.0], RS.mean() - 0.02)


def test_suite_and_verdict(spark):
    table = robustness.suite(r_trades(spark, RS).persist(), ["symbol"], slice_expr=block_of(), sims=200, removal_sims=50).persist()
    tests = {r["test"].split(":")[0] for r in table.select("test").distinct().collect()}
    assert tests == {"baseline", "year", "walk_forward", "spread", "permutation", "bootstrap", "removal", "regime", "direction"}
    v = robustness.verdict(table, ["symbol"]).collect()[0]
    assert v["verdict"].startswith({True: "PASS", False: "MARGINAL" if v["score"] >= 3 else "FAIL"}[v["score"] >= 5]) and v["details"].count(",") == 5


def test_overlaps_count_opposite_pairs_of_a_symbol_and_day(spark):
    def made(rows):
        return spark.createDataFrame(rows, "symbol string, ts string, direction string").withColumn("ts", F.col("ts").cast("timestamp"))
    a = made([("X", "2024-01-01 01:00:00", "buy"), ("X", "2024-01-01 02:00:00", "buy"), ("Y", "2024-01-01 01:00:00", "buy")])
    b = made([("X", "2024-01-01 09:00:00", "sell"), ("X", "2024-01-01 10:00:00", "buy"), ("Y", "2024-01-02 01:00:00", "sell")])
    assert rows_of(robustness.overlaps(a, b), "symbol", "conflicts") == [("X", 2)]


def test_gap_grid_contains_the_single_run(spark):
    rng = np.random.default_rng(8)
    pdf = random_bars(400, 17, "EURUSD", "1d", "2020-01-01")
    pdf["open"] += rng.normal(size=400)
    bars = spark.createDataFrame(pdf)
    grid = research.gap_grid_trades(bars, pairs(spark))
    assert grid.groupBy("min_gap", "sl_atr", "max_hold").count().count() == 48
    one = rows_of(grid.filter("min_gap = 0.3 and sl_atr = 1.0 and max_hold = 5"), "ix", "exit_reason", "exit_price")
    assert one and one == rows_of(research.gap_trades(bars, pairs(spark)), "ix", "exit_reason", "exit_price")


def test_a_trade_followed_through_all_prices(spark):
    path = [100, 101, 99, 111, 100.5, 121, 131, 100, 90, 80, 100]
    prices = spark.createDataFrame([("S", "1h", k, float(p)) for k, p in enumerate(path)], "symbol string, tf string, ix long, price double")
    rows = [("a", 0, "buy", 100.0, 90.0, 110.0, 120.0, 130.0), ("b", 3, "buy", 111.0, 95.0, 120.0, 130.0, 140.0), ("c", 6, "sell", 131.0, 140.0, 121.0, 101.0, 85.0),
            ("d", 6, "buy", 131.0, 95.0, 140.0, 150.0, None), ("e", 9, "buy", 80.0, 70.0, 90.0, 110.0, 120.0), ("f", 6, "buy", 131.0, None, 140.0, 150.0, 160.0),
            ("g", 4, "buy", 100.5, 90.0, 101.0, 102.0, 140.0)]
    trades = spark.createDataFrame([("S", "1h", i, *r) for r in rows for i in [r[1]]], "symbol string, tf string, ix long, id string, at long, direction string, entry double, stop_loss double, tp1 double, tp2 double, tp3 double")
    for block in (2, 4096):
        got = rows_of(tradelog.monitor_path(trades, prices, rows=block), "id", "ix", "level", "closed_ix", "status", "result", "actual_rr")
        assert got == [
            ("a", 0, 3, 6, "closed", "win", 3.0), ("b", 3, 2, 7, "closed", "win", 0.0), ("c", 6, 3, 9, "closed", "win", 46.0 / 9), ("d", 6, 0, 8, "closed", "loss", -1.0),
            ("e", 9, 1, None, "open", None, None), ("f", 6, 0, None, "open", None, None), ("g", 4, 2, 7, "closed", "win", 0.0)]
