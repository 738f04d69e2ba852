import math

import pandas as pd
import pytest
from conftest import bars_of, random_bars, rows_of
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.functions.numbers import format_price
from tickweave.operators import quality, risk, rules, tradelog
from tickweave.sources import bars as src
from tickweave.sources import dims, sinks


def times(spark, *ts):
    return spark.createDataFrame([(t,) for t in ts], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_session_edges(spark):
    df = times(spark, *[f"2024-01-05 {h:02d}:00:00" for h in (0, 7, 8, 12, 15, 16, 20, 21)], "2024-01-06 10:00:00")
    got = df.select("ts", cal.session_of(F.col("ts")).alias("s"), cal.session_allowed(F.col("ts")).alias("ok")).orderBy("ts").collect()
    assert [r["s"] for r in got] == ["asia", "london", "london", "overlap", "overlap", "new_york", "new_york", "dead_zone", "london"]
    assert [r["ok"] for r in got] == [False, True, True, True, True, True, True, False, False]


def test_day_filter_prefers_avoid_and_falls_back(spark):
    df = spark.createDataFrame([("GBPJPY", "2024-01-03"), ("GBPJPY", "2024-01-04"), ("NONE", "2024-01-01"), ("NONE", "2024-01-02")], "symbol string, ts string")
    got = rules.with_day_filter(df.withColumn("ts", F.col("ts").cast("timestamp")), dims.pairs(spark))
    assert [r["day_filter"] for r in got.orderBy("symbol", "ts").collect()] == ["avoid", "best", "avoid", "neutral"]


def test_news_window_edges(spark):
    from datetime import datetime, timedelta
    at = datetime(2024, 1, 1, 12)
    news = spark.createDataFrame([("n", "high", "EUR", at), ("low", "low", "EUR", at - timedelta(hours=3)), ("jpy", "high", "JPY", at - timedelta(hours=5))], "title string, impact string, currency string, ts timestamp")
    minutes = {0: False, -30: True, -31: False, 15: True, 16: False, -180: False, -290: False}
    bars = spark.createDataFrame([("EURUSD", at + timedelta(minutes=m)) for m in minutes], "symbol string, ts timestamp")
    got = rules.news_blackout(bars, news, dims.pairs(spark)).collect()
    assert {int((r["ts"] - at).total_seconds() / 60): r["blocked"] for r in got} == minutes
    text = {int((r["ts"] - at).total_seconds() / 60): r["reason"] for r in got}
    assert text[-30] == "High-impact news in 30m: n" and text[15] == "Post-news blackout (15m ago): n" and text[0] == ""
    other = spark.createDataFrame([("UNKNOWN", at - timedelta(minutes=5))], "symbol string, ts timestamp")
    assert rows_of(rules.news_blackout(other, news, dims.pairs(spark)), "blocked") == [(False,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trade_limits_match_a_loop(spark, seed):
    pdf = random_bars(300, seed)[["symbol", "ts"]].sample(200, random_state=seed)
    pdf["session"] = [["asia", "london", "overlap", "new_york"][h % 4] for h in pdf["ts"].dt.hour]
    pdf["symbol"] = [f"s{i}" for i in range(len(pdf))]
    day, sess, want = {}, {}, []
    for r in pdf.sort_values(["ts", "symbol"]).itertuples():
        d = r.ts.date()
        if day.get(d, 0) < 5 and sess.get((d, r.session), 0) < 3:
            day[d], sess[d, r.session] = day.get(d, 0) + 1, sess.get((d, r.session), 0) + 1
            want.append((r.symbol,))
    assert rows_of(rules.trade_limits(spark.createDataFrame(pdf)), "symbol") == sorted(want)


def test_risk_profile_and_size(spark):
    df = spark.createDataFrame([(2400.0, 2390.0, 2415.0, 2425.0, 2435.0), (2400.0, 2390.0, 2405.0, 2425.0, 2435.0), (1.1, 1.1, 1.2, 1.3, 1.4), (1.1, 1.099, 1.103, 1.104, 1.105)], "entry double, stop_loss double, tp1 double, tp2 double, tp3 double")
    got = risk.risk_profile(df, F.lit(10000.0), F.lit(1.0)).collect()
    assert [(r["valid"], r["rr_tp1"], r["position_size"], r["risk_amount"]) for r in got] == [(True, 1.5, 0.1, 100.0), (False, 0.5, 0.0, 0.0), (False, 0.0, 0.0, 0.0), (True, 3.0, 1.0, 100.0)]
    lots = df.select(risk.position_size(F.lit(10000.0), F.lit(1.0), F.col("entry"), F.col("stop_loss")).alias("x")).collect()
    assert lots[2]["x"] == 0.0


def test_price_format(spark):
    df = spark.createDataFrame([("XAUUSD", 2400.456), ("USDJPY", 150.1234), ("EURUSD", 1.1234567)], "s string, p double")
    assert [r[0] for r in df.select(format_price(F.col("p"), F.col("s"))).collect()] == ["2400.46", "150.123", "1.12346"]


def test_symbol_map_defaults(spark):
    df = spark.createDataFrame([("XAUUSD", "1d"), ("ODD", "2h")], "symbol string, tf string")
    assert rows_of(dims.symbol_map(df), "symbol", "vendor_code", "fallback_code", "interval_code") == [("ODD", "ODD", "ODD", "1h"), ("XAUUSD", "XAU/USD", "GC=F", "1day")]


def test_signal_ids_repeat_within_the_hour(spark):
    df = spark.createDataFrame([("X", "buy", 1.234, "2024-01-01 10:05:00"), ("X", "buy", 1.2349, "2024-01-01 10:59:00"), ("X", "buy", 1.234, "2024-01-01 11:00:00"), ("X", "sell", 1.234, "2024-01-01 10:05:00")], "symbol string, direction string, entry double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rules.dedupe(df).count() == 3
    import hashlib
    ids = {r["sig_id"] for r in rules.dedupe(df).collect()}
    assert hashlib.md5(b"X:buy:1.23:2024010110").hexdigest()[:12] in ids


# --- sources ---------------------------------------------------------------------------------

def test_dirty_bars_are_cleaned(spark):
    rows = [("1", "2", "0.5", "1.5", "5", "2024-01-05 10:00:00"), ("x", "2", "1", "1", "5", "2024-01-05 11:00:00"), ("1", "Infinity", "1", "1", "5", "2024-01-05 12:00:00"),
            ("1", "2", "NaN", "1", "5", "2024-01-05 13:00:00"), ("1", "2", "0.5", "1.5", "-3", "2024-01-05 14:00:00"), ("1", "2", "0.5", "1.5", None, "2024-01-05 15:00:00"), ("1", "2", "0.5", "1.5", "1", "2024-01-06 10:00:00")]
    df = spark.createDataFrame([("S", "1h", *r) for r in rows], "symbol string, tf string, open string, high string, low string, close string, volume string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = src.sanitize(df).orderBy("ts").collect()
    assert [(r["ts"].hour, r["volume"]) for r in got] == [(10, 5.0), (14, 0.0), (15, 0.0)]
    assert src.sanitize(df.filter("ts >= '2024-01-06'")).count() == 1
    assert src.sanitize(df, keep=2).count() == 1


def test_resample_orders_and_drops_empty_buckets(spark):
    pdf = bars_of([(i, i + 2, i - 1, i + 1) for i in range(1, 11)], start="2024-01-01 22:00:00")
    pdf = pdf[~pdf["ts"].dt.hour.isin([4, 5])].sample(frac=1, random_state=1)
    got = src.resample(spark.createDataFrame(pdf.drop(columns="ix")), "4h").orderBy("ts").collect()
    assert [(r["ts"].hour, r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(20, 1.0, 4.0, 0.0, 3.0, 2.0), (0, 3.0, 8.0, 2.0, 7.0, 4.0), (4, 9.0, 12.0, 8.0, 11.0, 2.0)]


def test_ties_in_time_use_the_second_order(spark):
    df = spark.createDataFrame([("S", "2024-01-01 10:00:00", 2, 5.0), ("S", "2024-01-01 10:00:00", 1, 4.0), ("S", "2024-01-01 10:59:59", 7, 9.0), ("S", "2024-01-01 10:59:59", 9, 8.0)], "symbol string, ts string, k int, price double")
    got = src.bars_from_ticks(df.withColumn("ts", F.col("ts").cast("timestamp")), "1h", tie=["k"]).collect()[0]
    assert (got["open"], got["close"], got["high"], got["low"], got["volume"]) == (4.0, 8.0, 9.0, 4.0, 4.0)


def test_normalize_needs_prices(spark):
    with pytest.raises(ValueError, match="close"):
        src.normalize(spark.createDataFrame([("S", 1.0, 1.0, 1.0)], "symbol string, Open double, High double, Low double"))
    with pytest.raises(ValueError, match="volume"):
        src.check_bars(spark.createDataFrame([("S",)], "symbol string"))


def test_csv_and_parquet_round_trip(spark, tmp_path):
    pdf = random_bars(20, symbol="EURUSD")
    pdf[["ts", "open", "high", "low", "close", "volume"]].to_csv(tmp_path / "EURUSD_1h.csv", index=False)
    got = src.check_bars(src.read_bars_csv(spark, str(tmp_path)))
    assert got.count() == 20 and rows_of(got.select("symbol", "tf").distinct(), "symbol", "tf") == [("EURUSD", "1h")]
    sinks.write_table(got, str(tmp_path / "t"), ["tf", "symbol"])
    back = src.read_bars_parquet(spark, str(tmp_path / "t"), ["EURUSD"], "1h")
    assert math.isclose(back.agg(F.sum("close")).collect()[0][0], pdf["close"].sum())
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().explainString(back._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_last_n_min_history_and_range(spark):
    df = spark.createDataFrame(pd.concat([random_bars(30, symbol="A"), random_bars(10, symbol="B")]))
    assert rows_of(src.last_n(df, 12).groupBy("symbol").count(), "symbol", "count") == [("A", 12), ("B", 10)]
    assert rows_of(src.min_history(df, 11).groupBy("symbol").count(), "symbol", "count") == [("A", 30)]
    assert src.date_range(df, "2024-01-01 02:00:00", "2024-01-01 04:00:00").count() == 6


def test_sources_are_compared(spark):
    day = bars_of([(1, 1, 1, 100), (1, 1, 1, 100)], tf="1d").drop(columns="ix")
    near = bars_of([(1, 1, 1, 100.05)] * 48, tf="1h").drop(columns="ix")
    daily = pd.concat([day.assign(symbol=s) for s in ("PASS", "WARN", "FAIL", "GAP")])
    hourly = pd.concat([near.assign(symbol="PASS"), near.assign(symbol="WARN", close=100.3), near.assign(symbol="FAIL", close=102.0), near.assign(symbol="GAP", ts=near["ts"] + pd.Timedelta(days=9))])
    names = spark.createDataFrame([(s,) for s in ("PASS", "WARN", "FAIL", "GAP", "NONE")], "symbol string")
    out = quality.cross_validate(names, spark.createDataFrame(daily), spark.createDataFrame(hourly))
    assert dict(rows_of(out, "symbol", "status")) == {"PASS": "PASS", "WARN": "WARNING", "FAIL": "FAIL", "GAP": "NO_OVERLAP", "NONE": "INCOMPLETE_DATA"}
    assert dict(rows_of(quality.status_report(out), "status", "symbols")) == {"PASS": 1, "WARNING": 1, "FAIL": 1, "INCOMPLETE": 2}


# --- trade log -------------------------------------------------------------------------------

def test_monitoring_one_target_per_pass(spark):
    cols = "id string, symbol string, direction string, entry double, stop_loss double, tp1 double, tp2 double, tp3 double, tp1_hit int, tp2_hit int, tp3_hit int, be_moved int"
    base = (100.0, 90.0, 115.0, 125.0, 135.0)
    rows = [("fresh", "UP", "buy", *base, 0, 0, 0, 0), ("second", "UP", "buy", *base, 1, 0, 0, 1), ("third", "UP", "buy", *base, 1, 1, 0, 1), ("stop", "DOWN", "buy", *base, 0, 0, 0, 0),
            ("even", "DOWN", "buy", *base, 1, 0, 0, 1), ("none", "GONE", "buy", *base, 0, 0, 0, 0), ("short", "DOWN", "sell", 100.0, 110.0, 85.0, 75.0, 65.0, 0, 0, 0, 0)]
    px = spark.createDataFrame([("UP", 1, 90.0), ("UP", 2, 140.0), ("DOWN", 1, 80.0)], "symbol string, ts int, price double")
    got = {r["id"]: (r["new_tp"], r["status"], r["result"], r["actual_rr"], r["be_moved"]) for r in tradelog.monitor(spark.createDataFrame(rows, cols), px).collect()}
    assert got == {"fresh": (1, "open", None, None, 1), "second": (2, "open", None, None, 1), "third": (3, "closed", "win", 3.5, 1), "stop": (None, "closed", "loss", -1.0, 0),
                   "even": (None, "closed", "win", 0.0, 1), "none": (None, "open", None, None, 0), "short": (1, "open", None, None, 1)}


def test_upsert_keeps_the_last_write(spark):
    cols = "id string, status string, version int"
    log = spark.createDataFrame([("a", "open", 1), ("b", "open", 1)], cols)
    new = spark.createDataFrame([("b", "closed", 3), ("b", "half", 2), ("c", "open", 1)], cols)
    assert rows_of(tradelog.upsert(log, new), "id", "status") == [("a", "open"), ("b", "closed"), ("c", "open")]


def test_reports_of_an_empty_period(spark):
    log = spark.createDataFrame([("1", "X", "closed", "win", 2.0, "asia", "2020-01-01")], "id string, symbol string, status string, result string, actual_rr double, session string, opened_at string").withColumn("opened_at", F.col("opened_at").cast("timestamp"))
    got = tradelog.performance(log, F.lit("2024-01-01").cast("timestamp")).collect()[0]
    assert tuple(got) == (0, 0, 0, 0.0, 0.0, "N/A")
