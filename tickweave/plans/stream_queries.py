"""The streaming forms run over the given tables: everything available is processed, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.operators import signals, tradelog
from tickweave.operators.frames import in_frames
from tickweave.plans import sql
from tickweave.plans import zone_queries  # noqa: F401  (registers the statements reused here)
from tickweave.plans.catalogue import ORACLES, present, query
from tickweave.plans.signal_queries import _FB_LIVE, fb_setups
from tickweave.session import prepare
from tickweave.sources import tables
from tickweave.sources.bars import BAR_SCHEMA
from tickweave.streaming import stateful, windows
from tickweave.streaming.run import drain, read_folder, stage, work_folder


def tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = tables.table(spark, sf, "events").schema
    raw = read_folder(spark, f"{sf}/events.parquet", schema)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id"
    )


def bar_stream(spark: SparkSession, sf: str, tf: str = "1h") -> DataFrame:
    """The batch bars as a folder that a stream reads."""
    return read_folder(spark, stage(tables.event_bars(spark, sf, tf), "bars"), BAR_SCHEMA)


_END = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("ss_bars", f"WITH {sql.event_bars('1h')} SELECT {sql.out('symbol', '@ts', '~open', '~high', '~low', '~close', '~volume')} FROM bars WHERE ts + INTERVAL 1 HOUR <= {_END}")
def ss_bars(spark: SparkSession, sf: str) -> DataFrame:
    return present(drain(windows.bars(tick_stream(spark, sf), "1h"), "bars"), "symbol", "ts", "open", "high", "low", "close", "volume")


@query("ss_late", f"""WITH {sql.event_bars('4h', where='isodow(ts) < 6')} SELECT {sql.out('symbol', '@ts', '~open', '~close', '~volume')} FROM bars
WHERE ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events WHERE isodow(ts) < 6) - INTERVAL 10 MINUTE""")
def ss_late(spark: SparkSession, sf: str) -> DataFrame:
    stream = windows.bars(windows.weekdays_only(tick_stream(spark, sf)), "4h")
    return present(drain(stream, "late"), "symbol", "ts", "open", "close", "volume")


@query("ss_indicators", f"WITH {sql.event_bars('1h')}, {sql.core()} SELECT {sql.out('symbol', '@ts', '~atr', '~rsi', '~ema_9', '~ema_21', '~ema_50', '~ema_200', digits=4)} FROM core")
def ss_indicators(spark: SparkSession, sf: str) -> DataFrame:
    out = drain(stateful.indicators(bar_stream(spark, sf)), "indicators")
    return present(out, "symbol", "ts", "atr", "rsi", "ema_9", "ema_21", "ema_50", "ema_200", digits=4)


@query("ss_false_breakout", f"""WITH {sql.event_bars('1h')}, {sql.false_breakout()}, f AS (SELECT *, lead(open) OVER ({sql.W}) AS entry, lead(ts, 2) OVER ({sql.W}) AS available_ts FROM sig)
SELECT {sql.out('symbol', '@ts', '@available_ts', 'signal', '~entry')} FROM f WHERE signal <> 0""")
def ss_false_breakout(spark: SparkSession, sf: str) -> DataFrame:
    out = drain(stateful.false_breakouts(bar_stream(spark, sf)), "traps")
    return present(out, "symbol", "ts", "available_ts", "signal", "entry")


@query("ss_signal_dedupe", ORACLES["sc_dedupe_id"].replace(f"symbol, {sql.tx('ts')} AS ts, direction FROM i", "symbol, direction FROM i"))
def ss_signal_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("signal", signals.false_breakout()(w))

    fired = in_frames(tables.indexed(spark, sf), build, before=10, after=2).filter(F.col("signal") != 0)
    base = fired.select(
        "symbol", "ts", F.when(F.col("signal") > 0, "buy").otherwise("sell").alias("direction"), (F.floor(F.col("close") / 10) * 10.0).alias("entry"),
    )
    again = base.withColumns({"ts": F.col("ts") + F.expr("interval 10 minutes"), "entry": F.col("entry") + 0.001})
    stream = read_folder(spark, stage(base.unionByName(again), "signals"), base.schema)
    return present(drain(windows.dedupe(stream), "dedupe"), "sig_id", "symbol", "direction")


def trade_events(spark: SparkSession, sf: str) -> DataFrame:
    """Setups (known when their third bar closes) and the price every 15 minutes, in one table of events.

    Prices are bar closes, so a busy symbol has no more of them than the clock allows.
    """
    setups = fb_setups(spark, sf).select(
        "symbol", (F.col("ts") + F.expr("interval 3 hours")).alias("ts"), F.lit("signal").alias("kind"),
        F.concat_ws("-", "symbol", F.col("ix").cast("string"), "direction").alias("id"), "direction", "entry", "stop_loss", "tp1", "tp2", "tp3",
        F.lit(None).cast("double").alias("price"),
    )
    none = [F.lit(None).cast("double").alias(c) for c in ("entry", "stop_loss", "tp1", "tp2", "tp3")]
    prices = tables.event_bars(spark, sf, "15m").select(
        "symbol", (F.col("ts") + F.expr("interval 15 minutes")).alias("ts"), F.lit("price").alias("kind"), F.lit("").alias("id"),
        F.lit(None).cast("string").alias("direction"), *none, F.col("close").alias("price"),
    )
    return setups.unionByName(prices)


def _step(k: int) -> str:
    """Trades open at level k after their next decisive price: one target further, or closed."""
    line = "stop_loss" if k == 0 else "entry"
    lost = "CASE WHEN go THEN 'open' ELSE 'closed' END" if k < 2 else "'closed'"
    result = {0: "CASE WHEN NOT go THEN 'loss' END", 1: "CASE WHEN NOT go THEN 'win' END", 2: "'win'"}[k]
    rr = {0: "CASE WHEN NOT go THEN -1.0::DOUBLE END", 1: "CASE WHEN NOT go THEN 0.0::DOUBLE END",
          2: "CASE WHEN go THEN coalesce(abs(tp3 - entry)/nullif(abs(entry - stop_loss), 0), 0) ELSE 0.0::DOUBLE END"}[k]
    return f"""n{k} AS (SELECT s.id, min(p.t) AS nt, arg_min(p.price, p.t) AS np FROM s{k} s JOIN px p ON p.symbol = s.symbol AND p.t > s.t
  AND (s.side*(p.price - s.tp{k + 1}) >= 0 OR s.side*(p.price - s.{line}) <= 0) WHERE s.status = 'open' GROUP BY s.id),
g{k} AS (SELECT s.*, n.nt, side*(np - tp{k + 1}) >= 0 AS go FROM s{k} s JOIN n{k} n ON n.id = s.id),
s{k + 1} AS (SELECT * EXCLUDE (t, status, result, actual_rr, level, nt, go), nt AS t, {lost} AS status, {result} AS result, {rr} AS actual_rr, CASE WHEN go THEN {k + 1} ELSE {k} END AS level FROM g{k})"""


@query("ss_trade_tracking", f"""WITH {sql.event_bars('1h')}, {_FB_LIVE},
px AS (SELECT symbol, b + INTERVAL 15 MINUTE AS t, last(price ORDER BY ts, event_id) AS price
  FROM (SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS b, ts, value AS price, event_id FROM events) GROUP BY symbol, b),
s0 AS (SELECT symbol, symbol || '-' || ix || '-' || direction AS id, CASE direction WHEN 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side, entry, stop_loss, tp1, tp2, tp3,
  ts + INTERVAL 3 HOUR AS t, 'open' AS status, NULL::VARCHAR AS result, NULL::DOUBLE AS actual_rr, 0 AS level FROM fb),
{_step(0)}, {_step(1)}, {_step(2)},
al AS (SELECT * FROM s0 UNION ALL BY NAME SELECT * FROM s1 UNION ALL BY NAME SELECT * FROM s2 UNION ALL BY NAME SELECT * FROM s3)
SELECT symbol, id, {sql.tx('t')} AS ts, status, result, {sql.fx('actual_rr')} AS actual_rr, level FROM al
QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, level DESC) = 1""")
def ss_trade_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Latest state of every trade after the stream's changes went through the versioned sink."""
    events = read_folder(prepare(spark), stage(trade_events(spark, sf), "events"), stateful.EVENT_COLUMNS)
    folder = work_folder(spark, "tracked")
    run = (
        stateful.track_trades(events).writeStream.foreachBatch(stateful.upsert_sink(f"{folder}/changes"))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes").drop("batch")
    latest = tradelog.upsert(changes.limit(0), changes)
    return present(latest, "symbol", "id", "ts", "status", "result", "actual_rr", "level")


@query("ss_limits", ORACLES["cal_trade_limits"])
def ss_limits(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("signal", signals.false_breakout()(w))

    fired = in_frames(tables.indexed(spark, sf), build, before=10, after=2).filter(F.col("signal") != 0)
    fired = fired.select("symbol", "ts", cal.session_of(F.col("ts")).alias("session"), "signal")
    stream = read_folder(spark, stage(fired, "signals"), fired.schema)
    return present(drain(stateful.trade_limits(stream), "limits"), "symbol", "ts", "session", "signal")


@query("ss_rolling_perf", """WITH o AS (SELECT o_orderdate AS t, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O'),
d AS (SELECT t, s, unnest(generate_series(0, 29)) AS k FROM o), w AS (SELECT date_trunc('day', t) - to_days(CAST(k AS INTEGER)) AS a, s FROM d)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(a + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS to_ts, count(*) AS trades, count(CASE s WHEN 'F' THEN 1 END) AS wins,
  floor(count(CASE s WHEN 'F' THEN 1 END)/count(*)*100*1e6 + 0.5)/1e6 AS win_rate FROM w GROUP BY a HAVING a + INTERVAL 30 DAY <= (SELECT max(t) FROM o) - INTERVAL 1 DAY""")
def ss_rolling_perf(spark: SparkSession, sf: str) -> DataFrame:
    schema = tables.table(spark, sf, "orders").schema
    raw = read_folder(spark, f"{sf}/orders.parquet", schema).filter(F.col("o_orderstatus") != "O")
    closed = raw.select(
        F.col("o_orderdate").cast("timestamp").alias("opened_at"), F.when(F.col("o_orderstatus") == "F", "win").otherwise("loss").alias("result")
    )
    return present(drain(windows.rolling_performance(closed), "rolling"))


@query("ss_delayed_feed", f"SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {sql.fx('value')} AS price, event_id FROM events WHERE date_trunc('minute', ts) + INTERVAL 31 MINUTE <= {_END}")
def ss_delayed_feed(spark: SparkSession, sf: str) -> DataFrame:
    out = drain(stateful.delayed_feed(tick_stream(spark, sf), 30), "delayed")
    return present(out, "symbol", "ts", "price", "event_id")
