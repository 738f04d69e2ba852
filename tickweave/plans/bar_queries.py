"""Queries on sources, bars and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators import indicators as ind
from tickweave.operators.frames import in_frames
from tickweave.plans import sql
from tickweave.plans.catalogue import present, query
from tickweave.sources import bars as src
from tickweave.sources import dims, sinks, tables
from tickweave.streaming.run import work_folder

BARS_OUT = ("symbol", "tf", "@ts", "~open", "~high", "~low", "~close", "~volume")


@query("bars_from_ticks", f"WITH {sql.event_bars('1h')} SELECT {sql.out(*BARS_OUT)} FROM bars")
def bars_from_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return present(tables.event_bars(spark, sf))


@query("src_bars_csv", f"WITH {sql.event_bars('1h')} SELECT {sql.out(*BARS_OUT)} FROM bars")
def src_bars_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written as CSV in symbol and timeframe folders, read back with an explicit schema."""
    folder = work_folder(spark, "bars-csv")
    sinks.write_table(tables.event_bars(spark, sf), folder, ["symbol", "tf"], "csv")
    return present(src.check_bars(src.read_bars_csv(spark, folder, names=src.FOLDER_NAMES)))


@query("sink_tables", f"WITH {sql.event_bars('1h')} SELECT {sql.out(*BARS_OUT)} FROM bars")
def sink_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written as Parquet partitioned by timeframe and symbol, read back whole."""
    folder = work_folder(spark, "bars")
    sinks.write_table(tables.event_bars(spark, sf), folder, ["tf", "symbol"])
    return present(src.read_bars_parquet(spark, folder, tf="1h"))


@query("src_bars_daily", f"""WITH {sql.daily_bars()}, {sql.atr_sma()}
SELECT {sql.out(*BARS_OUT, 'ix', '~atr')} FROM atrs""")
def src_bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    out = in_frames(tables.indexed_daily(spark, sf), ind.add_atr_sma, before=15)
    return present(out)


@query("bars_normalize", f"""SELECT event_type AS symbol, {sql.tx('ts')} AS ts, {sql.fx('value')} AS open, {sql.fx('value')} AS high,
  {sql.fx('value')} AS low, {sql.fx('value')} AS close, 0.0::DOUBLE AS volume
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND nullif(value, 0) IS NOT NULL""")
def bars_normalize(spark: SparkSession, sf: str) -> DataFrame:
    # Single ticks as vendor bars with upper-case names; a price of 0 stands for a missing one.
    price = F.when(F.col("value") != 0, F.col("value"))
    raw = tables.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", *[price.alias(c) for c in ("Open", "High", "Low", "Close")]
    )
    return present(src.normalize(raw))


@query("bars_sanitize", f"""WITH {sql.event_bars('1h')},
c AS (SELECT symbol, tf, ts, open, high, low, close, greatest(volume - 3, 0) AS volume FROM bars
      WHERE open <> 0 AND low <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM c QUALIFY r <= 100),
m AS (SELECT *, bool_or(isodow(ts) < 6) OVER (PARTITION BY symbol) AS has_weekday FROM k)
SELECT {sql.out(*BARS_OUT)} FROM m WHERE isodow(ts) < 6 OR NOT has_weekday""")
def bars_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    # Zero prices are made bad on purpose: text for the open, infinity for the low; volumes may go negative.
    dirty = tables.event_bars(spark, sf).withColumns({
        "open": F.when(F.col("open") == 0, "n/a").otherwise(F.col("open").cast("string")),
        "low": F.when(F.col("low") == 0, F.lit(float("inf"))).otherwise(F.col("low")),
        "volume": F.col("volume") - 3,
    })
    return present(src.sanitize(dirty))


@query("bars_resample", f"WITH {sql.event_bars('4h')} SELECT {sql.out(*BARS_OUT)} FROM bars")
def bars_resample(spark: SparkSession, sf: str) -> DataFrame:
    return present(src.resample(tables.event_bars(spark, sf, "1h"), "4h"))


@query("bars_last_n", f"""WITH {sql.event_bars('1h')} SELECT {sql.out(*BARS_OUT)} FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 300""")
def bars_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return present(src.last_n(tables.event_bars(spark, sf), 300))


@query("bars_min_history", f"""WITH {sql.event_bars('1h')} SELECT {sql.out(*BARS_OUT)} FROM bars
QUALIFY count(*) OVER (PARTITION BY symbol) >= 680""")
def bars_min_history(spark: SparkSession, sf: str) -> DataFrame:
    return present(src.min_history(tables.event_bars(spark, sf), 680))


@query("bars_date_range", f"""WITH {sql.daily_bars()} SELECT {sql.out(*BARS_OUT)} FROM bars
WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1998-12-31'""")
def bars_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return present(tables.daily_bars(spark, sf, "1996-01-01", "1998-12-31"))


_CODES = [(s, dims.VENDOR_CODE[p], dims.FALLBACK_CODE[p]) for s, p in dims.STAND_IN.items()]


@query("symbol_map", f"""WITH {sql.event_bars('4h')}, {sql.values(_CODES, 'codes', 'symbol, vendor_code, fallback_code')},
{sql.values(list(dims.INTERVAL_CODE.items()), 'iv', 'tf, interval_code')}
SELECT b.symbol, b.tf, {sql.tx('b.ts')} AS ts, {sql.fx('b.close')} AS close, coalesce(c.vendor_code, b.symbol) AS vendor_code,
  coalesce(c.fallback_code, b.symbol) AS fallback_code, coalesce(i.interval_code, '1h') AS interval_code
FROM bars b LEFT JOIN codes c ON c.symbol = b.symbol LEFT JOIN iv i ON i.tf = b.tf""")
def symbol_map(spark: SparkSession, sf: str) -> DataFrame:
    out = dims.symbol_map(tables.event_bars(spark, sf, "4h"), dims.STAND_IN)
    return present(out, "symbol", "tf", "ts", "close", "vendor_code", "fallback_code", "interval_code")


# --- indicators ------------------------------------------------------------------------------

def _indicator(build, before: int, after: int = 0, tf: str = "1h"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return in_frames(tables.indexed(spark, sf, tf), build, before, after)
    return run


@query("ind_true_range", f"""WITH {sql.event_bars('1h')} SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx(sql.TR)} AS tr FROM bars""")
def ind_true_range(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("tr", ind.true_range(w))
    return present(_indicator(build, 1)(spark, sf), "symbol", "ts", "tr")


@query("ind_ewm", f"""WITH {sql.event_bars('1h')}, {sql.core(spans=(21, 200))}
SELECT {sql.out('symbol', '@ts', '~ema_21', '~ema_200', digits=4)} FROM core""")
def ind_ewm(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return ind.add_ewm(df, w, {f"ema_{s}": (F.col("close"), s, 0) for s in (21, 200)})
    out = _indicator(build, ind.ewm_margin(200))(spark, sf)
    return present(out, "symbol", "ts", "ema_21", "ema_200", digits=4)


@query("ind_atr", f"""WITH {sql.event_bars('1h')}, {sql.core(spans=(9,))}
SELECT {sql.out('symbol', '@ts', '~atr', digits=4)} FROM core""")
def ind_atr(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return ind.add_core(df, w, ())
    return present(_indicator(build, ind.core_margin(()))(spark, sf), "symbol", "ts", "atr", digits=4)


@query("ind_atr_sma", f"""WITH {sql.event_bars('1h')}, {sql.atr_sma(first=True)}
SELECT {sql.out('symbol', '@ts', '~atr')} FROM atrs""")
def ind_atr_sma(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return ind.add_atr_sma(df, w, first=True)
    return present(_indicator(build, 15)(spark, sf), "symbol", "ts", "atr")


@query("ind_rsi", f"""WITH {sql.event_bars('1h')}, {sql.core(spans=(9,))}
SELECT {sql.out('symbol', '@ts', '~rsi', digits=4)} FROM core""")
def ind_rsi(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return ind.add_core(df, w, ())
    return present(_indicator(build, ind.core_margin(()))(spark, sf), "symbol", "ts", "rsi", digits=4)


@query("ind_rsi_sma", f"""WITH {sql.event_bars('1h')},
d AS (SELECT *, coalesce(close - lag(close) OVER ({sql.W}), 0) AS chg FROM bars),
g AS (SELECT *, {sql.roll('avg(greatest(chg, 0))', 14)} AS mg, {sql.roll('avg(greatest(-chg, 0))', 14)} AS ml FROM d),
r AS (SELECT *, CASE WHEN ml > 0 THEN 100 - 100/(1 + mg/ml) WHEN mg > 0 THEN 100 END AS rsi FROM g)
SELECT {sql.out('symbol', '@ts', '~rsi')} FROM r""")
def ind_rsi_sma(spark: SparkSession, sf: str) -> DataFrame:
    return present(_indicator(ind.add_rsi_sma, 15)(spark, sf), "symbol", "ts", "rsi")


@query("ind_ema_set", f"""WITH {sql.event_bars('1h')}, {sql.core(spans=(9, 21, 50, 100, 200))}
SELECT {sql.out('symbol', '@ts', *[f'~ema_{s}' for s in (9, 21, 50, 100, 200)], digits=4)} FROM core""")
def ind_ema_set(spark: SparkSession, sf: str) -> DataFrame:
    spans = (9, 21, 50, 100, 200)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return ind.add_ewm(df, w, {f"ema_{s}": (F.col("close"), s, 0) for s in spans})
    return present(_indicator(build, ind.ewm_margin(*spans))(spark, sf), "symbol", "ts", *[f"ema_{s}" for s in spans], digits=4)


@query("ind_bollinger", f"""WITH {sql.event_bars('1h')},
b AS (SELECT *, {sql.roll('avg(close)', 20)} AS bb_mid, {sql.roll('stddev_samp(close)', 20)} AS sd FROM bars)
SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx('bb_mid')} AS bb_mid, {sql.fx('bb_mid + 2*sd')} AS bb_upper,
  {sql.fx('bb_mid - 2*sd')} AS bb_lower, {sql.fx('((bb_mid + 2*sd) - (bb_mid - 2*sd))/bb_mid')} AS bb_width FROM b""")
def ind_bollinger(spark: SparkSession, sf: str) -> DataFrame:
    return present(_indicator(ind.add_bollinger, 19)(spark, sf), "symbol", "ts", "bb_mid", "bb_upper", "bb_lower", "bb_width")


@query("ind_volume_rvol", f"""WITH {sql.event_bars('1h')}, v AS (SELECT *, {sql.roll('avg(volume)', 20)} AS volume_sma FROM bars)
SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx('volume_sma')} AS volume_sma, {sql.fx('volume/nullif(volume_sma, 0)')} AS rvol,
  {sql.fx('coalesce(volume/nullif(volume_sma, 0), 1.0)')} AS rvol_filled FROM v""")
def ind_volume_rvol(spark: SparkSession, sf: str) -> DataFrame:
    out = _indicator(ind.add_volume, 19)(spark, sf)
    out = out.withColumn("rvol_filled", F.coalesce("rvol", F.lit(1.0)))
    return present(out, "symbol", "ts", "volume_sma", "rvol", "rvol_filled")


@query("ind_returns", f"""WITH {sql.event_bars('1h')}
SELECT symbol, {sql.tx('ts')} AS ts, {', '.join(
    sql.fx(f'close/nullif(lag(close, {k}) OVER ({sql.W}), 0) - 1') + f' AS {n}' for n, k in (('return_1h', 1), ('return_4h', 4), ('return_1d', 24)))} FROM bars""")
def ind_returns(spark: SparkSession, sf: str) -> DataFrame:
    return present(_indicator(ind.add_returns, 24)(spark, sf), "symbol", "ts", "return_1h", "return_4h", "return_1d")


@query("ind_volatility_hour", f"""WITH {sql.event_bars('1h')}, {sql.atr_sma()}
SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx('atr/nullif(close, 0)*100')} AS volatility, CAST(hour(ts) AS INTEGER) AS hour FROM atrs""")
def ind_volatility_hour(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return ind.add_volatility_hour(ind.add_atr_sma(df, w))
    return present(_indicator(build, 15)(spark, sf), "symbol", "ts", "volatility", "hour")


@query("ind_rolling_extrema", f"""WITH {sql.event_bars('1h')}
SELECT symbol, {sql.tx('ts')} AS ts, {sql.prev_extreme('max(high)', 10)} AS prev_high_10, {sql.prev_extreme('min(low)', 10)} AS prev_low_10 FROM bars""")
def ind_rolling_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return present(_indicator(ind.add_extrema, 10)(spark, sf), "symbol", "ts", "prev_high_10", "prev_low_10")


_AROUND = f"OVER ({sql.W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"


@query("ind_centered_extrema", f"""WITH {sql.event_bars('1h')}
SELECT symbol, {sql.tx('ts')} AS ts, CASE WHEN count(*) {_AROUND} = 20 THEN max(high) {_AROUND} END AS swing_high,
  CASE WHEN count(*) {_AROUND} = 20 THEN min(low) {_AROUND} END AS swing_low FROM bars""")
def ind_centered_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return present(_indicator(ind.add_centered_extrema, 10, 9)(spark, sf), "symbol", "ts", "swing_high", "swing_low")
