"""Bars: reading them, building them from ticks, cleaning and resampling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators.frames import KEYS, tail_rows

OHLC = ("open", "high", "low", "close")

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in (*OHLC, "volume")]
)
CSV_SCHEMA = T.StructType(
    [T.StructField("ts", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in (*OHLC, "volume")]
)
WINDOW_TEXT = {
    "1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes",
    "1h": "1 hour", "4h": "4 hours", "1d": "1 day",
}


def check_bars(df: DataFrame) -> DataFrame:
    """Fail at plan time when a bar column is missing or has the wrong type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in BAR_SCHEMA.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"bars need columns of the right type: {', '.join(wrong)}")
    return df


# Where symbol and timeframe stand in a path.
FILE_NAMES = r"([^/]+)_([^_/]+)\.csv"
FOLDER_NAMES = r"symbol=([^/]+)/tf=([^/]+)/"


def read_bars_csv(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA, names: str = FILE_NAMES) -> DataFrame:
    """Read CSV files whose first column is the UTC time; symbol and timeframe come from the path.

    Files are ``<symbol>_<tf>.csv`` by default, or lie in ``symbol=.../tf=.../`` folders.
    """
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    file = F.input_file_name()
    return raw.select(
        F.regexp_extract(file, names, 1).alias("symbol"), F.regexp_extract(file, names, 2).alias("tf"), *raw.columns
    )


def read_bars_parquet(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, tf: str | None = None) -> DataFrame:
    """Read bars written with ``partitionBy("tf", "symbol")``; the filters prune partitions."""
    bars = spark.read.parquet(path)
    if tf is not None:
        bars = bars.filter(F.col("tf") == tf)
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(*symbols))
    return bars.select(*BAR_SCHEMA.names)


def bars_from_ticks(
    ticks: DataFrame,
    tf: str,
    symbol: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    tie: Sequence[str] = (),
) -> DataFrame:
    """OHLC bars per symbol; ``tie`` orders ticks with equal times so that open and close are fixed.

    The aggregation is combined before the shuffle, so a hot symbol costs no more than its bars.
    """
    moment = F.col(ts).cast("timestamp")
    order = F.struct(moment, *[F.col(c) for c in tie]) if tie else F.unix_micros(moment)
    return (
        ticks.select(
            F.col(symbol).alias("symbol"),
            F.window(moment, WINDOW_TEXT[tf]).getField("start").alias("ts"),
            F.col(price).cast("double").alias("price"),
            order.alias("_order"),
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("price", "_order").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_order").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), "ts", *OHLC, "volume")
    )


def resample(bars: DataFrame, tf: str, where: Column | None = None) -> DataFrame:
    """Longer bars from shorter ones; empty buckets and buckets with a null price are dropped."""
    src = bars if where is None else bars.filter(where)
    micros = F.unix_micros("ts")
    return (
        src.withColumn("_start", F.window("ts", WINDOW_TEXT[tf]).getField("start"))
        .groupBy("symbol", "_start")
        .agg(
            F.min_by("open", F.when(F.col("open").isNotNull(), micros)).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.when(F.col("close").isNotNull(), micros)).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .dropna(subset=[*OHLC])
        .select("symbol", F.lit(tf).alias("tf"), F.col("_start").alias("ts"), *OHLC, "volume")
    )


def normalize(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Lower-case price names, volume 0 when absent, UTC time, bars with a null dropped."""
    named = raw.select(*[F.col(c).alias(c.lower()) for c in raw.columns])
    missing = [c for c in OHLC if c not in named.columns]
    if missing:
        raise ValueError(f"price columns missing: {', '.join(missing)}")
    if "volume" not in named.columns:
        named = named.withColumn("volume", F.lit(0.0))
    time = F.col("ts").cast("timestamp")
    if zone != "UTC":
        time = F.to_utc_timestamp(time, zone)
    keys = [c for c in KEYS if c in named.columns]
    return named.select(
        *keys, time.alias("ts"), *[F.col(c).cast("double").alias(c) for c in (*OHLC, "volume")]
    ).dropna()


def finite(c: Column) -> Column:
    """Number or null: text that is no number, NaN and infinities become null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def sanitize(bars: DataFrame, keep: int | None = 100) -> DataFrame:
    """Finite prices only, volume not below 0, last ``keep`` bars, then weekend bars dropped.

    A series whose kept bars all fall on a weekend is left as it is.
    """
    clean = bars.select(
        *KEYS, "ts",
        *[finite(F.col(c)).alias(c) for c in OHLC],
        F.greatest(F.coalesce(finite(F.col("volume")), F.lit(0.0)), F.lit(0.0)).alias("volume"),
    ).dropna(subset=[*OHLC])
    if keep is not None:
        clean = tail_rows(clean, keep, F.col("ts").desc())
    weekday = F.weekday("ts") < 5
    has_weekday = clean.filter(weekday).select(*KEYS).distinct().withColumn("_some", F.lit(True))
    return (
        clean.join(has_weekday, [*KEYS], "left")
        .filter(weekday | F.col("_some").isNull())
        .drop("_some")
    )


def last_n(bars: DataFrame, n: int) -> DataFrame:
    return tail_rows(bars, n, F.col("ts").desc())


def min_history(bars: DataFrame, n: int) -> DataFrame:
    """Only series with at least ``n`` bars; counted before the join, so hot series are not collected."""
    long_enough = bars.groupBy(*KEYS).count().filter(F.col("count") >= n).select(*KEYS)
    return bars.join(long_enough, [*KEYS], "left_semi")


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Closed range on a time column, compared in the column's own type so that it reaches the file scan.

    Cut ticks before building bars from them: a filter on bars only runs after the aggregation.
    """
    kind = df.schema[ts].dataType
    out = df
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        out = out.filter(F.col(ts) <= F.lit(end).cast(kind))
    return out
