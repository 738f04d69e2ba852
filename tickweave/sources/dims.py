"""Reference data as small tables.

They are local relations of known size, so Spark broadcasts them while they stay under its broadcast
threshold and joins them by sorting beyond it; no hint overrides that check.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spread in pips and pip size per symbol.
SPREAD_PIPS = {
    "EURUSD": 1.2, "GBPUSD": 1.5, "USDJPY": 1.3, "XAUUSD": 3.5,
    "AUDUSD": 1.4, "NZDUSD": 1.8, "USDCAD": 1.3, "GBPJPY": 2.5,
}
PIP_SIZE = {
    "EURUSD": 0.0001, "GBPUSD": 0.0001, "USDJPY": 0.01, "XAUUSD": 0.01,
    "AUDUSD": 0.0001, "NZDUSD": 0.0001, "USDCAD": 0.0001, "GBPJPY": 0.01,
}
# Spread and slippage in price units per symbol.
SPREAD_PX = {
    "XAUUSD": 0.50, "EURUSD": 0.00015, "GBPUSD": 0.00020, "USDJPY": 0.020,
    "GBPJPY": 0.030, "AUDUSD": 0.00015, "NZDUSD": 0.00018, "USDCAD": 0.00018,
}
SLIPPAGE_PX = {
    "XAUUSD": 0.25, "EURUSD": 0.00005, "GBPUSD": 0.00005, "USDJPY": 0.005,
    "GBPJPY": 0.005, "AUDUSD": 0.00005, "NZDUSD": 0.00005, "USDCAD": 0.00005,
}
DEFAULT_SPREAD_PIPS = 1.0
DEFAULT_PIP_SIZE = 0.0001
DEFAULT_SPREAD_PX = 0.00010
DEFAULT_SLIPPAGE_PX = 0.00005

# Favoured and avoided weekdays per symbol.
BEST_DAYS = {
    "XAUUSD": ["Thursday", "Friday"],
    "EURUSD": ["Tuesday", "Monday"],
    "GBPUSD": ["Friday", "Tuesday"],
    "USDJPY": ["Monday", "Wednesday"],
    "GBPJPY": ["Thursday", "Wednesday"],
    "AUDUSD": ["Tuesday", "Thursday"],
    "NZDUSD": ["Wednesday", "Friday"],
    "USDCAD": ["Tuesday", "Thursday"],
}
AVOID_DAYS = {
    "XAUUSD": ["Monday"],
    "EURUSD": ["Friday"],
    "GBPUSD": ["Thursday"],
    "USDJPY": ["Friday"],
    "GBPJPY": ["Wednesday"],
    "AUDUSD": ["Monday"],
    "NZDUSD": ["Monday"],
    "USDCAD": ["Friday"],
}
DAY_FALLBACK = "XAUUSD"

# Currencies whose news affects a symbol.
NEWS_CURRENCIES = {
    "XAUUSD": ["USD", "XAU"],
    "EURUSD": ["EUR", "USD"],
    "GBPUSD": ["GBP", "USD"],
    "USDJPY": ["USD", "JPY"],
    "GBPJPY": ["GBP", "JPY"],
}
DEFAULT_CURRENCIES = ["USD"]

# Vendor codes per symbol and interval codes.
VENDOR_CODE = {
    "XAUUSD": "XAU/USD", "EURUSD": "EUR/USD", "GBPUSD": "GBP/USD",
    "USDJPY": "USD/JPY", "GBPJPY": "GBP/JPY", "AUDUSD": "AUD/USD",
    "NZDUSD": "NZD/USD", "USDCAD": "USD/CAD", "USDCHF": "USD/CHF",
}
FALLBACK_CODE = {
    "XAUUSD": "GC=F", "EURUSD": "EURUSD=X", "GBPUSD": "GBPUSD=X",
    "USDJPY": "USDJPY=X", "GBPJPY": "GBPJPY=X", "AUDUSD": "AUDUSD=X",
    "NZDUSD": "NZDUSD=X", "USDCAD": "USDCAD=X", "USDCHF": "USDCHF=X",
}
INTERVAL_CODE = {
    "1m": "1min", "5m": "5min", "15m": "15min", "30m": "30min",
    "1h": "1h", "4h": "4h", "1d": "1day",
}

# Which listed instrument each symbol of the test tables stands for.
STAND_IN = {
    "click": "EURUSD", "error": "XAUUSD", "purchase": "GBPUSD", "signup": "USDJPY", "view": "GBPJPY",
    "A": "AUDUSD", "N": "GBPUSD", "R": "USDCAD",
}

_TEXT, _NUMBER, _TEXTS = pa.string(), pa.float64(), pa.list_(pa.string())
PAIR_SCHEMA = pa.schema([
    ("symbol", _TEXT), ("spread_pips", _NUMBER), ("pip_size", _NUMBER), ("spread_px", _NUMBER), ("slippage_px", _NUMBER),
    ("best_days", _TEXTS), ("avoid_days", _TEXTS), ("currencies", _TEXTS),
])


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table held in the plan itself, so that its size is known to the optimizer."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema))


def pairs(spark: SparkSession, alias: dict[str, str] | None = None) -> DataFrame:
    """One row per symbol; ``alias`` renames listed instruments to the symbols of the data at hand."""
    names = {s: s for s in SPREAD_PIPS} if alias is None else alias
    rows = []
    for shown, listed in names.items():
        rows.append((
            shown, SPREAD_PIPS[listed], PIP_SIZE[listed], SPREAD_PX[listed], SLIPPAGE_PX[listed],
            BEST_DAYS[listed], AVOID_DAYS[listed],
            NEWS_CURRENCIES.get(listed, DEFAULT_CURRENCIES),
        ))
    return local_table(spark, rows, PAIR_SCHEMA)


def with_dimension(df: DataFrame, dim: DataFrame, on: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Left lookup in a dimension; columns without a match take their default."""
    out = df.join(dim, on, "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def symbol_map(df: DataFrame, alias: dict[str, str] | None = None) -> DataFrame:
    """Vendor and fallback code of each row's symbol and the vendor's interval code.

    An unknown symbol maps to itself and an unknown interval to ``1h``.
    """
    spark = df.sparkSession
    names = {s: s for s in VENDOR_CODE} if alias is None else alias
    codes = local_table(
        spark, [(shown, VENDOR_CODE[listed], FALLBACK_CODE[listed]) for shown, listed in names.items()],
        pa.schema([("symbol", _TEXT), ("vendor_code", _TEXT), ("fallback_code", _TEXT)]),
    )
    intervals = local_table(spark, list(INTERVAL_CODE.items()), pa.schema([("tf", _TEXT), ("interval_code", _TEXT)]))
    out = with_dimension(df, codes, "symbol", {"vendor_code": F.col("symbol"), "fallback_code": F.col("symbol")})
    return with_dimension(out, intervals, "tf", {"interval_code": F.lit("1h")})
