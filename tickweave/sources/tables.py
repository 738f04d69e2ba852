"""The library's inputs taken from the test tables (events, lineitem, orders, customer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.frames import index_bars
from tickweave.session import cut, prepare
from tickweave.sources.bars import bars_from_ticks, date_range
from tickweave.sources.dims import STAND_IN, pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: symbol = event type, price = value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), "event_id",
    )


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), tf, tie=["event_id"])


def daily_bars(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """lineitem as a long daily series per return flag, optionally only some days."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    rows = date_range(rows, first, last, "l_shipdate")
    return bars_from_ticks(
        rows, "1d", symbol="l_returnflag", ts="l_shipdate", price="l_extendedprice",
        tie=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    )


def indexed(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    """Numbered bars. Numbering reads the bars twice, so they are written once and the ticks read once."""
    return index_bars(cut(event_bars(spark, sf_dir, tf)))


def indexed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(cut(daily_bars(spark, sf_dir)))


def stand_in_pairs(spark: SparkSession) -> DataFrame:
    return pairs(spark, STAND_IN)


def news(spark: SparkSession, sf_dir: str, above: float = 150.0) -> DataFrame:
    """error events above a value stand for high-impact news, the others for low-impact news."""
    currencies = F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP", "JPY", "XAU")])
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("value") > above, "high").otherwise("low").alias("impact"),
        F.element_at(currencies, (F.col("event_id") % 5 + 1).cast("int")).alias("currency"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
    )


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and customers as a log of trades."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    win = F.col("o_orderstatus") == "F"
    closed = F.col("o_orderstatus") != "O"
    session = F.element_at(
        F.array(*[F.lit(s) for s in ("asia", "london", "new_york", "overlap")]), (key % 4 + 1).cast("int")
    )
    regime = F.element_at(
        F.array(F.lit("TRENDING"), F.lit("RANGING"), F.lit("QUIET"), F.lit(None).cast("string")),
        (key % 7 % 4 + 1).cast("int"),
    )
    buy = key % 2 == 0
    side = F.when(buy, 1.0).otherwise(-1.0)
    step = price * 0.01
    opened = F.col("o_orderdate").cast("timestamp")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        key.cast("string").alias("id"),
        F.col("c_mktsegment").alias("symbol"),
        F.when(buy, "buy").otherwise("sell").alias("direction"),
        price.alias("entry"),
        (price - side * step).alias("stop_loss"),
        (price + side * step * 1.5).alias("tp1"),
        (price + side * step * 2.5).alias("tp2"),
        (price + side * step * 3.5).alias("tp3"),
        F.lit(1.5).alias("rr_tp1"),
        (F.lit(50.0) + key % 50).cast("double").alias("confidence"),
        (key % 21).cast("int").alias("score"),
        session.alias("session"),
        F.concat(F.lit("order "), key.cast("string")).alias("reason"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        F.when(closed, F.when(win, "win").otherwise("loss")).alias("result"),
        F.when(closed, F.when(win, (key % 3 + 1).cast("double")).otherwise(-1.0)).alias("actual_rr"),
        opened.alias("opened_at"),
        F.when(closed, opened + F.expr("interval 1 day")).alias("closed_at"),
        F.when(win, 1).otherwise(0).alias("tp1_hit"),
        F.lit(0).alias("tp2_hit"),
        F.lit(0).alias("tp3_hit"),
        F.when(win, 1).otherwise(0).alias("be_moved"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("strategy_used"),
        regime.alias("regime_at_entry"),
    )
