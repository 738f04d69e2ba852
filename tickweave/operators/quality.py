"""Comparison of two sources of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.sources.bars import resample


def cross_validate(symbols: DataFrame, daily: DataFrame, intraday: DataFrame, warn: float = 0.1, fail: float = 0.5) -> DataFrame:
    """Closes of a daily source against an intraday source brought to days, per symbol of a list.

    Mean difference in percent under ``warn`` is PASS, under ``fail`` WARNING, else FAIL; without common
    days NO_OVERLAP, with an absent source INCOMPLETE_DATA.
    """
    def shape(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("symbol").agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.to_date(F.min("ts")).alias(f"{name}_from"), F.to_date(F.max("ts")).alias(f"{name}_to"),
        )

    a = daily.select("symbol", F.to_date("ts").alias("day"), F.col("close").alias("_a"))
    b = resample(intraday, "1d").select("symbol", F.to_date("ts").alias("day"), F.col("close").alias("_b"))
    diff = F.abs(F.col("_a") - F.col("_b"))
    common = a.join(b, ["symbol", "day"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("common_days"), F.avg(F.try_divide(diff, F.col("_b")) * 100).alias("avg_diff_pct"),
        F.max(F.try_divide(diff, F.col("_b")) * 100).alias("max_diff_pct"),
    )
    out = symbols.select("symbol").join(shape(daily, "a"), "symbol", "left").join(shape(intraday, "b"), "symbol", "left").join(common, "symbol", "left")
    avg = F.col("avg_diff_pct")
    status = (
        F.when(F.col("a_rows").isNull() | F.col("b_rows").isNull(), "INCOMPLETE_DATA").when(F.col("common_days").isNull(), "NO_OVERLAP")
        .when(avg < warn, "PASS").when(avg < fail, "WARNING").otherwise("FAIL")
    )
    return out.withColumn("status", status)


def status_report(results: DataFrame) -> DataFrame:
    """Symbols per status; both kinds of missing data count as INCOMPLETE."""
    label = F.when(F.col("status").isin("PASS", "WARNING", "FAIL"), F.col("status")).otherwise("INCOMPLETE")
    return results.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("symbols"))
