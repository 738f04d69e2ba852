"""Gates on signals: day filter, news blackout, trade limits, prefilter, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.sources import dims


def with_day_filter(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weekday of each row against its symbol's favoured and avoided days; unknown symbols use the default's."""
    def fallback(days: dict[str, list[str]]) -> Column:
        return F.array(*[F.lit(d) for d in days[dims.DAY_FALLBACK]])

    out = dims.with_dimension(
        df, pairs.select("symbol", "best_days", "avoid_days"), "symbol",
        {"best_days": fallback(dims.BEST_DAYS), "avoid_days": fallback(dims.AVOID_DAYS)},
    )
    return out.withColumns({
        "day_name": cal.day_name(F.col("ts")),
        "day_filter": cal.day_filter(F.col("ts"), F.col("best_days"), F.col("avoid_days")),
    }).drop("best_days", "avoid_days")


def news_blackout(bars: DataFrame, news: DataFrame, pairs: DataFrame, before_min: int = 30, after_min: int = 15) -> DataFrame:
    """Mark bars close to high-impact news on one of the symbol's currencies, with the first such item.

    News block a time up to ``before_min`` minutes ahead of them and ``after_min`` minutes after them,
    the very moment excluded. Each item is spread over the time buckets it can block, so the join is an
    equality on (currency, bucket); an item touches a fixed number of buckets.
    """
    width = 60 * max(before_min, after_min)
    currencies = F.coalesce("currencies", F.array(*[F.lit(c) for c in dims.DEFAULT_CURRENCIES]))
    known = pairs.select("symbol", "currencies")
    times = (
        dims.with_dimension(bars.select("symbol", "ts").distinct(), known, "symbol")
        .select("symbol", "ts", F.explode(F.array_distinct(currencies)).alias("currency"))
        .withColumn("_bucket", F.floor(F.unix_timestamp("ts") / width))
    )
    at = F.unix_timestamp("nts")
    items = (
        news.filter(F.col("impact") == "high")
        .groupBy("currency", F.col("ts").alias("nts")).agg(F.min("title").alias("title"))  # the first of a time is the one named
        .withColumn("_bucket", F.explode(F.sequence(
            F.floor((at - 60 * before_min) / width), F.floor((at + 60 * after_min) / width)
        )))
    )
    ahead = (F.unix_timestamp("nts") - F.unix_timestamp("ts")) / 60.0
    near = ((ahead > 0) & (ahead <= before_min)) | ((ahead < 0) & (ahead >= -after_min))
    # Combined before the shuffle: a bar keeps one item however many block it.
    first = times.join(items, ["currency", "_bucket"]).filter(near).groupBy("symbol", "ts").agg(
        F.min(F.struct("nts", "title")).alias("_item")
    )
    out = bars.join(first, ["symbol", "ts"], "left")
    ahead = (F.unix_timestamp(F.col("_item.nts")) - F.unix_timestamp("ts")) / 60.0
    return out.withColumns({
        "blocked": F.col("_item").isNotNull(),
        "reason": F.when(F.col("_item").isNull(), "")
        .when(ahead > 0, F.concat(F.lit("High-impact news in "), ahead.cast("int").cast("string"), F.lit("m: "), F.col("_item.title")))
        .otherwise(F.concat(F.lit("Post-news blackout ("), (-ahead).cast("int").cast("string"), F.lit("m ago): "), F.col("_item.title"))),
    }).drop("_item")


def trade_limits(signals: DataFrame, per_day: int = 5, per_session: int = 3) -> DataFrame:
    """Signals that a trader with daily and session caps takes, in order of (ts, symbol).

    Only the first ``per_session`` of a session can be taken: if one of them is refused the day is full
    and stays full. Of those, the first ``per_day`` of the day are taken. Both are rank filters, which
    Spark limits inside each partition before the shuffle, so a busy day is never gathered whole.
    """
    out = signals.withColumn("_day", F.to_date("ts"))
    for keys, n in ((["_day", "session"], per_session), (["_day"], per_day)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "symbol"))
        out = out.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
    return out.drop("_day")


def trend_prefilter(direction: Column, trend: Column, choch_direction: Column) -> Column:
    """A buy against a bearish trend needs a bullish change of character; mirrored for sells."""
    against = ((direction == "buy") & (trend == "bearish")) | ((direction == "sell") & (trend == "bullish"))
    wanted = F.when(direction == "buy", "bullish").otherwise("bearish")
    return ~against | F.coalesce(choch_direction == wanted, F.lit(False))


def signal_id(symbol: Column, direction: Column, entry_text: Column, ts: Column) -> Column:
    """12 hex digits of symbol, direction, entry with two decimals and hour."""
    raw = F.concat_ws(":", symbol, direction, entry_text, F.date_format(ts, "yyyyMMddHH"))
    return F.substring(F.md5(raw), 1, 12)


def entry_text(entry: Column) -> Column:
    """The entry rounded to two decimals, without trailing zeros beyond the first."""
    cents = F.floor(entry * 100 + 0.5)
    whole, part = F.floor(cents / 100), cents % 100
    text = F.when(part % 10 == 0, F.floor(part / 10).cast("string")).otherwise(F.lpad(part.cast("string"), 2, "0"))
    return F.concat_ws(".", whole.cast("string"), text)


def dedupe(signals: DataFrame) -> DataFrame:
    """One signal per id: the earliest, ties by symbol. Each id is combined before the shuffle."""
    out = signals.withColumn("sig_id", signal_id(F.col("symbol"), F.col("direction"), entry_text(F.col("entry")), F.col("ts")))
    rank = F.row_number().over(Window.partitionBy("sig_id").orderBy("ts", "symbol"))
    return out.withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")
