"""Robustness of a set of trades: folds, cost stress, resampling, verdicts.

Resampling draws a number for each trade and replicate by integer arithmetic on a hash of the trade, the
same on any engine, at any size and on every retry. Samples, orders and removals follow from these numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions.numbers import ratio
from tickweave.operators import stats
from tickweave.operators.frames import dense_index


# --- grids and folds -------------------------------------------------------------------------

def walk_forward(
    trades: DataFrame, by: Sequence[str], order: Sequence[str], slice_expr: Column, folds: int = 5,
    pnl: str = "net_pnl_r", min_trades: int = 20, min_side: int = 5,
) -> DataFrame:
    """Profit factor and win rate of fold f (train) against fold f + 1 (test), in time order.

    Folds are equal counts of trades; trades after the last full fold are not used.
    """
    numbered = dense_index(trades, by, order, slice_expr, out="_no")
    sizes = trades.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / (folds + 1)).alias("_size"), F.count(F.lit(1)).alias("_n"))
    part = numbered.join(sizes.filter(F.col("_n") >= min_trades), list(by)).withColumn("_fold", F.floor(F.col("_no") / F.col("_size")))
    part = part.filter(F.col("_fold") <= folds)
    per = stats.plain_stats(part, [*by, "_fold"], pnl)
    sides = per.select(*by, "_fold", "total_trades", "pf", "wr", "avg_r")

    def renamed(prefix: str, fold: Column) -> DataFrame:
        return sides.select(*by, fold.alias("fold"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("total_trades", "pf", "wr", "avg_r")])

    both = renamed("train", F.col("_fold") + 1).join(renamed("test", F.col("_fold")), [*by, "fold"])
    both = both.filter((F.col("train_total_trades") >= min_side) & (F.col("test_total_trades") >= min_side))
    return both.select(
        *by, "fold", F.col("train_total_trades").alias("train_trades"), F.col("test_total_trades").alias("test_trades"),
        "train_pf", "train_wr", "test_pf", "test_wr", "test_avg_r", ratio(F.col("test_pf"), F.col("train_pf")).alias("degradation"),
    )


def date_folds(trades: DataFrame, folds: Sequence[tuple[str, str, str]], by: Sequence[str], pnl: str = "net_pnl_r") -> DataFrame:
    """Statistics per (name, first day, last day); a trade may belong to several folds."""
    inside = [
        F.when((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp") + F.expr("interval 1 day")), F.lit(name))
        for name, a, b in folds
    ]
    spread = trades.withColumn("fold", F.explode(F.array_compact(F.array(*inside))))
    return stats.plain_stats(spread, [*by, "fold"], pnl)


def spread_stress(
    trades: DataFrame, by: Sequence[str], mults: Sequence[float] = (1.0, 2.0, 3.0, 5.0), pnl: str = "net_pnl_r",
) -> DataFrame:
    """Statistics with the spread multiplied; needs risk, spread_pips and pip_size. 1x is the net result."""
    grown = trades.withColumn("mult", F.explode(F.array(*[F.lit(float(m)) for m in mults])))
    extra = F.col("spread_pips") * F.col("pip_size") * (F.col("mult") - 1)
    grown = grown.withColumn("_p", F.col(pnl) - F.coalesce(F.try_divide(extra, F.col("risk")), F.lit(0.0)))
    return stats.plain_stats(grown, [*by, "mult"], "_p")


# --- resampling ------------------------------------------------------------------------------

#: Random numbers are residues of this prime (fixed value), so that products fit 64 bits and any engine gets the same ones.
PRIME = 2147483647
#: Trades of a block and of a piece of a random order; random numbers a task holds; ranges of replicates at least.
RESAMPLED_ROWS, NUMBERS, SPREAD = 1 << 18, 1 << 22, 32
#: Numbers below these give 0, 1, ... 7 occurrences of a trade in a sample (Poisson with mean 1), the rest 8.
OCCURRENCES = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8))


def trade_key(seed: int, by: Sequence[str], order: Sequence[str], no: str) -> Column:
    """A number in [1, PRIME) for each trade from the md5 of its seed, group, order columns and number among equals as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*by, *order, no]])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (PRIME - 1) + 1


def draw_numbers(key: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Numbers in [0, PRIME) for replicates (rows) and trades (columns): products and squares of both, so that no two
    replicates order the trades alike and no two trades move together."""
    b = (rep + 1) * 48271 % PRIME
    b = ((b * b + rep + 1) % PRIME)[:, None]
    x = key * b % PRIME
    y = (x * x + key) % PRIME
    return (y * y + b) % PRIME


def _packed(trades: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, seed: int, least: int, rows: int) -> DataFrame:
    """Valued trades of the sets of at least ``least``, as arrays in blocks of about ``rows``: (by, _n, _x, _key, _tie).

    ``_tie`` orders trades whose numbers are equal: the order columns, then the value.
    """
    vals = trades.withColumn("_x", value).filter(F.col("_x").isNotNull())
    sizes = vals.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    types = {f.name: f.dataType for f in trades.schema.fields}
    place = [F.unix_micros(c) if isinstance(types[c], T.TimestampType) else F.col(c).cast("long") for c in order]
    vals = vals.withColumn("_no", F.row_number().over(Window.partitionBy(*dict.fromkeys([*by, *order])).orderBy("_x")))
    vals = vals.join(sizes, list(by)).withColumn("_key", trade_key(seed, by, order, "_no"))
    vals = vals.withColumn("_blk", F.pmod(F.xxhash64("_key", *order, "_no"), F.ceil(F.col("_n") / rows)))
    item = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(place)], F.col("_no").cast("long").alias("_no"), "_key", "_x")
    packed = vals.groupBy(*by, "_n", "_blk").agg(F.sort_array(F.collect_list(item)).alias("_t"))  # about ``rows`` trades
    tie = F.array(*[F.col(f"_t.{c}") for c in (*[f"_o{k}" for k in range(len(place))], "_no")])
    return packed.select(*by, "_n", "_blk", F.col("_t._x").alias("_x"), F.col("_t._key").alias("_key"), tie.alias("_tie"))


def _ranges(packed: DataFrame, sims: int, rows: int) -> DataFrame:
    """Blocks given to each range of replicates (_from, _to), so long that a range's numbers are a few million."""
    span = F.least(F.lit(-(-sims // SPREAD)), F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.least(F.col("_n"), F.lit(rows))))).cast("long")
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"), F.col("_span")))
    return packed.withColumn("_span", span).withColumn("_from", firsts).withColumn("_to", F.least(F.col("_from") + F.col("_span"), F.lit(sims))).drop("_span")


def _ordered(part: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Values of one replicate's piece in the order of their numbers."""
    z, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
    at = np.argsort(z, kind="stable")
    if len(z) > 1 and (np.diff(z[at]) == 0).any():
        at = np.lexsort((*np.concatenate([p[2] for p in part], axis=1)[::-1], z))
    return x[at]


def _in_order(packed: DataFrame, by: Sequence[str], sims: int, rows: int, reduce: Callable[[np.ndarray, int, int], tuple], out: str) -> DataFrame:
    """``reduce(values in order, trades before, trades in all)`` for each replicate and piece of its order: (by, _rep, _s, out).

    A piece is a range of the random number that holds about ``rows`` trades. A task takes a range of replicates and a piece,
    reads the set's blocks as they stream, draws their numbers itself and keeps those of its piece; so trades are sent, not
    numbers, and a task's memory depends on neither the set's size nor the replicates.
    """
    by, part = list(by), [*by, "_from", "_piece"]
    pieces = F.ceil(F.col("_n") / rows)
    dealt = _ranges(packed, sims, rows).withColumn("_pieces", pieces).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    dealt = dealt.repartition(*part).sortWithinPartitions(*part, "_blk")
    fields = [f for f in packed.schema.fields if f.name in by]
    schema = T.StructType([*fields, *T.StructType.fromDDL(f"_rep long, _s long, {out}").fields])

    def finish(head: pd.Series, held: list[list], before: np.ndarray) -> pd.DataFrame:
        rows_out = [(r, head["_piece"], *reduce(_ordered(kept), int(n), int(head["_n"]))) for r, kept, n in zip(range(head["_from"], head["_to"]), held, before) if kept]
        return pd.DataFrame(rows_out, columns=schema.names[len(by):]).assign(**{c: head[c] for c in by})[schema.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, head, held, before = None, None, [], np.empty(0)
        for pdf in batches:
            for _, row in pdf.iterrows():
                this = tuple(row[c] for c in part)
                if this != last:
                    if last is not None:
                        yield finish(head, held, before)
                    last, head, held = this, row.drop(["_x", "_key", "_tie"]), [[] for _ in range(row["_from"], row["_to"])]
                    before = np.zeros(len(held), np.int64)
                x, tie = np.asarray(row["_x"], np.float64), np.stack(list(row["_tie"]))
                numbers = draw_numbers(np.asarray(row["_key"], np.int64), np.arange(row["_from"], row["_to"]))
                piece = np.floor(numbers / float(PRIME) * row["_pieces"])
                before += (piece < row["_piece"]).sum(axis=1)
                for kept, z, mine in zip(held, numbers, piece == row["_piece"]):
                    if mine.any():
                        kept.append((z[mine], x[mine], tie[:, mine]))
        if last is not None:
            yield finish(head, held, before)

    return dealt.mapInPandas(run, schema)


def bootstrap(
    trades: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str = "net_pnl_r", sims: int = 10000, seed: int = 42, min_trades: int = 10,
    rows: int = RESAMPLED_ROWS,
) -> DataFrame:
    """Profit factor, mean and win rate over samples drawn with replacement; no losses counts as 10, empty samples are left out.

    Each trade occurs in each sample a Poisson(1) number of times, drawn from its own numbers, so the sums of a range of
    samples over a block of trades are one product of matrices and only sums are shuffled. A sample's size varies about the set's.
    """
    by = list(by)
    blocks = _ranges(_packed(trades, by, order, F.col(pnl), seed, min_trades, rows), sims, rows).drop("_tie")
    fields = [f for f in blocks.schema.fields if f.name in by]
    schema = T.StructType([*fields, *T.StructType.fromDDL("_rep long, _win double, _loss double, _sum double, _wins double, _size double").fields])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                x, rep = np.asarray(row["_x"], np.float64), np.arange(row["_from"], row["_to"])
                weight = np.searchsorted(OCCURRENCES, draw_numbers(np.asarray(row["_key"], np.int64), rep), side="right").astype(np.float64)
                of = weight @ np.stack([np.maximum(x, 0), np.maximum(-x, 0), x, x > 0, np.ones(len(x))], axis=1)
                out = pd.DataFrame(of, columns=schema.names[-5:]).assign(_rep=rep, **{c: row[c] for c in by})
                yield out[schema.names]

    parts = blocks.repartition(*by, "_blk", "_from").mapInPandas(sums, schema)
    reps = parts.groupBy(*by, "_rep").agg(*[F.sum(c).alias(c) for c in schema.names[-5:]]).filter(F.col("_size") > 0)
    reps = reps.withColumns({
        "pf": F.when(F.col("_loss") > 0, F.try_divide(F.col("_win"), F.col("_loss"))).otherwise(10.0),
        "avg_r": F.try_divide(F.col("_sum"), F.col("_size")), "wr": F.try_divide(F.col("_wins"), F.col("_size")),
    })
    p = lambda c, q: F.percentile(c, F.lit(q))
    return reps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_simulations"),
        F.avg("pf").alias("pf_mean"), p("pf", 0.5).alias("pf_median"), p("pf", 0.01).alias("pf_p1"), p("pf", 0.05).alias("pf_p5"),
        p("pf", 0.95).alias("pf_p95"), p("pf", 0.99).alias("pf_p99"),
        (F.avg((F.col("pf") < 1).cast("double")) * 100).alias("pf_below_1_pct"),
        F.avg("avg_r").alias("avg_r_mean"), p("avg_r", 0.05).alias("avg_r_p5"), p("avg_r", 0.95).alias("avg_r_p95"),
        F.avg("wr").alias("wr_mean"), p("wr", 0.05).alias("wr_p5"),
    )


def trade_removal(
    trades: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str = "net_pnl_r", shares: Sequence[float] = (0.1, 0.2, 0.3),
    sims: int = 1000, seed: int = 42, rows: int = RESAMPLED_ROWS,
) -> DataFrame:
    """Profit factor after removing a share of the winners at random (at least one), per share: those with the smallest
    numbers of the replicate. A piece knows how many trades come before it, so each adds its own part of the sum."""
    by = list(by)
    v = F.col(pnl)

    def gone(x: np.ndarray, before: int, n: int) -> tuple:
        most = [max(1, math.floor(n * share)) for share in shares]
        return ([float(x[: max(0, k - before)].sum()) for k in most],)

    packed = _packed(trades, by, order, F.when(v > 0, v), seed, 1, rows)
    parts = _in_order(packed, by, sims, rows, gone, "_gone array<double>")
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("share"))).cast("long")
    per_rep = parts.select(*by, "_rep", F.posexplode("_gone").alias("_k", "_gone")).withColumn("share", F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_k")))
    winners = trades.filter(v > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    per_rep = per_rep.groupBy(*by, "share", "_rep").agg(F.sum("_gone").alias("_gone")).join(winners, by).withColumn("n_removed", k)
    totals = trades.groupBy(*by).agg(F.sum(F.when(v > 0, v).otherwise(0.0)).alias("_w"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("_l"))
    pf = F.when(F.col("_l") > 0, F.try_divide(F.col("_w") - F.col("_gone"), F.col("_l"))).otherwise(0.0)
    return per_rep.join(totals, by).withColumn("pf", pf).groupBy(*by, "share").agg(
        F.avg("pf").alias("mean_pf"), F.percentile("pf", F.lit(0.5)).alias("median_pf"), F.percentile("pf", F.lit(0.05)).alias("p5_pf"),
        (F.avg((F.col("pf") < 1).cast("double")) * 100).alias("pf_below_1_pct"), F.first("n_removed").alias("n_removed"),
    )


def permutation_drawdown(
    trades: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str = "net_pnl_r", sims: int = 10000,
    start: float = 1000.0, risk_pct: float = 1.0, seed: int = 42, rows: int = RESAMPLED_ROWS, min_trades: int = 10,
) -> DataFrame:
    """Drawdown, ruin and final balance of a compounding account over random orders of the trades.

    A replicate orders the trades by their numbers. Ranges of the number are consecutive pieces of that order, each summed
    on its own and then combined, whatever the set's size.
    """
    by = list(by)

    def fall(x: np.ndarray, before: int, n: int) -> tuple:
        with np.errstate(divide="ignore", invalid="ignore"):
            cum = np.cumsum(np.log(np.maximum(1 + x * (risk_pct / 100.0), 0.0)))
            drop = np.maximum.accumulate(cum) - cum
        return float(cum[-1]), float(cum.max()), float(cum.min()), float(np.fmax.reduce(drop, initial=0.0))

    packed = _packed(trades, by, order, F.col(pnl), seed, min_trades, rows)
    parts = _in_order(packed, by, sims, rows, fall, "_sum double, _hi double, _lo double, _dd double")
    parts = stats._join_drawdown(parts, [*by, "_rep"], start=0.0)
    reps = parts.groupBy(*by, "_rep").agg(F.sum("_sum").alias("_g"), F.max("_drop").alias("_d")).select(
        *by, "_rep", F.exp("_g").alias("final"), ((1 - F.exp(-F.col("_d"))) * 100).alias("dd"), (F.col("_g") == float("-inf")).cast("double").alias("ruin"),
    )
    p = lambda c, q: F.percentile(c, F.lit(q))
    money = F.col("final") * start
    return reps.withColumn("_money", money).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_simulations"), F.avg("ruin").alias("prob_ruin"),
        F.avg("_money").alias("mean_final"), p("_money", 0.5).alias("median_final"),
        p("_money", 0.05).alias("p5_final"), p("_money", 0.95).alias("p95_final"),
        F.avg("dd").alias("mean_max_dd_pct"), p("dd", 0.95).alias("p95_max_dd_pct"), p("dd", 0.99).alias("p99_max_dd_pct"),
        (F.avg((F.col("_money") > start).cast("double")) * 100).alias("still_profitable_pct"),
    )


# --- suite and verdict -----------------------------------------------------------------------

def _long(df: DataFrame, by: Sequence[str], test: str, metrics: Sequence[str], label: Column | None = None) -> DataFrame:
    name = F.lit(test) if label is None else F.concat(F.lit(f"{test}:"), label.cast("string"))
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*by, name.alias("test"), F.inline(items))


def suite(
    trades: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts",), slice_expr: Column | None = None,
    sims: int = 10000, removal_sims: int = 1000, splits: Sequence[str] = ("regime", "direction"), seed: int = 42,
) -> DataFrame:
    """Every test of every group as one long table (group columns, test, metric, value).

    ``trades`` is read by each test: pass a written or persisted table.
    """
    by = list(by)
    sl = stats.by_day() if slice_expr is None else slice_expr
    main = ("total_trades", "pf", "wr", "avg_r", "mdd_r", "sharpe")
    short = ("total_trades", "pf", "wr", "avg_r")
    parts = [
        _long(stats.trade_stats(trades, by, order=order), by, "baseline", main),
        _long(stats.plain_stats(trades, [*by, "year"]), by, "year", short, F.col("year")),
        _long(walk_forward(trades, by, order, sl), by, "walk_forward", ("train_pf", "test_pf", "degradation"), F.col("fold")),
        _long(spread_stress(trades, by), by, "spread", short, F.col("mult").cast("int")),
        _long(permutation_drawdown(trades, by, order, sims=sims, seed=seed), by, "permutation", ("prob_ruin", "mean_max_dd_pct", "p95_max_dd_pct", "p99_max_dd_pct", "median_final")),
        _long(bootstrap(trades, by, order, sims=sims, seed=seed), by, "bootstrap", ("pf_mean", "pf_p5", "pf_p95", "pf_below_1_pct", "avg_r_mean")),
        _long(trade_removal(trades, by, order, sims=removal_sims, seed=seed), by, "removal", ("mean_pf", "p5_pf", "pf_below_1_pct", "n_removed"), (F.col("share") * 100).cast("int")),
    ]
    for split in splits:
        parts.append(_long(stats.plain_stats(trades, [*by, split]), by, split, short, F.col(split)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verdict(results: DataFrame, by: Sequence[str], min_pf: float = 1.2) -> DataFrame:
    """Six yes/no tests from a suite table: five or more PASS, three or more MARGINAL, else FAIL."""
    def pick(test: str, metric: str) -> Column:
        return F.max(F.when((F.col("test") == test) & (F.col("metric") == metric), F.col("value")))

    fold = F.when(F.col("test").startswith("walk_forward:") & (F.col("metric") == "test_pf"), F.col("value"))
    figures = results.groupBy(*by).agg(
        pick("baseline", "pf").alias("_pf"), F.min(fold).alias("_wf_min"), F.avg(fold).alias("_wf_avg"),
        pick("spread:3", "pf").alias("_s3"), pick("permutation", "prob_ruin").alias("_ruin"), pick("permutation", "p95_max_dd_pct").alias("_dd"),
        pick("bootstrap", "pf_p5").alias("_p5"), pick("removal:10", "pf_below_1_pct").alias("_rem"),
    )
    no = F.lit(False)
    checks = {
        (f"PF>{min_pf}", f"PF<={min_pf}"): F.col("_pf") > min_pf,
        ("WF+", "WF-"): (F.col("_wf_min") > 1.0) & (F.col("_wf_avg") > 1.0),
        ("Spread+", "Spread-"): F.col("_s3") > 1.0,
        ("MC+", "MC-"): (F.col("_ruin") < 0.05) & (F.col("_dd") < 30),
        ("Bootstrap+", "Bootstrap-"): F.col("_p5") > 0.9,
        ("Removal+", "Removal-"): F.col("_rem") < 50,
    }
    passed = [F.coalesce(c, no) for c in checks.values()]
    score = sum((c.cast("int") for c in passed), F.lit(0))
    details = F.concat_ws(", ", *[F.when(c, yes).otherwise(other) for (yes, other), c in zip(checks, passed)])
    out = figures.select(*by, score.alias("score"), details.alias("details"))
    grade = F.when(F.col("score") >= 5, "PASS").when(F.col("score") >= 3, "MARGINAL").otherwise("FAIL")
    return out.withColumn("verdict", F.concat(grade, F.lit(" ("), F.col("score").cast("string"), F.lit("/6): "), F.col("details")))


# --- two strategies --------------------------------------------------------------------------

def overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Trades of two strategies on the same symbol and day in opposite directions, counted per symbol and day.

    Both sides are counted per (symbol, day, direction) before the join; pairs are the product of counts,
    so no pair is formed.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("symbol", F.to_date("ts").alias("day")).agg(
            F.count(F.when(F.col("direction") == "buy", 1)).alias(f"{name}_buy"),
            F.count(F.when(F.col("direction") == "sell", 1)).alias(f"{name}_sell"),
        )

    both = counted(first, "a").join(counted(second, "b"), ["symbol", "day"])
    return both.withColumn("conflicts", F.col("a_buy") * F.col("b_sell") + F.col("a_sell") * F.col("b_buy"))


def overlap_summary(days: DataFrame) -> DataFrame:
    """Conflicting pairs, days both strategies traded, and pairs per hundred such days."""
    return days.agg(
        F.sum("conflicts").alias("conflict_count"), F.count(F.lit(1)).alias("common_days"),
        (F.try_divide(F.sum("conflicts") * 100.0, F.count(F.lit(1)))).alias("conflict_pct"),
    )


def regime_portfolio(fb: DataFrame, smc: DataFrame, r: str = "net_pnl_r") -> DataFrame:
    """False breakouts in calm regimes together with breakouts in moving ones; ``source`` tells them apart."""
    cols = ["symbol", "tf", "ts", "ix", "direction", "regime", r]
    calm = fb.filter(F.col("regime").isin("RANGING", "LOW_VOL", "MIXED")).select(*cols, F.lit("false_breakout").alias("source"))
    moving = smc.filter(F.col("regime").isin("TRENDING", "HIGH_VOL")).select(*cols, F.lit("smc_proxy").alias("source"))
    return calm.unionByName(moving)
