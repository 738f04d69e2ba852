"""Streams with their own state per key: indicators, trap detection, trade tracking, caps.

Bars reach a symbol's state at the pace of the clock, one per bar length, so a busy symbol has busy
ticks but no more bars than any other. Bars wait in state until the watermark has reached their start,
when all before them have ended, and are used in time order then, however they arrived. Bars later than
the delay are dropped and counted by Spark (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.operators.indicators import EMA_SPANS
from tickweave.sources.bars import WINDOW_TEXT
from tickweave.streaming.run import use_rocksdb


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts, ignore_index=True).sort_values(order, kind="stable") if parts else pd.DataFrame()


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


# --- bars in time order ---------------------------------------------------------------------

class InOrder(StatefulProcessor):
    """Bars of a series wait until the watermark reaches their start; ``use`` gets them in time order, each once.

    One timer stands for the earliest bar; when it fires, all that are due are used and it moves to the next.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "open double, high double, low double, close double")
        self.done = handle.getValueState("done", "at long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self.done.get() if self.done.exists() else (-1, -1)
        earliest = None
        for bar in _rows(rows, ["ts"]).itertuples(index=False):
            at = _micros(bar.ts)
            if at <= last or self.waiting.containsKey((at,)):  # the same bar once more: one before it would be late
                continue
            self.waiting.updateValue((at,), (bar.open, bar.high, bar.low, bar.close))
            earliest = at if earliest is None else earliest
        if earliest is not None and (timer < 0 or earliest < timer):
            self._wake(last, earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], *v) for k, v in self.waiting.iterator())
        due = [b for b in held if b[0] <= passed]
        if not due:
            return
        for bar in due:
            self.waiting.removeKey((bar[0],))
        if len(held) > len(due):
            self._wake(due[-1][0], held[len(due)][0])
        else:
            self.done.update((due[-1][0], -1))
        yield self.use(key, due)

    def _wake(self, last: int, at: int) -> None:
        self.handle.registerTimer(at // 1000)
        self.done.update((last, at))

    def use(self, key, bars: list[tuple]) -> pd.DataFrame:
        """Result of bars (microseconds, open, high, low, close) newer than all before."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _timed(bars: DataFrame, delay: str) -> DataFrame:
    """Bars grouped by series under a watermark on their ends; a last bar longer than the delay is due at once."""
    ends = F.lit(None).cast("timestamp")
    for tf, length in WINDOW_TEXT.items():
        ends = F.when(F.col("tf") == tf, F.col("ts") + F.expr(f"interval {length}")).otherwise(ends)
    timed = bars.withColumn("_end", F.coalesce(ends, F.col("ts"))).withWatermark("_end", delay)
    return timed.groupBy("symbol", "tf")


# --- indicators ------------------------------------------------------------------------------

class Indicators(InOrder):
    """EMA of close, ATR and RSI carried from bar to bar."""

    def __init__(self, spans: tuple[int, ...], n: int):
        self.spans, self.n = spans, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        fields = ["seen long", "prev double", "atr double", "gain double", "loss double"]
        self.state = handle.getValueState("carry", ", ".join(fields + [f"e{s} double" for s in self.spans]))

    def use(self, key, bars: list[tuple]) -> pd.DataFrame:
        kept = self.state.get() if self.state.exists() else None
        seen, prev, atr, gain, loss = kept[:5] if kept else (0, 0.0, 0.0, 0.0, 0.0)
        emas = list(kept[5:]) if kept else [0.0] * len(self.spans)
        mix = lambda old, new, span: old + (new - old) * 2.0 / (span + 1)
        out = []
        for at, _, high, low, close in bars:
            tr = high - low
            if seen:
                tr = max(tr, abs(high - prev), abs(low - prev))
                up, down = max(close - prev, 0.0), max(prev - close, 0.0)
                gain, loss = (up, down) if seen == 1 else (mix(gain, up, self.n), mix(loss, down, self.n))
            atr = mix(atr, tr, self.n) if seen else tr
            emas = [mix(e, close, s) if seen else close for e, s in zip(emas, self.spans)]
            rsi = 100 - 100 / (1 + gain / loss) if seen and loss else None
            seen, prev = seen + 1, close
            out.append((*key, at, close, atr, rsi, *emas))
        self.state.update((seen, prev, atr, gain, loss, *emas))
        columns = ["symbol", "tf", "ts", "close", "atr", "rsi", *[f"ema_{s}" for s in self.spans]]
        frame = pd.DataFrame(out, columns=columns).astype({"rsi": "float64"})
        frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
        return frame


def indicators(bars: DataFrame, spans: tuple[int, ...] = EMA_SPANS, n: int = 14, delay: str = "10 minutes") -> DataFrame:
    """Bar stream with atr, rsi and EMAs by the same recurrence as the batch operators."""
    use_rocksdb(bars.sparkSession)
    schema = "symbol string, tf string, ts timestamp, close double, atr double, rsi double, " + ", ".join(f"ema_{s} double" for s in spans)
    return _timed(bars, delay).transformWithStateInPandas(Indicators(spans, n), schema, "Append", "EventTime")


# --- false breakout --------------------------------------------------------------------------

class Traps(InOrder):
    """Keeps the last lookback + 3 bars and tests the one two bars back."""

    def __init__(self, lookback: int):
        self.keep = lookback + 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bars = handle.getListState("bars", "at long, open double, high double, low double, close double")

    def use(self, key, bars: list[tuple]) -> pd.DataFrame:
        held = [tuple(r) for r in self.bars.get()] if self.bars.exists() else []
        out = []
        for bar in bars:
            held = [*held, bar][-self.keep:]
            if len(held) < self.keep:
                continue
            past, broke, entry = held[:-3], held[-3], held[-2][1]
            top, bottom, close = max(b[2] for b in past), min(b[3] for b in past), held[-1][4]
            if broke[3] < bottom < close:
                out.append((*key, broke[0], bar[0], 1, entry))
            elif broke[2] > top > close:
                out.append((*key, broke[0], bar[0], -1, entry))
        self.bars.put(held)
        found = pd.DataFrame(out, columns=["symbol", "tf", "ts", "available_ts", "signal", "entry"])
        for c in ("ts", "available_ts"):
            found[c] = pd.to_datetime(found[c], unit="us")
        return found.astype({"signal": "int32", "entry": "float64"})


def false_breakouts(bars: DataFrame, lookback: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Traps of a bar stream, emitted when the bar that completes them is due."""
    use_rocksdb(bars.sparkSession)
    schema = "symbol string, tf string, ts timestamp, available_ts timestamp, signal int, entry double"
    return _timed(bars, delay).transformWithStateInPandas(Traps(lookback), schema, "Append", "EventTime")


# --- trades ----------------------------------------------------------------------------------

TRADE_FIELDS = "side double, entry double, stop double, tp1 double, tp2 double, tp3 double, level int"
EVENT_COLUMNS = "symbol string, ts timestamp, kind string, id string, direction string, entry double, stop_loss double, tp1 double, tp2 double, tp3 double, price double"


class Levels:
    """Next target and stop of open trades in order of price, so that a price finds those it crosses and touches no other."""

    def __init__(self, trades: dict[str, list]):
        self.trades, self.turn, self.above, self.below = trades, {}, [], []
        for name in trades:
            self.watch(name)

    def watch(self, name: str) -> None:
        """Enter the two prices that matter next; entries made before for the trade no longer count."""
        side, entry, stop, *targets, level = self.trades[name]
        turn = self.turn[name] = self.turn.get(name, 0) + 1
        target, line = targets[level] if level < 3 else None, entry if level else stop
        for up, price in ((side > 0, target), (side < 0, line)):
            for heap, wanted, sign in ((self.above, up, 1.0), (self.below, not up, -1.0)):
                if wanted and price is not None and not math.isnan(price):
                    heappush(heap, (sign * price, name, turn))

    def crossed(self, price: float) -> list[str]:
        """Trades whose next target or stop this price has reached, by name."""
        found = set()
        for heap, limit in ((self.above, price), (self.below, -price)):
            while heap and heap[0][0] <= limit:
                _, name, turn = heappop(heap)
                if name in self.trades and self.turn[name] == turn:
                    found.add(name)
        return sorted(found)


class Tracker(StatefulProcessor):
    """Open trades of a symbol; each price may advance a trade by one target or close it.

    Signals and prices wait until the watermark has reached their time and are used in time order then; a price of a signal's own
    time is older than the signal.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id string", TRADE_FIELDS)
        self.waiting = handle.getListState("waiting", "at long, kind string, id string, side double, entry double, stop double, tp1 double, tp2 double, tp3 double, price double")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            side = np.where(frame["direction"] == "buy", 1.0, -1.0)
            values = frame[["entry", "stop_loss", "tp1", "tp2", "tp3", "price"]].astype("float64").to_numpy()
            at = [_micros(ts) for ts in frame["ts"]]
            self.waiting.appendList([(a, k, str(i), float(d), *map(float, v)) for a, k, i, d, v in zip(at, frame["kind"], frame["id"], side, values)])
            earliest = min(at) if earliest is None else min(earliest, *at)
        if earliest is not None and (not self.timer.exists() or earliest < self.timer.get()[0]):
            self._wake(earliest)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda e: (e[0], e[1] != "price", e[2])) if self.waiting.exists() else []
        due = [e for e in held if e[0] <= passed]
        if not due:
            return
        rest = held[len(due):]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
            self.timer.clear()
        yield self._use(key[0], due)

    def _use(self, symbol: str, events: list[tuple]) -> pd.DataFrame:
        trades = {k[0]: list(v) for k, v in self.open.iterator()}
        levels, touched, out = Levels(trades), set(), []
        for at, kind, name, side, entry, stop, tp1, tp2, tp3, price in events:
            ts = pd.Timestamp(at, unit="us")
            if kind == "signal":
                trades[name] = [side, entry, stop, tp1, tp2, tp3, 0]
                levels.watch(name)
                touched.add(name)
                out.append((symbol, name, ts, "open", None, None, 0))
                continue
            for name in levels.crossed(price):
                t = trades[name]
                change = self._advance(t, price)
                touched.add(name)
                out.append((symbol, name, ts, *change, t[6]))
                if change[0] == "closed":
                    del trades[name]
                else:
                    levels.watch(name)
        for name in touched:
            if name in trades:
                self.open.updateValue((name,), tuple(trades[name]))
            elif self.open.containsKey((name,)):
                self.open.removeKey((name,))
        frame = pd.DataFrame(out, columns=["symbol", "id", "ts", "status", "result", "actual_rr", "level"])
        return frame.astype({"actual_rr": "float64", "level": "int32", "ts": "datetime64[us]"})

    @staticmethod
    def _advance(t: list, price: float):
        """What a price beyond the next target or the stop does."""
        side, entry, stop, *targets, level = t
        if level < 3 and side * (price - targets[level]) >= 0:
            t[6] = level + 1
            if t[6] == 3:
                risk = abs(entry - stop)
                return "closed", "win", abs(targets[2] - entry) / risk if risk else 0.0
            return "open", None, None
        return ("closed", "win", 0.0) if level else ("closed", "loss", -1.0)

    def close(self) -> None:
        pass


def track_trades(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Signals and prices (see EVENT_COLUMNS) to changes of trades: status, result, ratio, targets reached.

    After the first target the stop is the entry; the third target closes the trade. Events may arrive up to ``delay`` behind
    the latest one and are used in time order whatever files they come in; those that are later are dropped and counted by
    Spark, and those of the last ``delay`` wait for the stream to go on.
    """
    use_rocksdb(events.sparkSession)
    schema = "symbol string, id string, ts timestamp, status string, result string, actual_rr double, level int"
    return events.withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(Tracker(), schema, "Append", "EventTime")


def upsert_sink(path: str):
    """``foreachBatch`` function that appends changes with a version; a repeated batch rewrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        versioned = batch.withColumn("version", F.struct(F.lit(batch_id).alias("batch"), F.unix_micros("ts").alias("at"), "level"))
        versioned.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


# --- caps --------------------------------------------------------------------------

class Caps(StatefulProcessor):
    """Counts of a day and its sessions; the day's state goes when the watermark has passed the day."""

    def __init__(self, per_day: int, per_session: int):
        self.per_day, self.per_session = per_day, per_session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "session string", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        if not counts:
            midnight = pd.Timestamp(key[0]) + pd.Timedelta(days=1)
            self.handle.registerTimer(int(midnight.value // 1_000_000))
        signals = _rows(rows, ["ts", "symbol"])
        total, keep = sum(counts.values()), []
        for s in signals["session"]:
            ok = total < self.per_day and counts.get(s, 0) < self.per_session
            keep.append(ok)
            if ok:
                total, counts[s] = total + 1, counts.get(s, 0) + 1
        for s, n in counts.items():
            self.counts.updateValue((s,), (n,))
        yield signals.loc[keep, ["symbol", "ts", "session", "signal"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def _first_per_session(n: int):
    """Map-side limit: only the first ``n`` of a session in a batch can pass, so no task sends more than that."""
    def limit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            both = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = both.sort_values(["ts", "symbol"]).groupby([both["ts"].dt.date, "session"], sort=False).head(n)
        if held is not None:
            yield held
    return limit


def trade_limits(signals: DataFrame, per_day: int = 5, per_session: int = 3, delay: str = "1 hour") -> DataFrame:
    """Signals let through by daily and session caps, in order of arrival and (ts, symbol) within a batch."""
    use_rocksdb(signals.sparkSession)
    schema = "symbol string, ts timestamp, session string, signal int"
    limited = signals.select("symbol", "ts", "session", "signal").mapInPandas(_first_per_session(per_session), schema)
    keyed = limited.withWatermark("ts", delay).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return keyed.groupBy("day").transformWithStateInPandas(Caps(per_day, per_session), schema, "Append", "EventTime")


# --- delayed feed ------------------------------------------------------------------

#: Rows in one value of the state, and rows sent on at a time when they are published.
HELD_ROWS, RELEASED_ROWS = 1_000, 10_000

#: What a tick holds while it waits. Ids are text, since pandas would read whole numbers beside a null as doubles.
TICK = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us")), ("price", pa.float64()), ("event_id", pa.string())])


class Hold(StatefulProcessor):
    """Rows wait until the watermark has passed their minute by the delay, and go out a few at a time.

    They lie in the state by time, up to ``HELD_ROWS`` in a value, under the times at which the first and the last of them
    are due, so the state has few entries however many minutes it covers. One timer stands for the earliest row; when it
    fires, what is due goes out, a value due in part is written back without those rows, and the timer moves on.
    """

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "first long, last long, n long", "ticks binary")
        self.next = handle.getValueState("next", "timer long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, n = self.next.get() if self.next.exists() else (-1, 0)
        earliest = timer
        for frame in rows:
            ticks = pa.RecordBatch.from_pandas(frame[TICK.names].sort_values("ts", kind="stable"), TICK, preserve_index=False)
            for a in range(0, ticks.num_rows, HELD_ROWS):
                first = self._put(ticks.slice(a, HELD_ROWS), n)
                earliest, n = first if earliest < 0 else min(earliest, first), n + 1
        self._wake(timer, earliest, n)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, n = timerValues.getCurrentWatermarkInMs(), self.next.get()[1]
        held = sorted(self.rows.keys()) if self.rows.exists() else []
        later, out, size = [k[0] for k in held if k[0] > passed][:1], [], 0
        for first, last, k in held:
            if first > passed:
                break
            ticks = pa.ipc.read_record_batch(pa.py_buffer(self.rows.getValue((first, last, k))[0]), TICK)
            self.rows.removeKey((first, last, k))
            if last > passed:
                due = int(np.searchsorted(self._due(ticks), passed, side="right"))
                later.append(self._put(ticks.slice(due), n))
                ticks, n = ticks.slice(0, due), n + 1
            out.append(ticks)
            size += ticks.num_rows
            if size >= RELEASED_ROWS:
                yield pa.Table.from_batches(out).to_pandas()
                out, size = [], 0
        if out:
            yield pa.Table.from_batches(out).to_pandas()
        self._wake(-1, min(later, default=-1), n)

    def _due(self, ticks: pa.RecordBatch) -> np.ndarray:
        """Milliseconds at which rows may go out: their minute and the delay."""
        at = ticks.column("ts").cast(pa.int64()).to_numpy()
        return (at // 60_000_000 + self.minutes + 1) * 60_000

    def _put(self, ticks: pa.RecordBatch, n: int) -> int:
        """Keep rows that are in time order as value number ``n``; returns when the first is due."""
        due = self._due(ticks)
        first, last = int(due[0]), int(due[-1])
        self.rows.updateValue((first, last, n), (ticks.serialize().to_pybytes(),))
        return first

    def _wake(self, timer: int, at: int, n: int) -> None:
        """Move the timer, if one is set, to the earliest row."""
        if at != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.next.update((at, n))

    def close(self) -> None:
        pass


def delayed_feed(ticks: DataFrame, minutes: int, lateness: int = 10, pieces: int = 16) -> DataFrame:
    """Ticks published once the latest time seen is ``minutes`` (and the lateness) past their minute.

    They are dealt by a hash to ``pieces`` groups a partition of the state, so neither a busy symbol or minute nor many
    symbols and minutes change what a group holds, and each group has one timer. A tick without a time is never due.
    """
    spark = ticks.sparkSession
    use_rocksdb(spark)
    groups = pieces * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = ticks.select("symbol", "ts", F.col("price").cast("double").alias("price"), F.col("event_id").cast("string").alias("event_id")).filter(F.col("ts").isNotNull())
    keyed = held.withWatermark("ts", f"{lateness} minutes").withColumn("piece", F.pmod(F.xxhash64("symbol", "ts", "event_id"), F.lit(groups)))
    out = keyed.groupBy("piece").transformWithStateInPandas(Hold(minutes), "symbol string, ts timestamp, price double, event_id string", "Append", "EventTime")
    return out.withColumn("event_id", F.col("event_id").cast("long"))
