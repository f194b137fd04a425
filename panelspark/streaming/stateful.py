"""Keyed state of our own: breakouts on history plus the live bar, and strengths smoothed over the last shown ones."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelspark.operators.technical import DAYS


class HighDeque:
    """Highs of the last `span` bars that no later bar reaches, oldest first: the highest of any last n is one search away."""

    def __init__(self, span: int, n: int = 0, numbers: list[int] | None = None, highs: list[float] | None = None) -> None:
        self.span, self.n, self.numbers, self.highs = span, n, numbers or [], highs or []

    def push(self, high: float | None) -> None:
        """The next bar; one without a high takes its place in the numbering only."""
        if high is not None:
            while self.highs and self.highs[-1] <= high:
                self.highs.pop()
                self.numbers.pop()
            self.highs.append(high)
            self.numbers.append(self.n)
        self.n += 1
        while self.numbers and self.numbers[0] < self.n - self.span:
            del self.numbers[0], self.highs[0]

    def highest(self, n: int) -> float | None:
        """Of the last n bars, or of as many as there are."""
        at = bisect_left(self.numbers, self.n - n)
        return self.highs[at] if at < len(self.highs) else None

    def flags(self, close: float, days: tuple[int, ...]) -> list[int]:
        return [int((top := self.highest(n)) is not None and close > top) for n in days]


LIVE_STATE = "n long, numbers array<long>, highs array<double>, timer long, days array<int>, ends array<long>, bars array<array<double>>, marks array<array<long>>"


class LiveBreakouts(StatefulProcessor):
    """State of an instrument: the deque of its closed bars and the bars that are still open, in one value.

    A quote changes the open bar of its day. When the watermark passes the end of a day, its bar is judged against the
    closed ones (final) and joins them. Each batch also judges the bars that are still open as they stand (live).
    """

    def __init__(self, days: tuple[int, ...] = DAYS, live: bool = True) -> None:
        self.days, self.live = days, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("panel", LIVE_STATE)

    def _load(self) -> tuple[HighDeque, int, dict[int, tuple[int, list, list]]]:
        got = self.state.get() if self.state.exists() else None
        if got is None:
            return HighDeque(max(self.days)), 0, {}
        n, numbers, highs, timer, days, ends, bars, marks = got
        return HighDeque(max(self.days), n, list(numbers), list(highs)), timer, {d: (e, list(b), list(m)) for d, e, b, m in zip(days, ends, bars, marks, strict=True)}

    def _save(self, closed: HighDeque, timer: int, open_bars: dict) -> None:
        wanted = min((e for e, _, _ in open_bars.values()), default=0)
        if wanted != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        days = sorted(open_bars)
        self.state.update((closed.n, closed.numbers, closed.highs, wanted, days, [open_bars[d][0] for d in days], [open_bars[d][1] for d in days], [open_bars[d][2] for d in days]))

    def _row(self, key, day: int, bar: list, flags: list[int], final: bool) -> list:
        return [key[0], day, *bar, *flags, final]

    def _frame(self, rows: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["stock_id", "date", "open_price", "high_price", "low_price", "close_price", *(f"break_{n}" for n in self.days), "final"])
        out["date"] = pd.to_datetime(out["date"], unit="D").dt.date
        return out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        closed, timer, open_bars = self._load()
        for high in initialState.sort_values("date")["high_price"].tolist():
            closed.push(None if high != high else high)
        self._save(closed, timer, open_bars)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, timer, open_bars = self._load()
        for pdf in rows:
            for day, end, at, number, value in zip(pdf["day"].tolist(), pdf["end_ms"].tolist(), pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["value"].tolist(), strict=True):
                mark = [at, number]
                if day not in open_bars:
                    open_bars[day] = (end, [value] * 4, mark + mark)
                    continue
                _, bar, marks = open_bars[day]
                bar[1], bar[2] = max(bar[1], value), min(bar[2], value)
                if mark < marks[:2]:
                    bar[0], marks[:2] = value, mark
                if mark > marks[2:]:
                    bar[3], marks[2:] = value, mark
        self._save(closed, timer, open_bars)
        if self.live:
            yield from self._judge_open(key, closed, open_bars)

    def _judge_open(self, key, closed: HighDeque, open_bars: dict) -> Iterator[pd.DataFrame]:
        ahead, found = HighDeque(closed.span, closed.n, list(closed.numbers), list(closed.highs)), []
        for day in sorted(open_bars):
            bar = open_bars[day][1]
            flags = ahead.flags(bar[3], self.days)
            if any(flags):
                found.append(self._row(key, day, bar, flags, False))
            ahead.push(bar[1])
        if found:
            yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, timer, open_bars = self._load()
        now, found = timerValues.getCurrentWatermarkInMs(), []
        for day in sorted(open_bars):
            end, bar, _ = open_bars[day]
            if end > now:
                break
            flags = closed.flags(bar[3], self.days)
            if any(flags):
                found.append(self._row(key, day, bar, flags, True))
            closed.push(bar[1])
            del open_bars[day]
        self._save(closed, 0 if timer <= now else timer, open_bars)
        if found:
            yield self._frame(found)

    def close(self) -> None:
        pass


def live_breakouts(quotes: DataFrame, history: DataFrame, days: tuple[int, ...] = DAYS, live: bool = True, late: str = "10 minutes") -> DataFrame:
    """Breakouts of each instrument's day bars, from a stream of quotes on top of stored bars.

    quotes: stock_id, ts, event_id, value (a stream; rows without a value are left out); history: stock_id, date,
    high_price of earlier days, which becomes the initial state. Rows with `final` false show bars as they stand after a
    micro-batch; with true, closed ones. Order of quotes is (ts, event_id), whatever the order of arrival.
    """
    day = F.to_date("ts")
    rows = quotes.where(F.col("value").isNotNull()).withWatermark("ts", late)
    rows = rows.select("stock_id", "ts", F.unix_date(day).alias("day"), F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("end_ms"), F.unix_micros("ts").alias("at"), "event_id", "value")
    schema = "stock_id string, date date, open_price double, high_price double, low_price double, close_price double, " + ", ".join(f"break_{n} int" for n in days) + ", final boolean"
    return rows.groupBy("stock_id").transformWithStateInPandas(LiveBreakouts(days, live), schema, "Append", "EventTime", history.select("stock_id", "date", "high_price").groupBy("stock_id"))


TICK_COLUMNS = ("date", "minute", "a_price", "b_price", "base_source", "a_change", "b_change", "raw")


class LastStrengths(StatefulProcessor):
    """State of a pair: its newest day and that day's last n - 1 raw strengths, so it does not grow with time."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day int, raw array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["date", "minute"])
        day, last = self.last.get() if self.last.exists() else (None, [])
        means = []
        for date, raw in zip(pdf["date"].tolist(), pdf["raw"].tolist(), strict=True):
            number = date.toordinal()
            last = [*(last if number == day else []), raw][-self.n :]
            day = number
            means.append(sum(last) / len(last))
        self.last.update((day, [float(x) for x in last[len(last) - self.n + 1 :]] if len(last) >= self.n else last))
        yield pdf.assign(pair=key[0], strength=means)[["pair", *TICK_COLUMNS, "strength"]]

    def close(self) -> None:
        pass


def smoothed_strength(ticks: DataFrame, n: int = 3) -> DataFrame:
    """ticks (pair, date, minute, prices, changes, raw) with the mean of the pair's last n raw strengths of the day.

    Windows of a pair must close in order, as those behind a watermark do; within a batch any order will do.
    """
    schema = "pair string, date date, minute int, a_price double, b_price double, base_source string, a_change double, b_change double, raw double, strength double"
    return ticks.select("pair", *TICK_COLUMNS).groupBy("pair").transformWithStateInPandas(LastStrengths(n), schema, "Append", "None")
