"""Walk-forward backtest: signals and tradability are set-based; only cash and positions of a run are sequential.

Each run is replayed day by day over narrow rows that Spark prepares and sorts: the target list of each decision day and the
open, close, factor and tradability of those symbols alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the cost model
COMMISSION, LEAST, STAMP, TRANSFER, SLIPPAGE = 0.00025, 5.0, 0.001, 0.00002, 0.0005


def cost(amount: float, sell: bool) -> float:
    return 0.0 if amount <= 0 else max(amount * COMMISSION, LEAST) + amount * (TRANSFER + SLIPPAGE) + (amount * STAMP if sell else 0.0)


def decisions(scored: DataFrame, every: dict[str, int], share: float) -> DataFrame:
    """(run, decided, session, symbol): target lists of every n-th session for each run in every, to be executed on the next
    one. Scores are ranked once for all runs."""
    w = Window.orderBy("session")  # the list of sessions
    cal = scored.select("session").distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead("session").over(w))
    runs = F.array_compact(F.array(*(F.when(F.col("i") % n == 0, F.lit(run)) for run, n in every.items())))
    on = cal.where(F.col("next").isNotNull()).select("session", "next", runs.alias("runs")).where(F.size("runs") > 0)
    day = Window.partitionBy("session")
    d = scored.where("score is not null")
    ranked = d.withColumn("rank", F.row_number().over(day.orderBy(F.desc("score"), "symbol"))).withColumn("n", F.count("*").over(day))
    best = ranked.where(F.col("rank") <= F.ceil(F.col("n") * share)).join(on, "session")
    return best.select(F.explode("runs").alias("run"), F.col("session").alias("decided"), F.col("next").alias("session"), "symbol")


def held_prices(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """The rows of prices, by run, that a run can look at: those of a symbol from a decision that selects it to the first
    later decision session at which it is not selected and can be sold. The last known price stands for it from then on."""
    chosen = targets.select("run", "session", "symbol").distinct().withColumn("chosen", F.lit(True))
    ever = chosen.select("run", "symbol").distinct()
    decided = chosen.select("run", "session").distinct().withColumn("decided", F.lit(True))
    own = prices.join(ever, "symbol").join(chosen, ["run", "session", "symbol"], "left").join(decided, ["run", "session"], "left")
    event = F.when(F.col("chosen"), 1).when(F.col("decided") & F.col("sell_ok"), 0)
    w = Window.partitionBy("run", "symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    kept = own.withColumn("event", event).withColumn("before", F.last("event", ignorenulls=True).over(w))
    kept = kept.where(F.coalesce("chosen", F.lit(False)) | (F.col("before") == 1))
    return kept.select("run", "session", "symbol", "open_px", "close_px", "buy_ok", "sell_ok")


def costs(amount: np.ndarray, sell: bool) -> np.ndarray:
    """cost() of each amount."""
    fee = np.maximum(amount * COMMISSION, LEAST) + amount * (TRANSFER + SLIPPAGE) + (amount * STAMP if sell else 0.0)
    return np.where(amount <= 0, 0.0, fee)


def running(start: float, *terms: np.ndarray) -> float:
    """start with the terms of each position added in order: rounded after each, as cash is after each trade. Whether a position
    counts as short of its goal can hang on the last bit."""
    return float(np.add.accumulate(np.concatenate([[start], np.stack(terms, 1).ravel()]))[-1])


class Book:
    """Cash, positions and last known closes of one run, a session at a time. Symbols have numbers in arrays, so a session costs
    a few array operations, and memory is that of the symbols held so far and one session's rows."""

    def __init__(self, capital: float):
        self.cash, self.number = capital, {}
        self.q, self.mark, self.held = np.zeros(0), np.zeros(0), np.zeros(0, bool)

    def numbers(self, symbols) -> np.ndarray:
        n = np.fromiter((self.number.setdefault(s, len(self.number)) for s in symbols), np.int64, len(symbols))
        more = len(self.number) - len(self.q)
        if more > 0:  # grown by half at least, so that growth is linear in all
            more = max(more, len(self.q) // 2)
            self.q, self.mark, self.held = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.q, self.mark, self.held))
        return n

    def session(self, px: pd.DataFrame, wanted) -> tuple:
        """(nav, cash, holdings, stale, turnover) after a session: sells before buys, at the open; buys share the cash equally
        and are scaled to what it pays for with costs; a position bought on a session is not sold on it; marks are closes, the
        last known one if there is none. px is in the order of its symbols, wanted the session's target list, if it has one."""
        at, want = self.numbers(px["symbol"].tolist()), self.numbers(wanted)
        size = len(self.q)
        here, buy_ok, sell_ok, chosen = (np.zeros(size, bool) for _ in range(4))
        open_px = np.full(size, np.nan)
        here[at], chosen[want], open_px[at] = True, True, px["open_px"].to_numpy(float)
        buy_ok[at], sell_ok[at] = (px[c].eq(True).to_numpy(bool) for c in ("buy_ok", "sell_ok"))
        priced = open_px > 0
        opening = self.cash + sum((self.q * np.where(priced, open_px, self.mark))[self.held].tolist())
        traded = None
        if len(want):
            goal = opening / len(want)
            keep = np.divide(goal, open_px, out=np.zeros(size), where=chosen & priced)
            amount = (self.q - keep) * open_px
            fee = costs(amount, True)
            sold = self.held & sell_ok & (self.q - keep > 1e-9) & (amount > fee)
            order = at[sold[at]]  # by symbol, as px is
            traded, self.cash = running(0.0, amount[order]), running(self.cash, amount[order], -fee[order])
            self.q = np.where(sold, np.where(keep > 1e-9, keep, 0.0), self.q)
            self.held &= ~sold | (keep > 1e-9)
            amount = np.where(self.held, goal - self.q * open_px, np.where(np.isnan(open_px), 0.0, goal))
            bought = at[(chosen & buy_ok & (amount > 0))[at]]
            amount = amount[bought]
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                spent = sum((amount * mid + costs(amount * mid, False)).tolist())
                lo, hi = (mid, hi) if spent <= self.cash else (lo, mid)
            amount, bought = amount[amount * lo > 0] * lo, bought[amount * lo > 0]
            traded, self.cash = running(traded, amount), running(self.cash, -amount, -costs(amount, False))
            with np.errstate(divide="raise"):
                self.q[bought] += amount / open_px[bought]
            self.held[bought] = True
        close = px["close_px"].to_numpy(float)
        self.mark[at[close > 0]] = close[close > 0]
        nav = self.cash + sum((self.q * self.mark)[self.held].tolist())
        return nav, self.cash, int(self.held.sum()), int((self.held & ~here).sum()), None if traded is None else traded / opening


def replay(run: str, targets: pd.DataFrame, prices: pd.DataFrame, capital: float) -> pd.DataFrame:
    """One run over the sessions of prices (a row without a symbol only names its session)."""
    book, want = Book(capital), {d: sorted(g["symbol"]) for d, g in targets.groupby("session")}
    days = prices.sort_values(["session", "symbol"]).groupby("session")
    rows = [(run, day, *book.session(px[px["symbol"].notna()], want.get(day, []))) for day, px in days]
    return pd.DataFrame(rows, columns=["run", "session", "nav", "cash", "holdings", "stale", "turnover"])


def replayed(batches: Iterator[pd.DataFrame], capital: float) -> Iterator[pd.DataFrame]:
    """The sessions of all runs in batches of rows that are sorted by run and session: kind 0 are prices, 1 targets, 2 names a
    session that has prices at all. Only the rows of a session are held at a time."""
    run, day, book, parts, rows = None, None, None, [], []

    def close() -> None:
        px = pd.concat(parts)
        kind = px["kind"]
        if (kind == 2).any():
            rows.append((run, day, *book.session(px[kind == 0], px.loc[kind == 1, "symbol"].tolist())))

    for b in batches:
        r, d = b["of"].to_numpy(), b["session"].to_numpy()
        cuts = np.flatnonzero((r[1:] != r[:-1]) | (d[1:] != d[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(b)]):
            if i == j:
                continue
            if parts and (r[i], d[i]) != (run, day):
                close()
                parts = []
            if book is None or r[i] != run:
                book = Book(capital)
            run, day = r[i], d[i]
            parts.append(b.iloc[i:j])
        yield pd.DataFrame(rows, columns=["run", "session", "nav", "cash", "holdings", "stale", "turnover"])
        rows = []
    if parts:
        close()
        yield pd.DataFrame(rows, columns=["run", "session", "nav", "cash", "holdings", "stale", "turnover"])


def backtest(targets: DataFrame, prices: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """(run, session, nav, cash, holdings, stale, turnover). targets: run, session, symbol; prices: session, symbol, open_px,
    close_px, buy_ok, sell_ok. Only the rows of symbols while a run can hold them are replayed, with one row a session. A run's
    rows are sorted by session and read through once, in batches."""
    own = held_prices(targets, prices).withColumn("kind", F.lit(0))
    days = prices.select("session").distinct().join(F.broadcast(targets.select("run").distinct()))  # sessions x runs
    every = own.unionByName(targets.select("run", "session", "symbol", F.lit(1).alias("kind")), True).unionByName(days.select("run", "session", F.lit(2).alias("kind")), True)
    narrow = every.withColumnRenamed("run", "of").withColumn("session", F.unix_date("session"))
    ordered = narrow.repartition("of").sortWithinPartitions("of", "session", "symbol", "kind")

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return replayed(batches, capital)

    out = ordered.mapInPandas(all_, "run string, session int, nav double, cash double, holdings int, stale int, turnover double")
    return out.withColumn("session", F.date_from_unix_date("session"))
