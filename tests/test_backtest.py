"""The replay of runs against a plain loop over positions, and its cost with many symbols."""

import datetime as dt
import math
import random
import time

import pandas as pd

from tidemark.operators import backtest

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(20)]
PRICES = ["session", "symbol", "open_px", "close_px", "buy_ok", "sell_ok"]


def plain(targets: pd.DataFrame, prices: pd.DataFrame, capital: float) -> list[tuple]:
    cash, held, marks, rows = capital, {}, {}, []
    want = {d: sorted(g["symbol"]) for d, g in targets.groupby("session")}
    for day, px in prices.sort_values(["session", "symbol"]).groupby("session"):
        p = {r.symbol: r for r in px.itertuples() if isinstance(r.symbol, str)}
        opening = cash + sum(q * (p[s].open_px if s in p and p[s].open_px > 0 else marks.get(s, 0.0)) for s, q in held.items())
        traded = None
        if day in want:
            traded, goal = 0.0, opening / max(1, len(want[day]))
            for s in sorted(held):
                keep = goal / p[s].open_px if s in want[day] and s in p and p[s].open_px > 0 else 0.0
                q = held[s] - keep
                if q > 1e-9 and s in p and p[s].sell_ok:
                    amount = q * p[s].open_px
                    fee = backtest.cost(amount, True)
                    if amount > fee:
                        cash, traded = cash + amount - fee, traded + amount
                        held[s] = keep
                        if keep <= 1e-9:
                            del held[s]
            buys = {s: max(0.0, goal - held.get(s, 0.0) * p[s].open_px) for s in want[day] if s in p and p[s].buy_ok}
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                spent = sum(a * mid + backtest.cost(a * mid, False) for a in buys.values())
                lo, hi = (mid, hi) if spent <= cash else (lo, mid)
            for s, a in buys.items():
                amount = a * lo
                if amount > 0:
                    cash, traded = cash - amount - backtest.cost(amount, False), traded + amount
                    held[s] = held.get(s, 0.0) + amount / p[s].open_px
        marks.update({s: r.close_px for s, r in p.items() if r.close_px > 0})
        stale = sum(s not in p for s in held)
        nav = cash + sum(q * marks.get(s, 0.0) for s, q in held.items())
        rows.append((nav, cash, len(held), stale, None if traded is None else traded / opening))
    return rows


def market(symbols: int, seed: int, gaps: float = 0.0) -> list[tuple]:
    rng = random.Random(seed)
    return [(d, f"{i:06d}", 10 + 5 * rng.random(), None if rng.random() < gaps else 10 + 5 * rng.random(), rng.random() < 0.8, rng.random() < 0.7) for d in DAYS for i in range(symbols) if rng.random() < 0.9]


def test_replay_agrees_with_the_plain_loop(spark):
    rng, px = random.Random(2), market(40, 3)
    targets = [(r, d, f"{i:06d}") for r, n in (("x", 1), ("y", 3), ("z", 7)) for d in [*DAYS[1::n], dt.date(2030, 1, 1)] for i in rng.sample(range(44), 9)]
    t = spark.createDataFrame(targets, "run string, session date, symbol string")
    p = spark.createDataFrame(px, "session date, symbol string, open_px double, close_px double, buy_ok boolean, sell_ok boolean")
    got = sorted(backtest.backtest(t, p, 1e5).collect(), key=lambda r: (r["run"], r["session"]))
    assert [(r["run"], r["session"]) for r in got] == [(r, d) for r in "xyz" for d in DAYS]
    for i, run in enumerate("xyz"):
        own = pd.DataFrame([x for x in targets if x[0] == run], columns=["run", "session", "symbol"])
        for g, w in zip(got[20 * i :], plain(own, pd.DataFrame(px, columns=PRICES), 1e5)):
            assert (g["holdings"], g["stale"]) == w[2:4] and math.isclose(g["nav"], w[0], rel_tol=1e-12) and math.isclose(g["cash"], w[1], rel_tol=1e-9, abs_tol=1e-6)
            assert (g["turnover"] is None) == (w[4] is None) and math.isclose(g["turnover"] or 0, w[4] or 0, rel_tol=1e-9)


def test_replay_of_prices_with_missing_closes():
    px = pd.DataFrame(market(30, 4, 0.4), columns=PRICES)
    targets = px[px["symbol"] < "000020"].sample(150, random_state=1)[["session", "symbol"]].assign(run="r")
    for g, w in zip(backtest.replay("r", targets, px, 1e5).itertuples(), plain(targets, px, 1e5), strict=True):
        assert math.isclose(g.nav, w[0], rel_tol=1e-12) and (g.holdings, g.stale) == w[2:4]


def test_replay_of_many_symbols_is_quick():
    """The plain loop needs some twenty times as long."""
    px = pd.DataFrame(market(10_000, 5), columns=PRICES)
    targets = px[["session", "symbol"]].assign(run="r")
    since = time.process_time()
    assert len(backtest.replay("r", targets, px, 1e9)) == len(DAYS) and time.process_time() - since < 3
