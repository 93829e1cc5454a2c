"""A seeded source of business-day bars, as a Python data source: spark.read.format("synthetic_bars")."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.symbols = [s for s in options.get("symbols", "000001").split(",") if s]
        self.start, self.end = (dt.date.fromisoformat(options.get(k, d)) for k, d in (("start", "2024-01-01"), ("end", "2024-12-31")))

    def partitions(self):
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition):
        """A log-normal walk: the shock of a day is the inverse of a hash of symbol and day, so any range agrees."""
        from statistics import NormalDist

        normal, price, day = NormalDist(), 0.0, dt.date(2000, 1, 3)

        def unit(*parts) -> float:
            return (int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 16**13

        price = 5 + 95 * unit(partition.symbol)
        while day <= self.end:
            if day.weekday() < 5:
                opened = price
                price *= math.exp(0.0002 + 0.018 * normal.inv_cdf(unit(partition.symbol, day)))
                if day >= self.start:
                    wide = 1 + 0.01 * unit(partition.symbol, day, "w")
                    volume = 1e5 * (1 + 9 * unit(partition.symbol, day, "v"))
                    yield (partition.symbol, day, opened, max(opened, price) * wide, min(opened, price) / wide, price, volume, volume * price, "mock")
            day += dt.timedelta(days=1)


class SyntheticBars(DataSource):
    """Options: symbols (comma-separated), start, end (ISO dates). Rows are marked as mock and so are never audited."""

    @classmethod
    def name(cls):
        return "synthetic_bars"

    def schema(self):
        return "symbol string, session date, open double, high double, low double, close double, volume double, amount double, source string"

    def reader(self, schema):
        return _Reader(self.options)
