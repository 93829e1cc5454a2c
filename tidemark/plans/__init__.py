"""Registered queries: operators applied to the adapters, each with the SQL that must give the same rows."""

from . import backtest, breadth, checks, factors, feeds, health, ingest, metrics, news, outcomes, release, reports, research, screening, screens, sectors, signals, streams, sync, universe, views  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
