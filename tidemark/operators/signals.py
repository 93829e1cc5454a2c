"""Quote normalisation, capital anomalies, provider audits and evidence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import AUDITED, finite


def intraday_limit(board: Column, is_st: Column) -> Column:
    """Daily limit in percent: 5 for ST, 20 for the growth boards, 30 for BSE, else 10."""
    return F.when(is_st, 5.0).when(board.isin("CHINEXT", "STAR"), 20.0).when(board == "BSE", 30.0).otherwise(10.0)


def normalise_quotes(raw: DataFrame) -> DataFrame:
    """(symbol, source, last, prev, high, amount, change) from raw rows (symbol, source, priority, last, last_alt, prev, prev_alt, high,
    amount, suspended): the first finite alternate; rows that are suspended or not positive are left out; of several rows of a
    symbol that with the highest priority stays."""
    last, prev = F.coalesce(finite(F.col("last")), finite(F.col("last_alt"))), F.coalesce(finite(F.col("prev")), finite(F.col("prev_alt")))
    d = raw.where(~F.coalesce("suspended", F.lit(False))).withColumns({"last": last, "prev": prev}).where("last > 0 and prev > 0")
    d = d.withColumn("high", F.coalesce(F.nullif(finite(F.col("high")), F.lit(0.0)), "last"))
    d = d.withColumns({"amount": F.greatest(F.coalesce(finite(F.col("amount")), F.lit(0.0)), F.lit(0.0)), "change": (F.col("last") / F.col("prev") - 1) * 100})
    row = F.struct("symbol", "source", "last", "prev", "high", "amount", "change")
    return d.groupBy("symbol").agg(F.max_by(row, F.struct("priority", "source")).alias("r")).select("r.*")


def provider_audited(provider: Column) -> Column:
    """Whether a provider is audited itself, or reads 'cache-audited:a+b' or 'cache-resampled:a+b' with audited parts only (empty ones
    are skipped; one is needed)."""
    name = F.lower(F.trim(provider))
    parts = F.filter(F.split(F.regexp_extract(name, "^cache-(?:audited|resampled):(.+)$", 1), "[+]"), lambda p: p != "")
    return F.coalesce(name.isin(*AUDITED) | ((F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(*AUDITED))), F.lit(False))


def evidence_class(n: Column, ic: Column, t: Column) -> Column:
    """The class of a factor by its mean IC and t: the gate is |t| of 2."""
    return F.when(ic.isNull() | t.isNull() | (n < 2), "insufficient").when(F.abs(t) < 2, "ineffective").when(ic < 0, "negative").otherwise("positive")
