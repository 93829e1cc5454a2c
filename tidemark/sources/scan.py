"""Audited scans and priority chains of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import AUDITED, finite


def strict(df: DataFrame, source: str = "source") -> DataFrame:
    """The rows, or an error at run time if any row's source is not audited: rows are checked as they stream by."""
    ok = F.coalesce(F.col(source).isin(*AUDITED), F.lit(False))
    checked = F.when(ok, F.col(source)).otherwise(F.raise_error(F.concat(F.lit("source is not audited: "), F.coalesce(source, F.lit("null")))))
    return df.withColumn(source, checked)


def failover(providers: list[DataFrame], keys: list[str]) -> DataFrame:
    """For each key the row of the first provider that has it, with `provider` (0, 1, ...)."""
    rows = None
    for i, p in enumerate(providers):
        p = p.withColumn("provider", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("provider")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def normalise_bars(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Provider columns renamed and coerced: dates parsed, numbers finite or null, rows without a date or close dropped."""
    d = raw.withColumnsRenamed(names)
    d = d.withColumns({c: finite(F.col(c)) for c in ("open", "high", "low", "close", "volume", "amount") if c in d.columns})
    return d.withColumn("session", F.col("session").try_cast("date")).where(F.col("session").isNotNull() & F.col("close").isNotNull())


def json_series(lines: DataFrame, column: str = "value") -> DataFrame:
    """(day, value): newest point last, from JSON lines that hold an array of [day, value] pairs; bad lines are skipped."""
    pairs = F.from_json(column, "array<array<string>>")
    each = lines.select(F.explode(pairs).alias("p"))
    return each.select(F.get("p", F.lit(0)).try_cast("date").alias("day"), finite(F.get("p", F.lit(1))).alias("value")).where("day is not null and value is not null")
