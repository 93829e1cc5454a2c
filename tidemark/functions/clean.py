"""Normalisation of provider values: numbers, symbols, boards, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sources whose rows may be used; anything else, mock data included, is not audited
AUDITED = ("exchange", "vendor_a", "vendor_b")
ZONE = "Asia/Shanghai"
DECISION = "19:30:00"


def finite(x: Column) -> Column:
    """A double, or null for what is not a finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def six_digits(x: Column) -> Column:
    """The last dotted part, if it is six digits."""
    last = F.element_at(F.split(F.trim(x), "\\."), -1)
    return F.when(last.rlike("^[0-9]{6}$"), last)


def pad_code(x: Column) -> Column:
    """Digits of a code without its market prefix, left-padded to six."""
    return F.lpad(F.regexp_replace(F.lower(F.trim(x)), "^(sh|sz|bj)[.]?|[^0-9]", ""), 6, "0")


def board(s: Column) -> Column:
    # fixed values: prefixes of the boards
    return (
        F.when(s.startswith("688"), "STAR")
        .when(s.startswith("300") | s.startswith("301"), "CHINEXT")
        .when(s.startswith("4") | s.startswith("8") | s.startswith("92"), "BSE")
        .otherwise("MAIN")
    )


def exchange_suffix(s: Column) -> Column:
    return F.when(board(s) == "BSE", "BJ").when(s.startswith("6") | s.startswith("9"), "SH").otherwise("SZ")


def limit_ratio(board_col: Column, is_st: Column) -> Column:
    """Daily price limit: 5 % for ST and for unknown ST status, then by board."""
    return F.when(is_st.isNull() | is_st, 0.05).when(board_col == "BSE", 0.30).when(board_col.isin("CHINEXT", "STAR"), 0.20).otherwise(0.10)


def limit_price(ref: Column, ratio: Column, up: bool) -> Column:
    """Reference price times 1 +- ratio, rounded half up to a cent in decimals."""
    moved = ref * ((F.lit(1.0) + ratio) if up else (F.lit(1.0) - ratio))
    return F.round(moved.cast("decimal(18,6)"), 2).cast("double")


def cutoff(day: Column) -> Column:
    """The UTC instant of the decision time on a local day."""
    return F.to_utc_timestamp(F.concat_ws(" ", day.cast("date").cast("string"), F.lit(DECISION)).cast("timestamp"), ZONE)


def visible(df: DataFrame, available: str, at: Column) -> DataFrame:
    """Rows known at the instant: later ones, and rows of unknown availability, are invisible."""
    return df.where(F.col(available) <= at)


def audited(df: DataFrame, source: str = "source") -> DataFrame:
    return df.where(F.col(source).isin(*AUDITED))


def local_seconds(ts: Column) -> Column:
    """Seconds since local midnight of a UTC time."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), ZONE)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def market_open(ts: Column) -> Column:
    """Weekday and local time in [09:25, 15:05]."""
    local, s = F.from_utc_timestamp(ts.cast("timestamp"), ZONE), local_seconds(ts)
    return (F.weekday(local) < 5) & s.between(9 * 3600 + 25 * 60, 15 * 3600 + 5 * 60)
