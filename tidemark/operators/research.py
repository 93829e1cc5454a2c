"""Weights from a training window alone: evidence classes, redundancy groups, normalised information ratios."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import staged

from .metrics import factor_correlation, forward_returns, ic_summary, rank_ic


def split_sessions(px: DataFrame, count: int, ratio: float) -> DataFrame:
    """(session, part): the newest `count` sessions, the first int(count * ratio) of them train, the others test. Fewer sessions,
    or a part of under two, are an error."""
    train = int(count * ratio)
    if train < 2 or count - train < 2:
        raise ValueError("both parts need two sessions or more")
    days = px.select("session").distinct()
    w = Window.orderBy(F.desc("session"))  # the list of sessions
    last = days.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= count).withColumn("__n", F.max("__i").over(Window.partitionBy()))
    part = F.when(F.col("__n") < count, F.raise_error(F.lit("too few sessions to split")).cast("string")).when(F.col("__i") > count - train, "train").otherwise("test")
    return last.select("session", part.alias("part"))


def train_only(df: DataFrame, split: DataFrame) -> DataFrame:
    """The rows of training sessions. Everything that is learned is derived from what this returns, forward returns too, so
    nothing can look past the last training session."""
    return df.join(F.broadcast(split.where("part = 'train'").select("session")), "session", "left_semi")  # the list of sessions


def evidence(stats: DataFrame) -> DataFrame:
    """stats (factor, n, mean, t, ...) with its evidence class."""
    # fixed values: names and limits of the classes
    kind = (
        F.when(F.col("mean").isNull() | F.col("t").isNull() | (F.col("n") < 2), "insufficient_data")
        .when(F.abs("t") < 2, "ineffective")
        .when(F.col("mean") > 0, "significant_positive")
        .otherwise("significant_reverse")
    )
    return stats.withColumn("class", kind)


def redundancy(corr: DataFrame, factors: list[str], limit: float = 0.8) -> DataFrame:
    """(factor, grp): groups of factors connected by pairs with an absolute correlation above the limit; grp is the first name.
    Only factors that have such a pair. The closure is squared until paths of any length are in it; it has at most as many
    rows as there are pairs of factors."""
    pairs = corr.where((F.abs("corr") > limit) & (F.col("left") != F.col("right"))).select(F.col("left").alias("a"), F.col("right").alias("b"))
    both = pairs.union(pairs.select("b", "a"))
    reach = staged(both.union(both.select("a", F.col("a").alias("b"))).distinct(), "reach")
    for _ in range(max(1, math.ceil(math.log2(max(2, len(factors)))))):
        further = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        reach = reach.union(reach.join(further, "b").select("a", F.col("c").alias("b"))).distinct()
    return reach.groupBy(F.col("a").alias("factor")).agg(F.min("b").alias("grp"))


def train_weights(px: DataFrame, wide: DataFrame, factors: list[str], count: int, ratio: float = 0.7, horizon: int = 1, limit: float = 0.8, every: int = 20) -> DataFrame:
    """(factor, n, mean, ir, t, class, grp, retained, redundant, weight) for each factor, from the training sessions of px
    (symbol, session, px) and wide (symbol, session, z_<factor>...). Of a redundancy group the factor with the largest absolute
    IR stays (ties: the one named first); the others, and factors without an IR, weigh 0; absolute weights sum to 1. No
    usable IR is an error."""
    split = split_sessions(px, count, ratio)
    known, values = train_only(px, split), train_only(wide, split)
    long = values.select("symbol", "session", F.expr(f"stack({len(factors)}, {', '.join(f"'{f}', z_{f}" for f in factors)}) as (factor, z)"))
    ic = rank_ic(long.join(forward_returns(known, (horizon,)), ["symbol", "session"]), "z", "future", ["factor", "session"])
    place = F.expr("CASE factor " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(factors)) + " END")
    names = px.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    stats = evidence(names.join(ic_summary(ic, ["factor"]), "factor", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    groups = redundancy(factor_correlation(values, factors, every), factors, limit)
    d = stats.join(groups, "factor", "left").withColumn("__place", place)
    best = F.struct(F.abs("ir").alias("v"), (-F.col("__place")).alias("p"))
    w = Window.partitionBy("grp")
    d = d.withColumn("retained", F.when(F.col("grp").isNotNull(), F.max_by("factor", F.when(F.col("ir").isNotNull(), best)).over(w)))
    d = d.withColumn("redundant", F.coalesce(F.col("retained") != F.col("factor"), F.lit(False)))
    used = F.when(~F.col("redundant") & F.col("ir").isNotNull(), F.col("ir")).otherwise(0.0)
    total = F.sum(F.abs("__u")).over(Window.partitionBy())  # a row a factor
    d = d.withColumn("__u", used).withColumn("__t", total)
    weight = F.when(F.col("__t") > 0, F.col("__u") / F.col("__t")).otherwise(F.raise_error(F.lit("no factor has an information ratio to weigh by")).cast("double"))
    return d.withColumn("weight", weight).drop("__u", "__t", "__place")
