"""Hand-worked cases of quotes, audits and evidence classes."""

from pyspark.sql import functions as F
from tidemark.operators import signals


def test_evidence_classes(spark):
    cases = [(5, 0.1, 2.0, "positive"), (5, -0.1, -2.5, "negative"), (5, 0.1, 1.999, "ineffective"), (1, 0.1, 3.0, "insufficient"), (5, None, 3.0, "insufficient"), (5, 0.1, None, "insufficient")]
    d = spark.createDataFrame(cases, "n int, ic double, t double, want string")
    assert d.where(signals.evidence_class(F.col("n"), F.col("ic"), F.col("t")) != F.col("want")).count() == 0


def test_provider_audit(spark):
    d = spark.createDataFrame([("cache-audited:exchange+vendor_b", True), ("cache-audited:", False), ("exchange", True), (" Exchange ", True), ("cache-resampled:vendor_a+", True), ("mock", False), ("cache-audited:mock", False), (None, False)], "p string, want boolean")
    assert d.where(signals.provider_audited(F.col("p")) != F.col("want")).count() == 0


def test_quotes(spark):
    schema = "symbol string, source string, priority int, last string, last_alt double, prev string, prev_alt double, high double, amount double, suspended boolean"
    rows = [("a", "x", 0, "1", None, "2", None, 3.0, 5.0, None), ("a", "y", 1, "inf", 4.0, None, 2.0, None, -1.0, False), ("b", "x", 0, "1", None, "1", None, 1.0, 1.0, True), ("c", "x", 0, "-1", None, "1", None, 1.0, 1.0, False)]
    assert [tuple(r) for r in signals.normalise_quotes(spark.createDataFrame(rows, schema)).collect()] == [("a", "y", 4.0, 2.0, 4.0, 0.0, 100.0)]
