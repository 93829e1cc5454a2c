"""The newest factors are made for one session alone."""

from tidemark import plans
from tidemark.plans import universe


def test_latest_factors_cover_one_session(spark, monkeypatch):
    seen, stage = [], universe.staged
    monkeypatch.setattr(universe, "staged", lambda df, name: seen.append(df) or stage(df, name))
    got = plans.QUERIES["x78_latest_factors"](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 1 and seen[0].select("session").distinct().count() == 1
    assert {r["session"] for r in got} == {r["session"] for r in seen[0].select("session").distinct().collect()}
