"""Weights that are learned from the training window alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import factors as fo
from tidemark.operators import research as op

from .factors import NAMES, SCORED, price_factors
from .registry import avg_rank, query

COUNT, RATIO, EVERY = 60, 0.7, 5
#: Two blends beside the price factors: each is close to the one before it, so they form a group.
FACTORS = [*NAMES, "blend", "blend_far"]
BLENDS = {"blend": "z_momentum_short + 0.35 * z_turnover_change", "blend_far": "z_momentum_short + 0.35 * z_turnover_change + 0.7 * z_volatility"}
BLENDS_SQL = ", ".join(f"{v.replace('0.35', '0.35::DOUBLE').replace('0.7 ', '0.7::DOUBLE ')} AS z_{k}" for k, v in BLENDS.items())
TRAIN = int(COUNT * RATIO)
WEIGHTS = f"""WITH RECURSIVE {SCORED}, tr AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i FROM (SELECT session, row_number() OVER (ORDER BY session DESC) AS r FROM cal) WHERE r <= {COUNT} AND r > {COUNT - TRAIN}),
zb AS (SELECT *, {BLENDS_SQL} FROM zs WHERE session IN (SELECT session FROM tr)),
fw AS (SELECT symbol, session, lead(px, 1) OVER (PARTITION BY symbol ORDER BY session) / nullif(px, 0) - 1 AS future FROM px WHERE session IN (SELECT session FROM tr)),
lg AS ({" UNION ALL ".join(f"SELECT session, symbol, '{f}' AS factor, {i} AS place, z_{f} AS z FROM zb" for i, f in enumerate(FACTORS))}),
rk AS (SELECT *, {avg_rank("z", "factor, session")} AS ra, {avg_rank("future", "factor, session")} AS rb FROM (SELECT factor, session, z, future FROM lg JOIN fw USING (symbol, session) WHERE z IS NOT NULL AND future IS NOT NULL)),
ic AS (SELECT factor, session, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM rk GROUP BY ALL),
su AS (SELECT factor, count(*) AS n, avg(ic) AS mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t FROM ic WHERE ic IS NOT NULL GROUP BY 1),
cd AS (SELECT l.factor AS a, r.factor AS b, session, CASE WHEN count(*) >= 3 AND stddev_pop(l.z) > 1e-12 AND stddev_pop(r.z) > 1e-12 THEN covar_pop(l.z, r.z) / (stddev_pop(l.z) * stddev_pop(r.z)) END AS c
       FROM lg l JOIN lg r USING (session, symbol) WHERE l.factor < r.factor AND l.z IS NOT NULL AND r.z IS NOT NULL AND session IN (SELECT session FROM tr WHERE i % {EVERY} = 0) GROUP BY ALL),
ed AS (SELECT a, b FROM cd WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND abs(avg(c)) > .8),
sym AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, x.b FROM reach r JOIN sym x ON x.a = r.b),
grp AS (SELECT a AS factor, least(a, min(b)) AS grp FROM reach GROUP BY 1),
f AS (SELECT l.factor, l.place, coalesce(s.n, 0) AS n, s.mean, s.ir, s.t, g.grp FROM (SELECT DISTINCT factor, place FROM lg) l LEFT JOIN su s USING (factor) LEFT JOIN grp g USING (factor)),
k AS (SELECT *, CASE WHEN mean IS NULL OR t IS NULL OR n < 2 THEN 'insufficient_data' WHEN abs(t) < 2 THEN 'ineffective' WHEN mean > 0 THEN 'significant_positive' ELSE 'significant_reverse' END AS class,
      CASE WHEN grp IS NOT NULL THEN first_value(factor) OVER (PARTITION BY grp ORDER BY abs(ir) DESC NULLS LAST, place) END AS retained FROM f),
u AS (SELECT *, coalesce(retained <> factor, false) AS redundant, CASE WHEN NOT coalesce(retained <> factor, false) THEN coalesce(ir, 0) ELSE 0 END AS used FROM k)
SELECT *, used / sum(abs(used)) OVER () AS weight FROM u"""


@query("c8_train_weights", "factor n class grp retained redundant", "mean ir t weight", WEIGHTS)
def c8(spark, sf):
    b = a.bars(spark, sf)
    wide = fo.standardise(price_factors(spark, sf), NAMES, ["session"]).withColumns({f"z_{k}": F.expr(v.replace("0.35", "0.35D").replace("0.7 ", "0.7D ")) for k, v in BLENDS.items()})
    return op.train_weights(fo.adjusted(b, a.adjustments(b)), wide, FACTORS, COUNT, RATIO, every=EVERY)
