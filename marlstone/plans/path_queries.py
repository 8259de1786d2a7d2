"""Conditional path studies over the weekly bars, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import paths as pt
from marlstone.sources.bindings import BARS, bars

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LOOKBACK, H, UP, DOWN = 12, 4, 0.2, 0.15
EDGES = {"trailing_return": [0.0], "drawdown": [-0.2], "realised_vol": [2.5]}
STUDY = f"""{BARS}, n AS (SELECT symbol, date, close, high, low, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) - 1 AS last, count(*) OVER v AS have, max(high) OVER v AS target, close / first_value(close) OVER v - 1 AS tr, ln(close / lag(close) OVER w) AS r FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {LOOKBACK} PRECEDING AND CURRENT ROW)),
s AS MATERIALIZED (SELECT *, CASE WHEN have = {LOOKBACK + 1} THEN (tr >= 0)::INT || '-' || (close / target - 1 >= -0.2)::INT || '-' || (stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW) * sqrt(252) >= 2.5)::INT END AS state FROM n),
st AS MATERIALIZED (SELECT a.symbol, a.i, a.last, a.state, a.close, count(b.i) AS observed, count(b.i) = {H} AS complete, CASE WHEN count(b.i) = {H} THEN arg_max(b.close, b.i) / a.close - 1 END AS terminal, min(b.i - a.i) FILTER (b.high >= a.close * {1 + UP}) AS up, min(b.i - a.i) FILTER (b.low <= a.close * {1 - DOWN}) AS down,
  CASE WHEN a.close >= a.target THEN 0 ELSE min(b.i - a.i) FILTER (b.high >= a.target) END AS recent_high FROM s a LEFT JOIN s b ON b.symbol = a.symbol AND b.i BETWEEN a.i + 1 AND a.i + {H} GROUP BY a.symbol, a.i, a.last, a.state, a.close, a.target),
oc AS (SELECT symbol, state, min(i) AS i FROM st WHERE state IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT oc.symbol, oc.state, (SELECT min(st.i) FROM st WHERE st.symbol = oc.symbol AND st.state = oc.state AND st.i > oc.i + {H}) FROM oc WHERE oc.i IS NOT NULL),
ob AS (SELECT symbol, min(i) AS i FROM st WHERE state IS NOT NULL GROUP BY 1 UNION ALL SELECT ob.symbol, (SELECT min(st.i) FROM st WHERE st.symbol = ob.symbol AND st.state IS NOT NULL AND st.i > ob.i + {H}) FROM ob WHERE ob.i IS NOT NULL)"""
ROUND = {"p_up": 6, "p_down": 6, "p_recent_high": 6, "lo": 6, "hi": 6}


def _trained(name, prefix, match):
    return f"""{name} AS (SELECT f.symbol, f.i, count(*) AS {prefix}train_n, avg((t.up IS NOT NULL)::INT) AS {prefix}p_up, avg((t.down IS NOT NULL)::INT) AS {prefix}p_down, avg((t.recent_high IS NOT NULL)::INT) AS {prefix}p_recent_high, quantile_cont(t.terminal, 0.05) AS {prefix}lo, quantile_cont(t.terminal, 0.95) AS {prefix}hi
  FROM fc f JOIN {'oc' if match else 'ob'} o ON o.symbol = f.symbol{' AND o.state = f.state' if match else ''} AND o.i + {H} <= f.i JOIN st t ON t.symbol = o.symbol AND t.i = o.i AND t.complete GROUP BY 1, 2)"""


FORECASTS = f"""WITH RECURSIVE {STUDY}, fb AS (SELECT *, min(i) FILTER (state IS NOT NULL) OVER (PARTITION BY symbol) AS f0 FROM st WHERE i >= floor(last * 0.4::DOUBLE)), fc AS MATERIALIZED (SELECT * FROM fb WHERE (i - f0) % {H + 1} = 0),
{_trained("tc", "", True)}, {_trained("tb", "base_", False)},
fx AS (SELECT fc.symbol, fc.i, fc.state, coalesce(train_n, 0) AS train_n, coalesce(base_train_n, 0) AS base_train_n, tc.* EXCLUDE (symbol, i, train_n), tb.* EXCLUDE (symbol, i, base_train_n), complete, terminal, up, down, recent_high,
  CASE WHEN fc.state IS NULL THEN 'feature_unavailable_at_origin' WHEN least(coalesce(train_n, 0), coalesce(base_train_n, 0)) >= 5 THEN 'issued' ELSE 'insufficient_training_sample' END AS status FROM fc LEFT JOIN tc ON tc.symbol = fc.symbol AND tc.i = fc.i LEFT JOIN tb ON tb.symbol = fc.symbol AND tb.i = fc.i)"""


def _rows(spark, sf_dir):
    return pt.study_rows(bars(spark, sf_dir), LOOKBACK, H, UP, DOWN, EDGES)


@query(f"WITH RECURSIVE {STUDY} SELECT symbol, state, i FROM oc WHERE i IS NOT NULL")
def e03_state_origins(spark, sf_dir):
    return pt.origins(_rows(spark, sf_dir), H)


@query(FORECASTS + " SELECT symbol, i, state, status, train_n, base_train_n, complete, up::BIGINT AS up, down::BIGINT AS down, recent_high::BIGINT AS recent_high, round(terminal, 6) AS terminal, " + ", ".join(f"CASE WHEN status = 'issued' THEN round({b}{c}, {n}) END AS {b}{c}" for b in ("", "base_") for c, n in ROUND.items()) + " FROM fx")
def e05_path_forecasts(spark, sf_dir):
    x = pt.forecasts(_rows(spark, sf_dir), H, 0.4, 5)
    return x.select("symbol", "i", "state", "status", "train_n", "base_train_n", "complete", *[F.col(c).cast("long").alias(c) for c in pt.EVENTS], F.round("terminal", 6).alias("terminal"), *[F.round(f"{b}{c}", n).alias(f"{b}{c}") for b in ("", "base_") for c, n in ROUND.items()])


_OK = "FILTER (status = 'issued' AND complete)"


@query(FORECASTS + " SELECT symbol, count(*) AS forecasts, count(*) FILTER (status = 'issued') AS issued, count(*) " + _OK + " AS scored, CASE WHEN count(*) " + _OK + " >= 8 THEN 'sufficient_for_descriptive_scoring' ELSE 'insufficient' END AS gate, " + ", ".join(f"round(avg(pow({p}p_{e} - ({e} IS NOT NULL)::INT, 2)) {_OK}, 6) AS {n}_{e}" for e in pt.EVENTS for p, n in (("", "brier"), ("base_", "base_brier"))) + ", " + ", ".join(f"round(avg((terminal BETWEEN {p}lo AND {p}hi)::INT) {_OK}, 6) AS {p}coverage90, round(avg({p}hi - {p}lo) {_OK}, 6) AS {p}width90" for p in ("", "base_")) + " FROM fx GROUP BY symbol")
def e05_path_scores(spark, sf_dir):
    x = pt.scores(pt.forecasts(_rows(spark, sf_dir), H, 0.4, 5), 8)
    whole = ("symbol", "forecasts", "issued", "scored", "gate")
    return x.select(*whole, *[F.round(c, 6).alias(c) for c in x.columns if c not in whole])


CONE = {"q025": 0.025, "q16": 0.16, "q50": 0.5, "q84": 0.84, "q975": 0.975}
MATCHED = f"mt AS MATERIALIZED (SELECT t.* FROM oc JOIN st t ON t.symbol = oc.symbol AND t.i = oc.i JOIN st q ON q.symbol = t.symbol AND q.i = q.last AND q.state = t.state WHERE t.i < t.last), pp AS (SELECT b.i - mt.i AS step, unnest(['close', 'high', 'low']) AS kind, unnest([b.close, b.high, b.low]) / mt.close - 1 AS r FROM mt JOIN s b ON b.symbol = mt.symbol AND b.i BETWEEN mt.i + 1 AND mt.i + {H})"


@query(f"WITH RECURSIVE {STUDY}, {MATCHED} SELECT step, kind, count(*) AS n, (SELECT count(*) FROM mt) - count(*) AS censored_n, " + ", ".join(f"round(quantile_cont(r, {p}), 6) AS {n}" for n, p in CONE.items()) + " FROM pp GROUP BY step, kind")
def w19_path_cone(spark, sf_dir):
    """The origins of all symbols in the state in which each stands now, pooled."""
    x = pt.cone(_rows(spark, sf_dir), [], H, CONE)
    return x.select("step", "kind", "n", "censored_n", *[F.round(c, 6).alias(c) for c in CONE])
