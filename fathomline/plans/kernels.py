"""Queries that only Python kernels express; no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ship
from ..operators import joins, kernels
from .views import query


def _on(body, then):
    def run(spark, sf_dir):
        ship(spark)
        return then(query(body)(spark, sf_dir))

    return run


QUERIES = {
    "snooping_report": _on("SELECT 'all' AS g, symbol, ts, r FROM small", lambda d: kernels.snooping_report(d, "g", "ts", "symbol", "r", draws=2000)),
    "online_fdr": _on("SELECT event_type AS g, event_id, exp(-value / 10) AS p FROM events", lambda d: kernels.online_fdr(d, "g", ["event_id"], "p")),
    "hurst_dfa_and_wavelet_energy": _on("SELECT symbol, ts, r FROM small", lambda d: kernels.by_series(d, "symbol", "ts", "r")),
    "asof_join": _on("SELECT symbol, ts, close FROM hourly", lambda d: joins.asof(d, d.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.sum("close").alias("coarse")), ["symbol"], "ts", "coarse", 1)),
    "islands": _on("SELECT symbol, d FROM flags", lambda d: joins.islands(d, ["symbol"], "d", 2)),
}

ORACLES = {
    "asof_join": "WITH c AS (SELECT symbol, ts, lag(v) OVER (PARTITION BY symbol ORDER BY ts) AS v FROM (SELECT symbol, date_trunc('day', ts) AS ts, sum(close) AS v FROM hourly GROUP BY 1, 2)), d AS (SELECT symbol, ts, v, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS until FROM c) SELECT h.symbol, h.ts, h.close, d.v AS coarse FROM hourly h LEFT JOIN d ON h.symbol = d.symbol AND h.ts >= d.ts AND (d.until IS NULL OR h.ts < d.until)",
    "islands": "WITH f AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY d) AS p FROM flags), g AS (SELECT symbol, d, sum(CASE WHEN p IS NULL OR date_diff('day', p, d) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY d) AS i FROM f) SELECT symbol, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM g GROUP BY symbol, i",
}
