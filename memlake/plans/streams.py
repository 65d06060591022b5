"""Queries that drain the given tables as streams, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.sources import fixtures as X
from memlake.sources.scratch import shared_dir
from memlake.streaming import drain as DR
from memlake.streaming import stateful as ST

QUERIES: dict = {}
ORACLES: dict = {}
PIECES = 4


def _scratch(s) -> str:
    return f"{shared_dir(s)}/memlake/stream-{uuid.uuid4().hex}"


def _through(s, rows, order, stateful):
    """rows in pieces through a stateful stream; what it has written."""
    path = _scratch(s)
    stream = stateful(DR.in_pieces(rows, order, PIECES, f"{path}/in"))
    ST.into_table(s, stream, f"{path}/out", f"{path}/check")
    return s.read.schema(stream.schema).parquet(f"{path}/out")


def _attempts(s, d):
    """Every change of a path is an attempt to claim it, by one of five workers; that of kind 'removed' completes the claim of the first two."""
    j = X.journal(s, d).where("path is not null")
    return j.selectExpr("concat(repo_id, '/', path) as key", "seq", "unix_millis(cast(detected_at as timestamp)) as ms", "case when change = 'removed' then seq % 2 else seq % 5 end as worker", "case when change = 'removed' then 'complete' else 'claim' end as kind")


QUERIES["r03_claims_stream"] = lambda s, d: _through(s, _attempts(s, d), "ms", ST.claims)
ORACLES["r03_claims_stream"] = f"""WITH RECURSIVE {X.JOURNAL}, a AS (SELECT repo_id || '/' || path AS key, seq, epoch_us(detected_at) // 1000 AS ms, CASE WHEN change = 'removed' THEN seq % 2 ELSE seq % 5 END AS worker, CASE WHEN change = 'removed' THEN 'complete' ELSE 'claim' END AS kind FROM journal WHERE path IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM a),
    r AS (SELECT key, i, seq, ms, worker, kind, kind = 'claim' AS accepted, CASE WHEN kind = 'claim' THEN worker END AS holder, CASE WHEN kind = 'claim' THEN ms END AS since, CAST(NULL AS BIGINT) AS freed_at, CAST(NULL AS BIGINT) AS freed FROM n WHERE i = 1
      UNION ALL SELECT key, i, seq, ms, worker, kind, ok, CASE WHEN kind = 'claim' AND ok THEN worker WHEN kind = 'complete' AND ok THEN NULL ELSE held END, CASE WHEN kind = 'claim' AND ok THEN ms WHEN kind = 'complete' AND ok THEN NULL ELSE held_since END, freed_at, freed
      FROM (SELECT *, CASE WHEN kind = 'claim' THEN held IS NULL ELSE held IS NOT NULL AND held = worker END AS ok FROM (
        SELECT n.*, CASE WHEN r.since + {ST.STALE_MS} <= n.ms THEN NULL ELSE r.holder END AS held, CASE WHEN r.since + {ST.STALE_MS} <= n.ms THEN NULL ELSE r.since END AS held_since, CASE WHEN r.since + {ST.STALE_MS} <= n.ms THEN r.since + {ST.STALE_MS} END AS freed_at, CASE WHEN r.since + {ST.STALE_MS} <= n.ms THEN r.holder END AS freed FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)))
    SELECT key, seq, ms, worker, kind, accepted FROM r UNION ALL SELECT key, -1, freed_at, freed, 'free', true FROM r WHERE freed IS NOT NULL
    UNION ALL SELECT key, -1, since + {ST.STALE_MS}, holder, 'free', true FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1) WHERE since + {ST.STALE_MS} <= (SELECT max(ms) FROM a)"""


def _wanted(s, d):
    """Every event of a user wants a state; users that came to an end are forgotten after a day."""
    e = X.read(s, d, "events")
    return e.selectExpr("concat('u', user_id) as key", "event_id as seq", "unix_millis(cast(ts as timestamp)) as ms", "case event_type when 'click' then 'in_progress' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'abandoned' else 'created' end as wanted")


_ENDED = "state NOT IN ('created', 'in_progress')"
QUERIES["l04_life_cycle_stream"] = lambda s, d: _through(s, _wanted(s, d), "ms", ST.life_cycles)
ORACLES["l04_life_cycle_stream"] = f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, event_id AS seq, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'abandoned' ELSE 'created' END AS wanted FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM e),
    r AS (SELECT key, i, seq, wanted <> 'created' AS accepted, wanted AS state, ms AS since FROM n WHERE i = 1
      UNION ALL SELECT key, i, seq, ok, CASE WHEN ok THEN wanted ELSE was END, CASE WHEN ok THEN ms ELSE was_since END FROM (
        SELECT *, CASE was WHEN 'created' THEN wanted <> 'created' WHEN 'in_progress' THEN wanted NOT IN ('created', 'in_progress') ELSE false END AS ok FROM (
          SELECT n.*, CASE WHEN {_ENDED} AND since + {ST.FORGET_MS} <= n.ms THEN 'created' ELSE state END AS was, CASE WHEN {_ENDED} AND since + {ST.FORGET_MS} <= n.ms THEN n.ms ELSE since END AS was_since FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)))
    SELECT key, seq, accepted, state FROM r"""


def _drained(s, d):
    """Changes of paths with a content that often stays the same."""
    j = X.journal(s, d).where("path is not null")
    rows = j.selectExpr("seq", "concat(repo_id, '/', path) as path", "case when change <> 'removed' then md5(concat(path, seq % 3)) end as hash")
    path = _scratch(s)
    drain = DR.Drain(s, f"{path}/state")
    DR.run(s, DR.in_pieces(rows, "seq", PIECES, f"{path}/in"), drain, f"{path}/check")
    return drain.effects()


QUERIES["r04_drained_once"] = _drained
ORACLES["r04_drained_once"] = f"""WITH {X.JOURNAL}, h AS (SELECT seq, repo_id || '/' || path AS path, CASE WHEN change <> 'removed' THEN md5(path || (seq % 3)) END AS hash FROM journal WHERE path IS NOT NULL),
    b AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY seq) AS before FROM h) SELECT seq, path, hash, CASE WHEN hash IS NULL THEN 'retire' WHEN before IS NULL THEN 'index' ELSE 'refresh' END AS action FROM b WHERE hash IS DISTINCT FROM before"""
