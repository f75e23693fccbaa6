"""SQL oracles of the streaming queries: delivery, watermarks and state written as plain SQL."""

from __future__ import annotations

from veilmark.functions import rules as R
from veilmark.plans.oracle import ORACLE
from veilmark.plans.oracle_sql import audit_cte, detect_ctes, masked_ctes, q
from veilmark.plans.stream_queries import SCAN_SECONDS, UPLOAD_SECONDS, UPLOADS_FROM

__all__ = ["ORACLE"]

WAVES = 4
_IN = {k: ", ".join(q(e) for e in v) for k, v in (("files", R.FILE_EVENTS), ("tasks", R.TASK_EVENTS), ("incidents", R.INCIDENT_EVENTS))}
_GROUP = "CASE " + " ".join(f"WHEN event IN ({v}) THEN '{k}'" for k, v in _IN.items()) + " ELSE 'other' END"
_WAVED = f"""{audit_cte()},
days AS (SELECT min(timestamp::DATE) AS d0, date_diff('day', min(timestamp::DATE), max(timestamp::DATE)) + 1 AS n FROM audit),
waved AS (SELECT audit.*, coalesce(floor(date_diff('day', d0, timestamp::DATE) * {WAVES} / n)::INTEGER, 0) AS own,
          coalesce(session_id::BIGINT % 10 = 3, false) AS slow FROM audit, days)"""

ORACLE["stream_daily_counts"] = f"""WITH {_WAVED},
sent AS (SELECT *, least({WAVES - 1}, own + CASE WHEN slow THEN 1 ELSE 0 END) AS wave FROM waved),
marks AS (SELECT w.wave, (SELECT max(timestamp) FROM sent s WHERE s.wave < w.wave) - INTERVAL 1 DAY AS mark
          FROM (SELECT DISTINCT wave FROM sent) w),
judged AS (SELECT date_trunc('day', timestamp) AS day_start, {_GROUP} AS counter,
           coalesce(date_trunc('day', timestamp) + INTERVAL 1 DAY <= mark, false) AS late FROM sent JOIN marks USING (wave))
SELECT day_start, counter, count(*) FILTER (WHERE NOT late) AS n_events, count(*) FILTER (WHERE late) AS n_late
FROM judged WHERE day_start IS NOT NULL GROUP BY 1, 2"""

_GAP, _DELAY = f"INTERVAL {R.SESSION_TTL_SECONDS} SECOND", "INTERVAL 10 MINUTE"
ORACLE["stream_sessions"] = f"""WITH {_WAVED},
ends AS (SELECT own, max(timestamp) AS last FROM waved GROUP BY own),
kept AS (SELECT session_id, timestamp FROM waved JOIN ends USING (own)
         WHERE timestamp IS NOT NULL AND NOT (slow AND timestamp + {_GAP} + {_DELAY} <= last)),
g AS (SELECT session_id, timestamp, CASE WHEN lag(timestamp) OVER w IS NULL OR timestamp >= lag(timestamp) OVER w + {_GAP}
      THEN 1 ELSE 0 END AS brk FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY timestamp)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT session_id, min(timestamp) AS session_start, max(timestamp) + {_GAP} AS expires_at, count(*) AS n_events
FROM s GROUP BY session_id, sid HAVING max(timestamp) + {_GAP} <= (SELECT max(timestamp) FROM kept) - {_DELAY}"""

ORACLE["stream_late_results"] = f"""WITH d AS (
  SELECT doc_id, coalesce(n_chars, 0) AS n, {UPLOADS_FROM} + doc_id * {UPLOAD_SECONDS} AS up,
         (coalesce(n_chars, 0) * 7 + doc_id * 13) % {SCAN_SECONDS} AS took,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM documents WHERE doc_id IS NOT NULL
), s AS (SELECT *, CASE WHEN gone THEN 'gone' WHEN n > 0 AND took <= 360 THEN 'merged' ELSE 'unmatched' END AS status FROM d)
SELECT doc_id, make_timestamp(up * 1000000) AS uploaded_at,
       CASE WHEN status = 'merged' THEN make_timestamp((up + took) * 1000000) END AS done_at, status FROM s"""

ORACLE["stream_upsert"] = f"""WITH {audit_cte()}
SELECT session_id, max(event_id) AS event_id, arg_max(event, event_id) AS event, count(*) AS n_events FROM audit GROUP BY session_id"""

ORACLE["stream_mask"] = f"WITH {detect_ctes()}, {masked_ctes()} SELECT doc_id, masked_text, n_spans FROM masked"
