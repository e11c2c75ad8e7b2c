"""SQL equivalents of the queries in ``queries``."""

from runlore.plans.training import STREAM_SQL

P3_SQL = f"""WITH {STREAM_SQL}, t AS (
  SELECT device, repo, seq, ts,
         trim(regexp_replace(regexp_replace(regexp_replace(lower(command), '[''"]', '', 'g'), '\\d+', '0', 'g'), '\\s+', ' ', 'g')) AS c FROM stream), m AS (
  SELECT *, CASE WHEN lag(c) OVER w = c AND ts - lag(ts) OVER w <= 120 THEN 0 ELSE 1 END AS opens
  FROM t WINDOW w AS (PARTITION BY device, repo ORDER BY ts, seq)), r AS (
  SELECT *, sum(opens) OVER (PARTITION BY device, repo ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT arg_min(seq, (ts, seq)) AS first_seq, count(*) AS n_events, max(ts) - min(ts) AS span_s
FROM r GROUP BY device, repo, k HAVING count(*) >= 3"""

def _grow(n: int) -> str:
    """Patterns of n steps by extending the frequent ones of n - 1, at their earliest place in each session."""
    return f"""l{n} AS (SELECT l.session, list_append(l.p, v.step) AS p, min(v.pos) AS e FROM l{n - 1} l JOIN f{n - 1} USING (p)
  JOIN ev v ON v.session = l.session AND v.pos > l.e AND NOT list_contains(l.p, v.step) GROUP BY l.session, list_append(l.p, v.step)),
f{n} AS (SELECT p, count(*) AS n FROM l{n} GROUP BY p HAVING count(*) >= 0.08 * (SELECT t FROM total))"""


_PATTERNS = f"""WITH w AS (SELECT session, ts, seq, list_filter(regexp_split_to_array(lower(command), '\\s+'), lambda x: x <> '') AS ws FROM history WHERE session <> ''), st AS (
  SELECT session, ts, seq, array_to_string(CASE WHEN ws[1] = 'sudo' THEN ws[2:3] ELSE ws[1:2] END, ' ') AS step FROM w), total AS (SELECT count(DISTINCT session) AS t FROM st), fs AS (
  SELECT step FROM st WHERE step <> '' GROUP BY step HAVING count(DISTINCT session) >= 0.08 * (SELECT t FROM total)), ev AS (
  SELECT session, step, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS pos FROM st JOIN fs USING (step)), l1 AS (
  SELECT session, [step] AS p, min(pos) AS e FROM ev GROUP BY session, step), f1 AS (SELECT DISTINCT p FROM l1), {_grow(2)}, {_grow(3)}, {_grow(4)}, {_grow(5)}, found AS (
  SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5)"""

#: DuckDB counts edits of bytes; with one byte for every character beyond ASCII they are edits of characters.
_HELD = """WITH e0 AS (
  SELECT entry_id, batch_no, device, nullif(ts, 0) AS ts, trim(regexp_replace(lower(command), '\\s+', ' ', 'g')) AS c FROM import_entries), e AS (
  SELECT *, regexp_replace(c, '[^\\x00-\\x7f]', '?', 'g') AS a FROM e0), r0 AS (
  SELECT -1 - seq AS o, device, nullif(ts, 0) AS ts, trim(regexp_replace(lower(command), '\\s+', ' ', 'g')) AS c FROM history
  UNION ALL SELECT entry_id, device, ts, c FROM e), r AS (SELECT *, regexp_replace(c, '[^\\x00-\\x7f]', '?', 'g') AS a FROM r0), near AS (
  SELECT e.entry_id FROM e JOIN r ON r.device = e.device AND r.ts BETWEEN e.ts - 5 AND e.ts + 5 AND r.o < e.entry_id
  WHERE e.c = r.c OR (length(e.c) >= 20 AND length(r.c) >= 20 AND levenshtein(e.a, r.a) <= 3)), first AS (
  SELECT device, c, min(o) AS o FROM r GROUP BY device, c), held AS (
  SELECT entry_id FROM near UNION
  SELECT e.entry_id FROM e JOIN first f ON f.device = e.device AND f.c = e.c AND f.o < e.entry_id WHERE e.ts IS NULL)"""

ORACLE = {
    "p7_found": f"{_PATTERNS} SELECT array_to_string(p, ' > ') AS steps FROM found",
    "p7_patterns": f"{_PATTERNS} SELECT array_to_string(p, ' > ') AS steps, len(p) AS n_steps, n AS support FROM found",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_found": f"{_HELD} SELECT entry_id FROM held",
    "p6_caught_up": f"{_HELD} SELECT entry_id FROM held",
    "p6_replayed": f"{_HELD} SELECT entry_id, batch_no FROM held JOIN import_entries USING (entry_id)",
    "p6_batches": f"""{_HELD} SELECT batch_no, count(*) AS n_entries, count(h.entry_id) AS duplicates, count(*) - count(h.entry_id) AS n_new
FROM import_entries i LEFT JOIN held h USING (entry_id) GROUP BY batch_no""",
    "p3_found": P3_SQL,
    "p5_found": "SELECT command FROM history GROUP BY command HAVING count(*) >= 0.005 * (SELECT count(*) FROM history)",
    "p5_counts": "SELECT command, count(*) AS n_rows FROM history WHERE command IS NOT NULL GROUP BY command ORDER BY n_rows DESC, command DESC LIMIT 20",
}
