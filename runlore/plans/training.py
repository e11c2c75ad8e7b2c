"""Queries of the general problems 1 and 4, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.operators import activity, bad_rows
from runlore.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.split_records(table(spark, sf, "history_lines"))[1].select("line_id")


def p1_entries(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.split_records(table(spark, sf, "history_lines"))[0]


def p1_failed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.failed_lines(table(spark, sf, "history_lines"))


def p1_physical(spark: SparkSession, sf: str) -> DataFrame:
    """The csv files line by line, joined to records again: file, first line, number of lines and characters."""
    rows = table(spark, sf, "history_lines").where("fmt = 'csv'").select("file_name", "line_no", F.posexplode(F.split("raw", "\n")).alias("k", "text"))
    wide = 1_000_000  # lines of one row at most between two rows
    lines = rows.select("file_name", (F.col("line_no").cast("long") * wide + F.col("k")).alias("line_no"), "text")
    r = bad_rows.physical_records(lines, block=bad_rows.LINES * wide)
    return r.select("file_name", "line_no", "n_lines", F.length("raw").cast("long").alias("n_chars"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return activity.history_sessions(table(spark, sf, "history"))


def p4_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How long sessions are: per number of events, sessions and their whole duration."""
    s = activity.history_sessions(table(spark, sf, "history"))
    return s.groupBy("n_events").agg(F.count("*").alias("n_sessions"), F.sum(F.col("ended_at") - F.col("started_at")).alias("span_s"))


STREAM_SQL = """stream AS (
  SELECT device, repo, min(seq) AS seq, command, ts, dir, exit_code, duration_ms, session
  FROM history WHERE NOT coalesce(imported, false)
  GROUP BY device, repo, command, ts, dir, exit_code, duration_ms, session, imported)"""

SESSIONS_SQL = f"""{STREAM_SQL}, seen AS (
  SELECT *, nullif(session, '') AS s, coalesce(duration_ms, 0) // 1000 AS dur,
         lag(ts) OVER w AS pts, lag(nullif(session, '')) OVER w AS ps
  FROM stream WINDOW w AS (PARTITION BY device, repo ORDER BY ts, seq)), flagged AS (
  SELECT *, CASE WHEN pts IS NULL THEN 1 WHEN s IS NOT NULL AND ps IS NOT NULL THEN CAST(s <> ps AS INT)
                 ELSE CAST(ts - dur - pts > 300 AS INT) END AS opens FROM seen), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY device, repo ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM flagged), sessions AS (
  SELECT arg_min(seq, (ts, seq)) AS first_seq, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events
  FROM numbered GROUP BY device, repo, k)"""

_CSV_OK = r"""^("[0-9]+"|[0-9]+),("[0-9]{10}"|[0-9]{10}),("[0-9]*"|[0-9]*),("[0-9]*"|[0-9]*),("([^"]|"")*"|[^",\r\n]*),("([^"]|"")*[^"\s]([^"]|"")*"|"([^"]|"")*""([^"]|"")*"|[^",\r\n]*[^",\s][^",\r\n]*)$"""

#: DuckDB reads a comma before the closing brace; JSON has none there.
P1_SQL = f"""WITH r AS (
  SELECT line_id, fmt, regexp_replace(raw, '\\r$', '') AS raw FROM history_lines), lines AS (
  SELECT * FROM r WHERE trim(raw, ' \t') <> ''), js AS (
  SELECT line_id, raw, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw END AS j FROM lines WHERE fmt = 'jsonl'), typed AS (
  SELECT line_id, ok AND NOT regexp_matches(raw, ',\\s*[}}]\\s*$') AND json_type(j) = 'OBJECT' AND json_type(j, '$.command') = 'VARCHAR' AND trim(json_extract_string(j, '$.command')) <> ''
    AND json_type(j, '$.dir') = 'VARCHAR' AND json_type(j, '$.ts') IN ('BIGINT', 'UBIGINT', 'VARCHAR')
    AND regexp_full_match(json_extract_string(j, '$.ts'), '[0-9]{{10}}')
    AND coalesce(json_type(j, '$.exit_code'), 'NULL') IN ('NULL', 'BIGINT', 'UBIGINT')
    AND coalesce(json_type(j, '$.duration_ms'), 'NULL') IN ('NULL', 'UBIGINT') AS good FROM js)
SELECT line_id FROM lines WHERE fmt = 'zsh' AND regexp_matches(raw, '^:[ \\t]*[0-9]')
  AND NOT regexp_full_match(raw, ':[ \\t]*[0-9]{{10}}:[0-9]*;\\s*\\S.*', 's')
UNION ALL SELECT line_id FROM lines WHERE fmt = 'fish' AND NOT (
  regexp_full_match(raw, '- cmd: [^\\n]*[^\\s][^\\n]*(\\n[ \\t][^\\n]*)*')
  AND NOT regexp_matches(regexp_replace(raw, '\\n  when:[ \\t]*[0-9]{{10}}[ \\t]*(\\n|$)', chr(10), 'g'), '\\n  when:'))
UNION ALL SELECT line_id FROM lines WHERE fmt = 'csv' AND NOT regexp_full_match(raw, '{_CSV_OK[1:-1]}')
UNION ALL SELECT line_id FROM typed WHERE NOT coalesce(good, false)"""

_ENTRY_SQL = r"""WITH r AS (SELECT line_id, file_name, fmt, regexp_replace(raw, '\r$', '') AS raw FROM history_lines), lines AS (
  SELECT * FROM r WHERE trim(raw, ' ' || chr(9)) <> ''), fish AS (
  SELECT *, str_split(raw, chr(10)) AS ls FROM lines WHERE fmt = 'fish'), fishes AS (
  SELECT *, rtrim(substr(ls[1], 8), chr(13)) AS cmd, list_filter(ls[2:], lambda x: NOT regexp_matches(x, '^[ \t]') OR (regexp_matches(x, '^(  |\t)when:') AND NOT regexp_full_match(x, '(  |\t)when:[ \t]*[0-9]{10}[ \t]*\r*'))) AS bad,
    list_filter(ls[2:], lambda x: regexp_full_match(x, '(  |\t)when:[ \t]*[0-9]{10}[ \t]*\r*')) AS whens FROM fish), js0 AS (
  SELECT *, json_valid(raw) AND NOT regexp_matches(raw, ',\s*\}\s*$') AS ok FROM lines WHERE fmt = 'jsonl'), js AS (
  SELECT *, CASE WHEN ok THEN raw END AS j FROM js0), cs AS (
  SELECT *, regexp_replace(raw, '"[^"]*"', '', 'g') AS bare, regexp_full_match(raw, '("([^"]|"")*"|[^",\r\n]*)(,("([^"]|"")*"|[^",\r\n]*))*') AS sound, length(raw) - length(replace(raw, '"', '')) AS q,
    [CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END FOR x IN regexp_extract_all(raw, '(?:^|,)("(?:[^"]|"")*"|[^",\r\n]*)', 1)] AS f FROM lines WHERE fmt = 'csv'), parsed AS (
  SELECT line_id, file_name, fmt, CASE WHEN NOT regexp_matches(raw, '^:[ \t]*[0-9]') OR regexp_full_match(raw, ':[ \t]*[0-9]{10}:[0-9]*;\s*\S.*', 's') THEN 'ok' WHEN regexp_full_match(raw, ':[ \t]*[0-9]{10}:[0-9]*;.*', 's') THEN 'command is blank' ELSE 'zsh header is damaged' END AS reason,
    CASE WHEN regexp_matches(raw, '^:[ \t]*[0-9]') THEN regexp_extract(raw, '^:[ \t]*[0-9]{10}:[0-9]*;(.*)$', 1, 's') ELSE raw END AS command, CASE WHEN regexp_matches(raw, '^:[ \t]*[0-9]') THEN regexp_extract(raw, '^:[ \t]*([0-9]+)', 1) END AS ts FROM lines WHERE fmt = 'zsh'
  UNION ALL SELECT line_id, file_name, fmt, CASE WHEN NOT starts_with(raw, '- cmd: ') THEN 'fish record does not start with a command' WHEN NOT regexp_matches(cmd, '\S') THEN 'command is blank'
    WHEN len(bad) = 0 THEN 'ok' WHEN regexp_matches(bad[1], '^[ \t]') THEN 'ts is not ten digits' ELSE 'fish line is not indented' END,
    replace(replace(replace(cmd, '\\', chr(1)), '\n', chr(10)), chr(1), '\'), CASE WHEN len(whens) > 0 THEN regexp_extract(whens[len(whens)], '([0-9]{10})', 1) END FROM fishes
  UNION ALL SELECT line_id, file_name, fmt, CASE WHEN NOT ok OR json_type(j) <> 'OBJECT' THEN 'not one JSON object' WHEN coalesce(json_type(j, '$.command'), '') <> 'VARCHAR' THEN 'command is not a string' WHEN NOT regexp_matches(json_extract_string(j, '$.command'), '\S') THEN 'command is blank'
    WHEN coalesce(json_type(j, '$.dir'), '') <> 'VARCHAR' THEN 'dir is not a string' WHEN coalesce(json_type(j, '$.ts'), '') NOT IN ('BIGINT', 'UBIGINT', 'VARCHAR') OR NOT regexp_full_match(json_extract_string(j, '$.ts'), '[0-9]{10}') THEN 'ts is not ten digits'
    WHEN coalesce(json_type(j, '$.exit_code'), 'NULL') NOT IN ('NULL', 'BIGINT', 'UBIGINT') THEN 'exit_code is not an integer' WHEN coalesce(json_type(j, '$.duration_ms'), 'NULL') NOT IN ('NULL', 'UBIGINT') THEN 'duration_ms is not an integer of at least 0' ELSE 'ok' END,
    json_extract_string(j, '$.command'), json_extract_string(j, '$.ts') FROM js
  UNION ALL SELECT line_id, file_name, fmt, CASE WHEN contains(split_part(bare, '"', 1), chr(10)) THEN 'csv line end outside quotes' WHEN q % 2 = 1 THEN 'csv quote is not closed' WHEN NOT sound THEN 'csv quoting' WHEN len(f) <> 6 THEN 'csv has ' || len(f) || ' fields'
    WHEN NOT regexp_full_match(f[1], '[0-9]+') THEN 'seq is not a number' WHEN NOT regexp_full_match(f[2], '[0-9]{10}') THEN 'ts is not ten digits' WHEN NOT regexp_full_match(f[3], '[0-9]*') THEN 'exit_code is not a number'
    WHEN NOT regexp_full_match(f[4], '[0-9]*') THEN 'duration_ms is not a number' WHEN NOT regexp_matches(f[6], '\S') THEN 'command is blank' ELSE 'ok' END, f[6], f[2] FROM cs)"""

#: Quotes are summed over whole files; a line that is a record by itself starts anew.
_PHYSICAL_SQL = f"""WITH l AS (SELECT file_name, line_no, generate_subscripts(str_split(raw, chr(10)), 1) - 1 AS k, unnest(str_split(raw, chr(10))) AS text FROM history_lines WHERE fmt = 'csv'), d AS (
  SELECT file_name, CAST(line_no AS BIGINT) * 1000000 + k AS pos, text, regexp_matches(text, '{bad_rows.WHOLE_LINE}') AS whole, length(text) - length(replace(text, '"', '')) AS q FROM l), s AS (
  SELECT *, coalesce(sum(CASE WHEN whole THEN 0 ELSE q END) OVER (PARTITION BY file_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d), b AS (
  SELECT *, coalesce(last_value(CASE WHEN whole THEN before END IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s), r AS (
  SELECT *, max(CASE WHEN whole OR (before - base) % 2 = 0 THEN pos END) OVER (PARTITION BY file_name ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rec FROM b)
SELECT file_name, rec AS line_no, count(*) AS n_lines, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_chars FROM r GROUP BY file_name, rec"""

QUERIES = {"p1_found": p1_found, "p1_entries": p1_entries, "p1_failed_lines": p1_failed_lines, "p1_physical": p1_physical, "p4_found": p4_found, "p4_totals": p4_totals}
ORACLE = {
    "p1_found": P1_SQL,
    "p1_entries": f"{_ENTRY_SQL} SELECT line_id, command, CAST(ts AS BIGINT) AS ts FROM parsed WHERE reason = 'ok'",
    "p1_failed_lines": f"{_ENTRY_SQL} SELECT file_name, fmt, reason, count(*) AS n_lines FROM parsed GROUP BY ALL",
    "p1_physical": _PHYSICAL_SQL,
    "p4_found": f"WITH {SESSIONS_SQL} SELECT * FROM sessions",
    "p4_totals": f"WITH {SESSIONS_SQL} SELECT n_events, count(*) AS n_sessions, CAST(sum(ended_at - started_at) AS BIGINT) AS span_s FROM sessions GROUP BY n_events",
}
