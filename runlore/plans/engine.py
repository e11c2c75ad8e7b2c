"""Queries of the engine's own operators over the command tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import redaction
from runlore.functions.text import SHELL_VARIABLES, iso, repo_key, variables
from runlore.operators import failures, importer, patterns, picks, promote, retention, runbooks, search, stats, work_sessions
from runlore.runtime import checkpointed, scratch, table
from runlore.sources.concepts import load_concepts
from runlore.streaming.capture import live_sessions

#: The instant all queries rank and age by.
NOW = 1_741_000_000
REPO = "/home/dev/src/atlas-mono"


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "history")


def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: ranked search with picks and context."""
    p = picks.pick_weights(table(spark, sf, "pick_events"), NOW)
    return search.search_many(_history(spark, sf), ["git status", "docker run"], NOW, REPO, 20, p).drop("query")


def search_expanded(spark: SparkSession, sf: str) -> DataFrame:
    concepts, stop = load_concepts()
    return search.search_expanded(_history(spark, sf), "restart the database", concepts, stop, NOW, REPO, 20)


def search_newest(spark: SparkSession, sf: str) -> DataFrame:
    return search.newest_distinct(_history(spark, sf), 200)


def session_log(spark: SparkSession, sf: str) -> DataFrame:
    return work_sessions.session_log(_history(spark, sf)).withColumn("commands", F.array_join("commands", "\n"))


def session_search(spark: SparkSession, sf: str) -> DataFrame:
    s = work_sessions.session_log(_history(spark, sf))
    return search.search_sessions(s, "Terraform Apply").select("id", "started_at", "n_commands")


def mining_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = work_sessions.with_sessions(_history(spark, sf))
    g = s.groupBy("repo_id", "run").agg(F.count("*").alias("n_commands"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select(repo_key(F.col("repo_id")).alias("repo_key"), "run", "n_commands", "first_ts", "last_ts")


def live(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming sessions over the whole table as one available batch."""
    path = f"{sf}/history.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a pattern that only this table meets
    out = scratch(spark, "live-sessions")
    q = live_sessions(stream.where("command is not null")).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).drop("commands")


def usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stats(_history(spark, sf))


def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    f = failures.recent_failures(_history(spark, sf), 50)
    return f.withColumn("followed_by", F.array_join("followed_by", "\n"))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    return failures.corrections(_history(spark, sf))


def promoted(spark: SparkSession, sf: str) -> DataFrame:
    p = promote.promote(_history(spark, sf), limit=20)
    return p.withColumn("steps", F.array_join("steps", "\n")).withColumn("variables", F.to_json("variables"))


def tool_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.tool_patterns(_history(spark, sf))


def pattern_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Generalised patterns, with a known pattern for every command."""
    h = _history(spark, sf)
    known = h.where("command is not null").select("command").distinct()
    cache = known.select(patterns.tool(F.col("command")).alias("tool"), "command", F.regexp_replace("command", "[0-9]+", "<n>").alias("pattern"))
    return patterns.generalised_patterns(h, cache)


def pick_weights(spark: SparkSession, sf: str) -> DataFrame:
    return picks.pick_weights(table(spark, sf, "pick_events"), NOW)


def rotated(spark: SparkSession, sf: str) -> DataFrame:
    return retention.rotate(_history(spark, sf), NOW, 30).groupBy("device").agg(F.count("*").alias("n_rows"), F.min("ts").alias("oldest"))


def forgotten(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    return retention.forget(h, "terraform", ["command", "dir"]).groupBy("device").agg(F.count("*").alias("n_rows"))


def forget_targets(spark: SparkSession, sf: str) -> DataFrame:
    names = ("history", "import_entries", "pick_events", "runbook_steps", "agent_audit")
    return retention.forget_targets({n: table(spark, sf, n) for n in names}, "deploy")


def runbook_listing(spark: SparkSession, sf: str) -> DataFrame:
    return runbooks.listing(table(spark, sf, "runbook_steps"))


def runbook_variables(spark: SparkSession, sf: str) -> DataFrame:
    return runbooks.declarations(table(spark, sf, "runbook_steps").distinct())


def runbook_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Values of all parameters, from an environment that knows one and defaults for the others."""
    d = checkpointed(runbooks.declarations(table(spark, sf, "runbook_steps").distinct()))
    defaults = d.where("default_value is not null").groupBy("name").agg(F.max("default_value").alias("value"))
    pairs = lambda rows: spark.createDataFrame(rows, "name string, value string")
    return runbooks.resolve(d.select("name").distinct(), pairs([("TAG", "")]), pairs([("API_TOKEN", "from-env"), ("TAG", "x")]), pairs([]), defaults)


def runbook_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return runbooks.export_markdown(table(spark, sf, "runbook_steps").distinct())


_FILES = ["device", "batch_no", "file_name"]


def import_dated(spark: SparkSession, sf: str) -> DataFrame:
    return importer.dated(table(spark, sf, "import_entries"), _FILES, "line_no", NOW).select("entry_id", "ts")


def import_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "import_entries").withColumn("source", F.format_string("%s|%03d|%s", "device", "batch_no", "file_name"))
    planned = importer.plan(e, _history(spark, sf), "source", "line_no")
    return stats.import_totals(planned.select("file_name", "verdict"))


def credential_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).where(redaction.looks_like_credential(F.col("command"))).select("seq")


def redacted(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf).select("seq", "command", redaction.redact(F.col("command")).alias("masked"))
    return h.where("command <> masked").select("seq", "masked")


def repo_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).groupBy(repo_key(F.col("repo")).alias("repo_key")).agg(F.count("*").alias("n_rows"), iso(F.max("ts")).alias("last_at"))


def command_variables(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).where(F.contains("command", F.lit("$"))).select("seq", F.array_join(F.array_sort(variables(F.col("command"))), ",").alias("names"))


def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.audit_counts(table(spark, sf, "agent_audit"))


QUERIES = {
    "search_ranked": search_ranked, "search_expanded": search_expanded, "search_newest": search_newest, "session_log": session_log, "session_search": session_search,
    "mining_sessions": mining_sessions, "live_sessions": live, "usage_stats": usage_stats, "recent_failures": recent_failures, "corrections": corrections, "promoted": promoted,
    "tool_patterns": tool_patterns, "pattern_signatures": pattern_signatures, "pick_weights": pick_weights, "rotated": rotated, "forgotten": forgotten, "forget_targets": forget_targets,
    "runbook_listing": runbook_listing, "runbook_variables": runbook_variables, "runbook_resolved": runbook_resolved, "runbook_markdown": runbook_markdown, "import_dated": import_dated,
    "import_plan": import_plan, "credential_rows": credential_rows, "redacted": redacted, "repo_keys": repo_keys, "command_variables": command_variables, "audit_counts": audit_counts,
}

# ---------------------------------------------------------------- SQL
_PICKS = f"""picks AS (SELECT command, round(sum(pow(0.5e0, greatest({NOW} - ts, 0) / (86400e0 * 21))), 6) AS weight
  FROM pick_events WHERE command <> '' AND ts IS NOT NULL GROUP BY command HAVING weight >= 0.02 ORDER BY weight DESC, command LIMIT 5000)"""
_PART = f"""0.21e0 * exp(-greatest(({NOW} - ts) / 86400e0, 0) * ln(2) / 7) + 0.09e0 *
  CASE WHEN repo = '{REPO}' THEN 1e0 WHEN contains(repo, '/') AND regexp_replace(repo, '/[^/]*$', '') = '{REPO.rpartition("/")[0]}' THEN 0.5e0 ELSE 0e0 END"""


def _ranked_sql(query: str) -> str:
    hits = " AND ".join(f"contains(lower(command), '{t}')" for t in query.split())
    return f"""SELECT command, ts, repo, frequency, score FROM (
  SELECT m.command, ts, repo, n AS frequency, round(0.40e0 * CASE WHEN coalesce(weight, 0) > 0 THEN 1 - pow(2e0, -weight) ELSE 0 END + 0.21e0 * least(1e0, ln(1 + n) / ln(51)) + part
    + 0.09e0 * CAST(starts_with(lower(m.command), '{query}') AS DOUBLE), 6) AS score
  FROM (SELECT command, ts, repo, seq, {_PART} AS part, count(*) OVER (PARTITION BY command) AS n FROM history WHERE {hits}
        QUALIFY row_number() OVER (PARTITION BY command ORDER BY part DESC, ts DESC, seq) = 1) m LEFT JOIN picks USING (command)
  ORDER BY score DESC, ts DESC, command LIMIT 20)"""


_EXP = f"""WITH c0 AS (SELECT DISTINCT command FROM history WHERE command IS NOT NULL), c AS (
  SELECT command,
    CASE WHEN contains(lower(command), 'restart') THEN 1e0 WHEN contains(lower(command), 'systemctl restart') OR contains(lower(command), 'rollout restart') THEN 0.8e0 ELSE 0e0 END AS a,
    CASE WHEN contains(lower(command), 'database') THEN 1e0 WHEN contains(lower(command), 'psql') OR contains(lower(command), 'mysql') OR contains(lower(command), 'pg_dump') OR contains(lower(command), 'redis-cli')
      OR contains(lower(command), 'alembic') THEN 0.8e0 ELSE 0e0 END AS b FROM c0), k AS (SELECT * FROM c WHERE a = 0.8e0 OR b = 0.8e0), d AS (
  SELECT count(*) AS n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM k), w AS (
  SELECT CASE WHEN n <= 1 THEN 1e0 ELSE ln(1 + (n - least(greatest(da, 1), n) + 0.5e0) / (least(greatest(da, 1), n) + 0.5e0)) / ln(1 + (n - 0.5e0) / 1.5e0) END AS wa,
         CASE WHEN n <= 1 THEN 1e0 ELSE ln(1 + (n - least(greatest(db, 1), n) + 0.5e0) / (least(greatest(db, 1), n) + 0.5e0)) / ln(1 + (n - 0.5e0) / 1.5e0) END AS wb FROM d), cov AS (
  SELECT command, CASE WHEN wa + wb > 0 THEN (a * wa + b * wb) / (wa + wb) ELSE (a + b) / 2 END AS coverage FROM k, w)
SELECT command, ts, repo, n AS frequency, round((0.21e0 * least(1e0, ln(1 + n) / ln(51)) + part + 0.09e0 * CAST(starts_with(lower(command), 'restart the database') AS DOUBLE)) * coverage, 6) AS score
FROM (SELECT h.command, ts, repo, seq, coverage, {_PART} AS part, count(*) OVER (PARTITION BY h.command) AS n FROM history h JOIN cov USING (command)
      QUALIFY row_number() OVER (PARTITION BY h.command ORDER BY part DESC, ts DESC, seq) = 1)
ORDER BY score DESC, ts DESC, command LIMIT 20"""

_LOG = """WITH f AS (SELECT *, lag(ts) OVER w AS pts, lag(repo) OVER w AS prepo, row_number() OVER w AS rn FROM history WHERE command IS NOT NULL WINDOW w AS (PARTITION BY device ORDER BY {order})),
g AS (SELECT *, CASE WHEN rn = 1 OR ts - pts > 300 OR repo IS DISTINCT FROM prepo THEN 1 ELSE 0 END AS opens FROM f),
r AS (SELECT *, sum(opens) OVER (PARTITION BY device ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT device, k, min_by(seq, ({order})) AS run, count(*) AS n, string_agg(command, chr(10) ORDER BY {order}) AS commands, min_by(command, ({order})) AS c0, max_by(ts, ({order})) AS e, min_by(repo, ({order})) AS repo FROM r GROUP BY device, k),
log AS (SELECT device || '-' || run AS id, CASE WHEN n = 1 THEN c0 ELSE c0 || ' (+' || (n - 1) || ' more commands)' END AS summary, e - 10 * n AS started_at, e AS ended_at, repo, n AS n_commands, commands, device, k FROM s)"""
_REPO_KEY = """CASE WHEN repo IS NULL OR repo = '' THEN '_global' ELSE CASE WHEN trim(regexp_replace(repo, '[^a-zA-Z0-9-]', '-', 'g'), '-') = '' THEN substr(sha256(repo), 1, 8)
  ELSE trim(regexp_replace(repo, '[^a-zA-Z0-9-]', '-', 'g'), '-') || '-' || substr(sha256(repo), 1, 8) END END"""
_FILE_DATED = f"""SELECT entry_id, CAST(CASE WHEN t IS NOT NULL THEN t ELSE greatest(floor(lo + (CASE WHEN hi <= lo THEN lo + n ELSE hi END - lo) / (n + 1)::DOUBLE * k), 0) END AS BIGINT) AS ts FROM (
  SELECT *, greatest(coalesce(lo0, hi - 60 * n), 0) AS lo FROM (
    SELECT *, count(*) OVER (PARTITION BY device, batch_no, file_name, g, t IS NULL) AS n, row_number() OVER (PARTITION BY device, batch_no, file_name, g, t IS NULL ORDER BY line_no) AS k FROM (
      SELECT *, last_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo0,
        coalesce(first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), {NOW}) AS hi, count(t) OVER (w ROWS UNBOUNDED PRECEDING) AS g
      FROM (SELECT *, CASE WHEN ts > 0 AND ts <= {NOW} THEN ts END AS t FROM import_entries) WINDOW w AS (PARTITION BY device, batch_no, file_name ORDER BY line_no))))"""
_CREDENTIAL = " OR ".join("regexp_matches(command, '{}')".format(p.replace("'", "''")) for p in redaction.CREDENTIALS)

_SHELL = ", ".join(f"'{v}'" for v in SHELL_VARIABLES)


def _vars_sql(col: str) -> str:
    found = f"regexp_extract_all(regexp_replace({col}, '\\$\\$[A-Z][A-Z0-9_]+', '', 'g'), '\\$([A-Z][A-Z0-9_]+)', 1)"
    return f"list_sort(list_distinct(list_filter({found}, lambda x: x NOT IN ({_SHELL}))))"


_STEPS = "(SELECT DISTINCT scope, group_name, description, step_no, cmd, comment, vars FROM runbook_steps)"
_DECLARED = f"""decl AS (SELECT scope, group_name, step_no, name, max_by(coalesce(v, chr(0)), pos) AS v FROM (
  SELECT scope, group_name, step_no, unnest({_vars_sql('cmd')}) AS name, NULL AS v, -1 AS pos FROM {_STEPS}
  UNION ALL SELECT scope, group_name, step_no, x.name, x.default_value, pos FROM (SELECT *, unnest(vars) AS x, generate_subscripts(vars, 1) AS pos FROM {_STEPS})) GROUP BY ALL)"""



def _redacted_sql(col: str) -> str:
    """The masking rules for an engine without look-ahead: what a rule must leave alone gets a mark in front of it
    first, and a rule takes nothing that begins with the mark."""
    word, quoted = redaction._WORD, r"\"[^\"]*\"|'[^']*'"
    name, qualified = rf"[A-Za-z0-9_.-]*{word}", rf"[A-Za-z0-9_.-]*[_.-]{word}"
    ref = r"[\"']*\$\$?\{?[A-Za-z_][A-Za-z0-9_]*\}?[\"']*(?:\s|$)"
    user = r"(?:\$\$?\{?[A-Za-z_][A-Za-z0-9_]*\}?(?:@|\s|$)|\d+(?:@|\s|$))"
    steps = [
        (r"-----BEGIN[^-]*PRIVATE KEY-----[\s\S]*?-----END[^-]*PRIVATE KEY-----", "[REDACTED]", "g"), (r"-----BEGIN[^-]*PRIVATE KEY-----[\s\S]*", "[REDACTED]", "g"),
        (rf"(authorization\s*:\s*(?:(?:bearer|basic|token)\s+)?)({ref})", "\\1\x02\\2", "gi"), (r"(authorization\s*:\s*)((?:bearer|basic|token)\s)", "\\1\x03\\2", "gi"),
        ("(authorization\\s*:\\s*\x03(?:bearer|basic|token)\\s+)([^\"'\\s\x02\x03][^\"'\\s]*)", "\\1[REDACTED]", "gi"), ("(authorization\\s*:\\s*)([^\"'\\s\x02\x03][^\"'\\s]*)", "\\1[REDACTED]", "gi"), ("[\x02\x03]", "", "g"),
        (r"\b((?:bearer|basic)\s+)([A-Za-z0-9._~+/=-]{8,})", "\\1[REDACTED]", "gi"),
        (rf"(://[^/\s:@]+:)({user})", "\\1\x02\\2", "g"), ("(://[^/\\s:@]+:)([^/\\s@\x02][^/\\s@]*)@", "\\1[REDACTED]@", "g"), ("\x02", "", "g"),
        (rf"((?:(?:^|\s)-u\s+|--user[= ])[^\s:]+:)({user})", "\\1\x02\\2", "gi"), ("((?:(?:^|\\s)-u\\s+|--user[= ])[^\\s:]+:)([^\\s\x02]\\S*)", "\\1[REDACTED]", "gi"), ("\x02", "", "g"),
        (rf"\b({name}\s*=\s*)({ref})", "\\1\x02\\2", "gi"), (rf"\b({name}\s*=\s*)({quoted}|[^\s" + "\x02" + r"]\S*)", "\\1[REDACTED]", "gi"), ("\x02", "", "g"),
        (rf"(--{name}\s+)({ref})", "\\1\x02\\2", "gi"), (rf"(--{name}\s+)({quoted}|[^-\s" + "\x02" + r"]\S*)", "\\1[REDACTED]", "gi"), ("\x02", "", "g"),
        (rf"(^|[^\w./$-])({qualified}\s+)((?:https?://|{ref}))", "\\1\\2\x02\\3", "gi"), (rf"(^|[^\w./$-])({qualified}\s+)({quoted}|[^-/~.\s" + "\x02" + r"]\S{7,})", "\\1\\2[REDACTED]", "gi"), ("\x02", "", "g"),
        (redaction.RULES[-2][0], "[REDACTED]", "g"), (redaction.RULES[-1][0], "[REDACTED]", "g"),
    ]
    out = col
    for pattern, put, flags in steps:
        out = "regexp_replace({}, '{}', '{}', '{}')".format(out, pattern.replace("'", "''"), put, flags)
    return f"CASE WHEN regexp_matches({col}, '{redaction.GATE}') THEN {out} ELSE {col} END"


ORACLE = {
    "command_variables": f"SELECT seq, array_to_string({_vars_sql('command')}, ',') AS names FROM history WHERE contains(command, '$')",
    "runbook_listing": f"""WITH v AS (SELECT scope, group_name, count(DISTINCT (step_no, cmd)) AS n_steps, list_sort(list_distinct(flatten(list({_vars_sql('cmd')})))) AS vs FROM runbook_steps GROUP BY scope, group_name)
SELECT scope, group_name, n_steps, array_to_string(vs, ',') AS variables, scope <> '_global' AND group_name IN (SELECT group_name FROM runbook_steps WHERE scope = '_global') AS shadows FROM v""",
    "runbook_variables": f"WITH {_DECLARED} SELECT scope, group_name, step_no, name, nullif(v, chr(0)) AS default_value FROM decl",
    "runbook_resolved": f"""WITH {_DECLARED} SELECT name, CASE name WHEN 'TAG' THEN '' WHEN 'API_TOKEN' THEN 'from-env' ELSE max(nullif(v, chr(0))) END AS value,
  CASE name WHEN 'TAG' THEN 'inline' WHEN 'API_TOKEN' THEN 'env' ELSE CASE WHEN max(nullif(v, chr(0))) IS NOT NULL THEN 'default' ELSE 'prompt' END END AS source FROM decl GROUP BY name""",
    "search_ranked": f"WITH {_PICKS} {_ranked_sql('git status')} UNION ALL {_ranked_sql('docker run')}",
    "search_expanded": _EXP,
    "search_newest": "SELECT command, max(ts) AS ts FROM history GROUP BY command ORDER BY ts DESC, command LIMIT 200",
    "session_log": _LOG.format(order="seq") + " SELECT id, summary, started_at, ended_at, repo, n_commands, commands FROM log",
    "session_search": _LOG.format(order="seq") + " SELECT id, started_at, n_commands FROM log WHERE contains(lower(commands), 'terraform apply') OR contains(lower(summary), 'terraform apply')",
    "live_sessions": _LOG.format(order="ts, seq") + " SELECT device, started_at, ended_at, repo, n_commands, summary FROM log QUALIFY k < max(k) OVER (PARTITION BY device)",
    "mining_sessions": f"""WITH h AS (SELECT *, {_REPO_KEY} AS repo_key, nullif(session, '') AS s FROM history), f AS (
  SELECT *, lag(ts) OVER w AS pts, lag(s) OVER w AS ps, lag(repo) OVER w AS prepo, row_number() OVER w AS rn FROM h WINDOW w AS (PARTITION BY repo_key ORDER BY seq)), g AS (
  SELECT *, CASE WHEN rn = 1 OR repo IS DISTINCT FROM prepo OR ts < pts OR CASE WHEN s IS NOT NULL AND ps IS NOT NULL THEN s <> ps ELSE greatest(ts - coalesce(duration_ms, 0) // 1000 - pts, 0) > 300 END THEN seq END AS o FROM f), r AS (
  SELECT *, max(o) OVER (PARTITION BY repo_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT repo_key, run, count(*) AS n_commands, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY repo_key, run""",
    "usage_stats": """SELECT 'total' AS kind, 'all' AS value, count(*) AS n_rows FROM history
UNION ALL (SELECT 'command', command, count(*) FROM history WHERE command IS NOT NULL GROUP BY command ORDER BY count(*) DESC, min(seq) LIMIT 10)
UNION ALL (SELECT 'repo', repo, count(*) FROM history WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, min(seq) LIMIT 5)""",
    "recent_failures": f"""WITH h AS (SELECT *, {_REPO_KEY} AS repo_key FROM history), f AS (
  SELECT *, lead(command, 1) OVER w AS n1, lead(command, 2) OVER w AS n2, min(CASE WHEN exit_code = 0 THEN seq END) OVER (PARTITION BY repo_key, command) AS good FROM h WINDOW w AS (PARTITION BY repo_key ORDER BY seq))
SELECT seq, command, repo, ts, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, exit_code, concat_ws(chr(10), n1, n2) AS followed_by, coalesce(good > seq, false) AS retried
FROM f WHERE exit_code <> 0 ORDER BY ts DESC, seq DESC LIMIT 50""",
    "tool_patterns": r"""WITH p AS (SELECT regexp_extract(command, '^\s*(\S+)', 1) AS tool, command AS pattern, count(*) AS frequency FROM history WHERE regexp_matches(command, '\S') GROUP BY ALL)
SELECT tool, pattern, pattern AS example, frequency FROM p QUALIFY sum(frequency) OVER (PARTITION BY tool) >= 5 AND row_number() OVER (PARTITION BY tool ORDER BY frequency DESC, pattern) <= 10""",
    "pattern_signatures": r"""WITH p AS (SELECT regexp_extract(command, '^\s*(\S+)', 1) AS tool, command, regexp_replace(command, '[0-9]+', '<n>', 'g') AS pattern, count(*) AS n, min(seq) AS first FROM history WHERE regexp_matches(command, '\S') GROUP BY ALL),
q AS (SELECT tool, regexp_replace(pattern, '<[^>]*>', '<>', 'g') AS signature, pattern, sum(n) AS n, min((first, command)) AS ex FROM p GROUP BY ALL)
SELECT tool, signature, max_by(pattern, (n, pattern)) AS pattern, min(ex)[2] AS example, CAST(sum(n) AS BIGINT) AS frequency FROM q GROUP BY tool, signature""",
    "pick_weights": f"WITH {_PICKS} SELECT command, weight FROM picks",
    "rotated": f"SELECT device, count(*) AS n_rows, min(ts) AS oldest FROM history WHERE coalesce(imported, false) OR ts IS NULL OR ts > {NOW} - 30 * 86400 GROUP BY device",
    "forgotten": "SELECT device, count(*) AS n_rows FROM history WHERE NOT (coalesce(contains(command, 'terraform'), false) OR coalesce(contains(dir, 'terraform'), false)) GROUP BY device",
    "forget_targets": """SELECT * FROM (
  SELECT 'history' AS store, count(*) AS n_rows FROM history WHERE contains(concat_ws(chr(0), device, command, dir, repo, session), 'deploy')
  UNION ALL SELECT 'import_entries', count(*) FROM import_entries WHERE contains(concat_ws(chr(0), device, shell, file_name, command), 'deploy')
  UNION ALL SELECT 'pick_events', count(*) FROM pick_events WHERE contains(command, 'deploy')
  UNION ALL SELECT 'runbook_steps', count(*) FROM runbook_steps WHERE contains(concat_ws(chr(0), scope, group_name, description, cmd, comment), 'deploy') OR contains(CAST(vars AS VARCHAR), 'deploy')
  UNION ALL SELECT 'agent_audit', count(*) FROM agent_audit WHERE contains(concat_ws(chr(0), tool, error), 'deploy') OR contains(CAST(arguments AS VARCHAR), 'deploy')) WHERE n_rows > 0""",
    "import_dated": _FILE_DATED,
    "import_plan": f"""WITH e AS (SELECT file_name, command, format('{{}}|{{:03d}}|{{}}', device, batch_no, file_name) AS source, line_no, ({_CREDENTIAL}) AS secret FROM import_entries), o AS (
  SELECT *, row_number() OVER (PARTITION BY command, secret ORDER BY source, line_no) AS nth FROM e), s AS (SELECT command, count(*) AS have FROM history GROUP BY command), v AS (
  SELECT file_name, CASE WHEN secret THEN 'credential' WHEN nth <= coalesce(have, 0) THEN 'duplicate' ELSE 'new' END AS verdict FROM o LEFT JOIN s USING (command))
SELECT file_name, count(*) FILTER (verdict = 'new') AS new, count(*) FILTER (verdict = 'duplicate') AS duplicate, count(*) FILTER (verdict = 'credential') AS credential FROM v GROUP BY ROLLUP (file_name)""",
    "redacted": f"SELECT seq, masked FROM (SELECT seq, command, {_redacted_sql('command')} AS masked FROM history) WHERE command <> masked",
    "credential_rows": f"SELECT seq FROM history WHERE {_CREDENTIAL}",
    "repo_keys": f"SELECT {_REPO_KEY} AS repo_key, count(*) AS n_rows, strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_at FROM history GROUP BY 1",
    "audit_counts": "SELECT tool, count(*) AS n_requests, count(*) FILTER (NOT ok) AS n_failed, CAST(sum(results) AS BIGINT) AS n_results FROM agent_audit GROUP BY tool",
    "runbook_markdown": """SELECT scope, group_name, '## ' || group_name || chr(10) || chr(10) || '| Command | Comment |' || chr(10) || '|---|---|' || chr(10) || string_agg('| `' || cmd || '` | ' || coalesce(comment, '') || ' |', chr(10) ORDER BY step_no, cmd, comment) || chr(10) AS doc
FROM (SELECT DISTINCT scope, group_name, description, step_no, cmd, comment, vars FROM runbook_steps) GROUP BY scope, group_name""",
}
