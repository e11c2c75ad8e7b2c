"""Queries of the sources, sinks and stores, and of single functions, over the command tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import detections, redaction, text
from runlore.operators import agent, failures, importer, patterns, promote, retention, runbooks, search, stats, work_sessions
from runlore.plans.engine import _DECLARED, _LOG, _PART, _PICKS, _REPO_KEY, _STEPS, NOW, ORACLE as ENGINE, REPO
from runlore.runtime import scratch, table
from runlore.sources import events, shell_history
from runlore.streaming import capture


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "history")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "runbook_steps").distinct()


# ---------------------------------------------------------------- sources and sinks
def search_table(spark: SparkSession, sf: str) -> DataFrame:
    """The written query table, searched through its lower-case column."""
    path = scratch(spark, "history-table")
    events.write_history(_history(spark, sf), path)
    return search.search(spark.read.parquet(path), "git status", NOW, REPO, 20)


def repo_history(spark: SparkSession, sf: str) -> DataFrame:
    """One repository out of the written table: only its folder is read."""
    path = scratch(spark, "history-table")
    events.write_history(_history(spark, sf), path)
    key = spark.range(1).select(text.repo_key(F.lit(REPO))).first()[0]
    return spark.read.parquet(path).where(F.col("repo_key") == key).select("seq", "command", "tool")


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """History as JSON lines by repository, and what is read back from them."""
    path = scratch(spark, "events")
    events.write_events(_history(spark, sf), path)
    back = events.read_events(spark, f"{path}/*/*")
    cols = ["command", "ts", "dir", "repo", "exit_code", "duration_ms", "session", "imported"]
    return back.groupBy(*cols).agg(F.count("*").alias("n_rows"))


def session_days(spark: SparkSession, sf: str) -> DataFrame:
    """The session log written by day, and read back from it: all days, and the rows of each."""
    path = scratch(spark, "sessions")
    events.write_sessions(work_sessions.session_log(_history(spark, sf)), path)
    return events.read_sessions(spark, path).groupBy("day").agg(F.count("*").alias("n_sessions"), F.sum("n_commands").alias("n_commands"))


def session_day(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "sessions")
    events.write_sessions(work_sessions.session_log(_history(spark, sf)), path)
    return events.read_sessions(spark, path, "2025-02-01").select("id", "started_at", "n_commands")


def shell_files(spark: SparkSession, sf: str) -> DataFrame:
    """Import entries as the shell history files they came from: path, content."""
    e = table(spark, sf, "import_entries").where("command is not null")
    dated, cmd = F.col("ts") > 0, F.col("command")
    zsh = F.concat(F.when(dated, F.concat(F.lit(": "), F.col("ts").cast("string"), F.lit(":0;"))).otherwise(""), F.replace(cmd, F.lit("\n"), F.lit("\\\n")))
    bash = F.concat(F.when(dated, F.concat(F.lit("#"), F.col("ts").cast("string"), F.lit("\n"))).otherwise(""), cmd)
    escaped = F.replace(F.replace(cmd, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    fish = F.concat(F.lit("- cmd: "), escaped, F.when(dated, F.concat(F.lit("\n  when: "), F.col("ts").cast("string"))).otherwise(""))
    record = F.when(F.col("shell") == "zsh", zsh).when(F.col("shell") == "bash", bash).otherwise(fish)
    files = e.groupBy(F.concat_ws("/", "device", F.col("batch_no").cast("string"), "file_name").alias("path"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "entry_id", record.alias("record"))))
    return files.agg(F.encode(F.array_join(F.transform(rows, lambda r: r["record"]), "\n"), "UTF-8").alias("content"))


def shell_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries that the parsers of zsh, bash and fish read out of history files."""
    return shell_history.parse_files(shell_files(spark, sf)).where("command is not null").select("file", "command", "ts")


def shell_failed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shell_history.failed_lines(shell_history.parse_files(shell_files(spark, sf)))


def events_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Which JSON lines are events: command, ts and dir there, whole numbers, no negative duration."""
    lines = table(spark, sf, "history_lines").where("fmt = 'jsonl'").select("line_id", F.col("raw").alias("value"))
    return events.parse_events(lines).groupBy("is_valid").agg(F.count("*").alias("n_lines"))


def owners(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines of one file split by the repository each belongs to, each line once."""
    lines = events.as_json(_history(spark, sf).select("command", "ts", "dir", "repo", "exit_code"))
    return retention.split_by_owner(lines, "old").groupBy("repo_key").agg(F.count("*").alias("n_lines"))


def imported_rows(spark: SparkSession, sf: str) -> DataFrame:
    """New entries as they would be appended to the history."""
    e = table(spark, sf, "import_entries").withColumn("source", F.format_string("%s|%03d|%s", "device", "batch_no", "file_name"))
    rows = importer.as_history(importer.plan(e, _history(spark, sf), "source", "line_no"))
    return rows.groupBy("command", "dir", "repo", "imported").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- retention
def rotated_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = events.as_json(_history(spark, sf).select("command", "ts", "imported")).unionAll(table(spark, sf, "history_lines").where("fmt = 'zsh'").select("raw"))
    return retention.rotate_lines(lines, NOW, 30).agg(F.count("*").alias("n_lines"))


def rotated_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return retention.rotate_sessions(work_sessions.session_log(_history(spark, sf)), NOW, 30).select("id", "started_at")


def forgotten_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    """One text erased from all stores at once: what is left of each."""
    names = ("history", "import_entries", "pick_events", "runbook_steps", "agent_audit")
    left = retention.forget_all({n: table(spark, sf, n) for n in names} | {"sessions": work_sessions.session_log(_history(spark, sf))}, "deploy")
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("store"), "n_rows") for n, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def forgotten_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = retention.forget_in_sessions(work_sessions.session_log(_history(spark, sf)), "git")
    return s.select("id", F.size("commands").cast("long").alias("n_left"), (F.col("summary") == "").alias("blanked"))


# ---------------------------------------------------------------- runbooks, variables, patterns, picks, audit
def runbook_json(spark: SparkSession, sf: str) -> DataFrame:
    """Runbooks as JSON documents by name, read back."""
    doc = F.concat(F.lit('{"'), F.col("group_name"), F.lit('":'), F.col("doc"), F.lit("}"))
    return runbooks.import_json(runbooks.export_json(_steps(spark, sf)).select(doc.alias("value"))).select("group_name", "description", "step_no", "cmd", "comment")


def runbook_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Runbooks as Markdown tables, read back."""
    return runbooks.import_markdown(runbooks.export_markdown(_steps(spark, sf)).select(F.col("doc").alias("value")))


def runbook_found(spark: SparkSession, sf: str) -> DataFrame:
    """A group by name, as a repository sees it."""
    both = runbooks.copy(_steps(spark, sf), "switch-debug-2", runbooks.GLOBAL, REPO).withColumn("cmd", F.when(F.col("scope") == REPO, F.concat(F.lit("own "), "cmd")).otherwise(F.col("cmd")))
    return runbooks.lookup(both, "switch-debug-2", REPO).select("scope", "step_no", "cmd")


def runbook_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Rename, removal, copying and merging of groups in one go: groups and sizes afterwards."""
    s = runbooks.rename(_steps(spark, sf), runbooks.GLOBAL, "switch-debug-2", "switch-check")
    s = runbooks.remove(s, REPO, "folder-deploy")
    s = runbooks.copy(s, "widget-deploy", runbooks.GLOBAL, REPO)
    new = s.where(F.col("scope") == runbooks.GLOBAL).withColumn("scope", F.lit(REPO)).withColumn("cmd", F.upper("cmd"))
    merged = runbooks.merge_steps(s, new.where("group_name = 'widget-deploy'"))
    return merged.groupBy("scope", "group_name").agg(F.count("*").alias("n_steps"), F.max("step_no").alias("last_step"))


def runbook_replaced(spark: SparkSession, sf: str) -> DataFrame:
    s = _steps(spark, sf)
    new = s.where("step_no = 1").withColumn("cmd", F.upper("cmd"))
    return runbooks.merge_steps(s, new, replace=True).select("scope", "group_name", "step_no", "cmd")


def last_captured(spark: SparkSession, sf: str) -> DataFrame:
    return runbooks.last_captured(_history(spark, sf), REPO)


def variable_status(spark: SparkSession, sf: str) -> DataFrame:
    """Where each parameter's value would come from, given a variable store that was changed twice."""
    names = runbooks.declarations(_steps(spark, sf))
    first = names.groupBy("name").agg(F.max("default_value").alias("value")).where("value is not null")
    store = runbooks.put_variables(runbooks.put_variables(spark.createDataFrame([], "scope string, name string, value string"), first.select(F.lit(runbooks.GLOBAL).alias("scope"), "name", "value")), first.select(F.lit(REPO).alias("scope"), "name", F.upper("value").alias("value")))
    return runbooks.variable_status(names, runbooks.drop_variables(store, first.where("name < 'M'").select(F.lit(runbooks.GLOBAL).alias("scope"), "name")))


def pattern_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A stored pattern table brought up to date: of each tool the new rows take the place of the old ones."""
    p = patterns.tool_patterns(_history(spark, sf))
    old = p.withColumn("frequency", -F.col("frequency")).unionByName(spark.createDataFrame([("gone", "gone x", "gone x", 1)], p.schema))
    return patterns.merge_documents(old, p.where("tool >= 'g'"))


def pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.pattern_search(patterns.tool_patterns(_history(spark, sf)), "git push", 10)


def to_generalise(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    known = h.where("command like 'git %'").select(text.tool(F.col("command")).alias("tool"), "command").distinct()
    return patterns.next_to_generalise(h, known, 50)


def _guesses(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf).where("command is not null").select("command").distinct()
    name = F.when(F.length("command") % 3 == 0, "<value>").when(F.length("command") % 3 == 1, "<n> | tee").otherwise("<n>")
    return h.withColumn("pattern", F.concat(F.regexp_replace("command", F.lit("[0-9]+"), name), F.lit(" and more words")))


def corrupt_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _guesses(spark, sf).groupBy(patterns.corrupt_pattern().alias("corrupt")).agg(F.count("*").alias("n_patterns"))


def trimmed_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _guesses(spark, sf).select("command", patterns.trim_invented().alias("pattern"))


def streamed_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Selections folded into the stored picks by a streaming query."""
    src = f"{sf}/pick_events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src[:-1] + "[t]")
    out = scratch(spark, "picks")
    capture.keep_picks(stream, out, lambda: NOW, f"{out}-state").awaitTermination()
    return spark.read.parquet(f"{out}/v0").select("command", "count", "ts")


def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Commands and failures per five minutes of event time."""
    w = capture.windowed_counts(_history(spark, sf))
    return w.select(F.unix_timestamp("window.start").alias("start"), "n", "failed")


def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    return stats.audit_tail(table(spark, sf, "agent_audit"), 20).select("ts", "tool", "results", "ok", "error")


def agent_runbooks(spark: SparkSession, sf: str) -> DataFrame:
    """The runbooks as the agent service lists them, with the audit row of the call."""
    kept: list[dict] = []
    service = agent.Service(_history(spark, sf), _steps(spark, sf), REPO, True, audit=kept.append, now=lambda: NOW)
    rows = service.call("list_runbooks", {})
    out = [(r["scope"], r["group_name"], r["n_steps"], kept[0]["results"]) for r in rows]
    return spark.createDataFrame(out, "scope string, group_name string, n_steps long, audited long")


# ---------------------------------------------------------------- functions over commands
def inspections(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).where(text.is_inspection(F.col("command"))).select("seq")


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The shape of every distinct command; places that may vary as <>."""
    s = F.transform(text.shape(F.col("command")), lambda e: F.translate(e, text.HOLE + text.OPAQUE, "¤!"))
    return _history(spark, sf).select("command").distinct().select("command", F.array_join(s, " ").alias("shape"))


def step_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of 2 to 8 steps that recur in three sessions or more of a repository."""
    s = promote.sequences(_history(spark, sf))
    flat = F.array_join(F.transform("shapes", lambda x: F.translate(F.array_join(x, " "), text.HOLE + text.OPAQUE, "¤!")), "\n")
    return s.groupBy(text.repo_key(F.when(F.col("repo_id") != "", F.col("repo_id"))).alias("repo_key"), flat.alias("steps")).agg(F.count("*").alias("n_sessions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def step_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Recurring sequences in which at most two things vary, with how many do."""
    c = promote.candidates(_history(spark, sf))
    key = text.repo_key(F.when(F.col("repo_id") != "", F.col("repo_id")))
    return c.select(key.alias("repo_key"), F.size("steps").cast("long").alias("n_steps"), "occurrences", F.size("variables").cast("long").alias("n_variables"), "first_seen", "last_seen")


def correction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return failures.correction_pairs(_history(spark, sf)).select("seq", F.col("place").cast("long").alias("place"), "fix")


def latest_failure(spark: SparkSession, sf: str) -> DataFrame:
    return failures.latest_failure(_history(spark, sf), "git", REPO).select("seq", F.col("failed"))


def may_hold_credential(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).where(detections.may_hold_credential(F.col("command"))).select("seq")


def sensitive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose command matches a shape that imports leave out, or whose bearer and vendor tokens are masked."""
    return _history(spark, sf).where(redaction.looks_like_credential(F.col("command")) & redaction.is_sensitive(F.col("command"))).select("seq")


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    w = _history(spark, sf).select(F.explode(text.words(F.col("command"))).alias("word"))
    return w.where(detections.is_host(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def variable_names(spark: SparkSession, sf: str) -> DataFrame:
    """UPPER_SNAKE forms of the tools' and folders' names."""
    h = _history(spark, sf).select(F.explode(F.split("dir", "/")).alias("name")).distinct()
    return h.select("name", text.variable_name(F.col("name")).alias("variable"))


def unescaped(spark: SparkSession, sf: str) -> DataFrame:
    doubled = F.regexp_replace("cmd", r"\$([A-Z])", r"\$\$$1")
    return _steps(spark, sf).select("scope", "group_name", "step_no", text.unescape_variables(doubled).alias("cmd"))


def ages(spark: SparkSession, sf: str) -> DataFrame:
    """How long ago commands ran, in words."""
    return _history(spark, sf).groupBy(text.relative_time(F.col("ts"), NOW).alias("age")).agg(F.count("*").alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        search_table, repo_history, jsonl_round_trip, session_days, session_day, shell_entries, shell_failed_lines, events_valid, owners, imported_rows, rotated_lines, rotated_sessions, forgotten_everywhere,
        forgotten_sessions, runbook_json, runbook_tables, runbook_found, runbook_edits, runbook_replaced, last_captured, variable_status, pattern_documents, pattern_hits, to_generalise, corrupt_patterns, trimmed_patterns,
        streamed_picks, windowed_counts, audit_tail, agent_runbooks, inspections, shapes, step_sequences, step_candidates, correction_pairs, latest_failure, may_hold_credential, sensitive_rows, hosts, variable_names, unescaped, ages,
    )
}

# ---------------------------------------------------------------- SQL
_T = text.TOKEN.replace("'", "''")
_LOOKS = ", ".join(f"'{x}'" for x in text.LOOKERS)
_PAIRS = ", ".join(f"'{x}'" for x in text.LOOKING_PAIRS)
_GRAMMAR = r"[|><;`&]|\$\("
#: t: tokens, b: without leading sudo or doas.
_TOKENS = f"""(SELECT *, CASE WHEN p > 0 THEN t[p:] ELSE [] END AS b FROM (SELECT *, list_position(list_transform(t, lambda x: x NOT IN ('sudo', 'doas')), true) AS p FROM (
  SELECT *, regexp_extract_all(command, '{_T}') AS t FROM {{}})))"""
_LOOKING = f"(NOT regexp_matches(command, '{_GRAMMAR}') AND (len(b) = 0 OR b[1] IN ({_LOOKS}) OR (len(b) > 1 AND b[1] || ' ' || b[2] IN ({_PAIRS}))))"
_SHAPE = f"""CASE WHEN regexp_matches(command, '{_GRAMMAR}') THEN ['!' || command] ELSE list_transform(t, lambda x, i: CASE WHEN i - 1 < len(t) - len(b) + 2 THEN x
  WHEN length(x) > 1 AND starts_with(x, '-') THEN CASE WHEN contains(x, '=') THEN split_part(x, '=', 1) || '=¤' ELSE x END ELSE '¤' END) END"""
_MINED = ENGINE["mining_sessions"].rsplit("\nSELECT", 1)[0]
_FIRST = ENGINE["tool_patterns"]
_GUESSES = r"""g AS (SELECT command, regexp_replace(command, '[0-9]+', CASE length(command) % 3 WHEN 0 THEN '<value>' WHEN 1 THEN '<n> | tee' ELSE '<n>' END, 'g') || ' and more words' AS pattern FROM (SELECT DISTINCT command FROM history WHERE command IS NOT NULL))"""
_GRAMS = " UNION ALL ".join(
    f"SELECT repo_key, run, ts_{n} AS ts, array_to_string(l_{n}, chr(10)) AS steps FROM w WHERE len(l_{n}) = {n}" for n in range(2, 9)
)
_WINDOWS = ", ".join(
    f"list(shape) OVER (PARTITION BY repo_key, run, part ORDER BY seq ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS l_{n}, lead(ts, {n - 1}) OVER (PARTITION BY repo_key, run, part ORDER BY seq) AS ts_{n}" for n in range(2, 9)
)
_LISTS = ", ".join(
    f"list(struct_pack(s := sh, c := command, q := seq)) OVER (PARTITION BY repo_key, run, part ORDER BY seq ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS l_{n}, lead(ts, {n - 1}) OVER (PARTITION BY repo_key, run, part ORDER BY seq) AS ts_{n}" for n in range(2, 9)
)
_LISTED = " UNION ALL ".join(f"SELECT repo_key, run, ts_{n} AS ts, [x.s FOR x IN l_{n}] AS shapes, [x.c FOR x IN l_{n}] AS cmds, [x.q FOR x IN l_{n}] AS seqs FROM w WHERE len(l_{n}) = {n}" for n in range(2, 9))
_NEXT = ", ".join(f"lead(s, {n}) OVER (PARTITION BY rid ORDER BY seq) AS n{n}" for n in (1, 2, 3))
_FLAGS = ", ".join(
    f"n{n}.ts >= ts AND n{n}.ts - n{n}.d - ts > 60 AS late{n}, coalesce(n{n}.ts >= ts AND NOT (n{n}.ts - n{n}.d - ts > 60) AND CASE WHEN ses IS NOT NULL AND n{n}.ses IS NOT NULL THEN ses = n{n}.ses ELSE dir IS NOT DISTINCT FROM n{n}.dir END AND n{n}.exit_code = 0, false) AS open{n}" for n in (1, 2, 3)
)
_ENDS = " ".join(f"WHEN coalesce(late{n}, false) OR (open{n} AND n{n}.command = command) THEN {n}" for n in (1, 2, 3))
_FIX = " UNION ALL ".join(f"SELECT seq, {n} AS n, command, exit_code, n{n}.command AS fix FROM e WHERE open{n} AND {n} < ends" for n in (1, 2, 3))
_HEAD = r"str_split_regex(regexp_replace(trim({}), '^((sudo|doas)\s+)+', ''), '\s+')[1]"

ORACLE = {
    "search_table": f"""SELECT command, ts, repo, n AS frequency, round(0.21e0 * least(1e0, ln(1 + n) / ln(51)) + part + 0.09e0 * CAST(starts_with(lower(command), 'git status') AS DOUBLE), 6) AS score
  FROM (SELECT command, ts, repo, seq, {_PART} AS part, count(*) OVER (PARTITION BY command) AS n FROM history WHERE contains(lower(command), 'git') AND contains(lower(command), 'status')
        QUALIFY row_number() OVER (PARTITION BY command ORDER BY part DESC, ts DESC, seq) = 1) ORDER BY score DESC, ts DESC, command LIMIT 20""",
    "repo_history": f"SELECT seq, command, regexp_extract(command, '^\\s*(\\S+)', 1) AS tool FROM history WHERE repo = '{REPO}'",
    "jsonl_round_trip": "SELECT command, ts, dir, repo, exit_code, duration_ms, session, coalesce(imported, false) AS imported, count(*) AS n_rows FROM history WHERE regexp_matches(command, '[^ ]') AND ts IS NOT NULL AND dir IS NOT NULL GROUP BY ALL",
    "session_days": _LOG.format(order="seq") + " SELECT CAST(make_timestamp(started_at * 1000000) AS DATE) AS day, count(*) AS n_sessions, CAST(sum(n_commands) AS BIGINT) AS n_commands FROM log GROUP BY 1",
    "session_day": _LOG.format(order="seq") + " SELECT id, started_at, n_commands FROM log WHERE CAST(make_timestamp(started_at * 1000000) AS DATE) = '2025-02-01'",
    "shell_entries": """WITH e AS (SELECT device || '/' || batch_no || '/' || file_name AS file, shell, command, nullif(ts, 0) AS ts FROM import_entries WHERE command IS NOT NULL), b AS (
  SELECT file, ts, str_split(command, chr(10)) AS ls FROM e WHERE shell = 'bash')
SELECT file, regexp_replace(command, '\\r$', '') AS command, ts FROM e WHERE shell = 'zsh' UNION ALL SELECT file, regexp_replace(command, '^[ \t\r]+|[ \t\r]+$', '', 'g'), ts FROM e WHERE shell = 'fish'
UNION ALL SELECT file, regexp_replace(l, '\\r$', ''), ts FROM (SELECT file, unnest(ls) AS l, CASE WHEN generate_subscripts(ls, 1) = 1 THEN ts END AS ts FROM b) WHERE regexp_matches(l, '\\S')""",
    "shell_failed_lines": """SELECT device || '/' || batch_no || '/' || file_name AS file, sum(CASE WHEN shell = 'bash' THEN len(list_filter(str_split(command, chr(10)), lambda l: regexp_matches(l, '\\S'))) ELSE 1 END)::BIGINT AS n_entries, 0 AS failed_lines
FROM import_entries WHERE command IS NOT NULL GROUP BY 1""",
    "events_valid": r"""WITH j AS (SELECT CASE WHEN json_valid(raw) AND NOT regexp_matches(raw, ',\s*\}\s*$') THEN raw END AS j FROM history_lines WHERE fmt = 'jsonl' AND trim(raw) <> ''), v AS (
  SELECT coalesce(json_type(j) = 'OBJECT' AND json_extract_string(j, '$.command') IS NOT NULL AND json_extract_string(j, '$.dir') IS NOT NULL AND try_cast(json_extract_string(j, '$.ts') AS DECIMAL(30,6)) = floor(try_cast(json_extract_string(j, '$.ts') AS DECIMAL(30,6)))
    AND (json_extract_string(j, '$.exit_code') IS NULL OR try_cast(json_extract_string(j, '$.exit_code') AS DECIMAL(30,6)) = floor(try_cast(json_extract_string(j, '$.exit_code') AS DECIMAL(30,6))))
    AND (json_extract_string(j, '$.duration_ms') IS NULL OR (try_cast(json_extract_string(j, '$.duration_ms') AS DECIMAL(30,6)) = floor(try_cast(json_extract_string(j, '$.duration_ms') AS DECIMAL(30,6))) AND try_cast(json_extract_string(j, '$.duration_ms') AS DECIMAL(30,6)) >= 0)), false) AS is_valid FROM j)
SELECT is_valid, count(*) AS n_lines FROM v GROUP BY is_valid""",
    "owners": f"SELECT CASE WHEN repo IS NULL THEN 'old' ELSE {_REPO_KEY} END AS repo_key, count(DISTINCT (command, ts, dir, repo, exit_code)) AS n_lines FROM history GROUP BY 1",
    "imported_rows": ENGINE["import_plan"].replace("SELECT file_name, command, format", "SELECT file_name, command, format").split(", v AS (")[0]
    + " SELECT command, '' AS dir, CAST(NULL AS VARCHAR) AS repo, true AS imported, count(*) AS n_rows FROM o LEFT JOIN s USING (command) WHERE NOT secret AND nth > coalesce(have, 0) GROUP BY command",
    "rotated_lines": f"SELECT (SELECT count(*) FROM history WHERE coalesce(imported, false) OR ts IS NULL OR ts > {NOW} - 30 * 86400) + (SELECT count(*) FROM history_lines WHERE fmt = 'zsh') AS n_lines",
    "rotated_sessions": _LOG.format(order="seq") + f" SELECT id, started_at FROM log WHERE CAST(make_timestamp(started_at * 1000000) AS DATE) >= CAST(make_timestamp(({NOW}::BIGINT - 30 * 86400) * 1000000) AS DATE)",
    "forgotten_everywhere": _LOG.format(order="seq") + """ SELECT 'history' AS store, count(*) AS n_rows FROM history WHERE NOT contains(concat_ws(chr(0), device, command, dir, repo, session), 'deploy')
  UNION ALL SELECT 'import_entries', count(*) FROM import_entries WHERE NOT contains(concat_ws(chr(0), device, shell, file_name, command), 'deploy')
  UNION ALL SELECT 'pick_events', count(*) FROM pick_events WHERE NOT contains(command, 'deploy')
  UNION ALL SELECT 'runbook_steps', count(*) FROM runbook_steps WHERE NOT (contains(concat_ws(chr(0), scope, group_name, description, cmd, comment), 'deploy') OR coalesce(contains(CAST(vars AS VARCHAR), 'deploy'), false))
  UNION ALL SELECT 'agent_audit', count(*) FROM agent_audit WHERE NOT (contains(concat_ws(chr(0), tool, error), 'deploy') OR coalesce(contains(CAST(arguments AS VARCHAR), 'deploy'), false))
  UNION ALL SELECT 'sessions', count(DISTINCT r.run_id) FROM (SELECT device || ':' || k AS run_id, command FROM r) r WHERE NOT contains(command, 'deploy')""",
    "forgotten_sessions": _LOG.format(order="seq") + """ SELECT l.id, n AS n_left, contains(l.summary, 'git') AS blanked FROM log l JOIN (SELECT device, k, count(*) AS n FROM r WHERE NOT contains(command, 'git') GROUP BY device, k) USING (device, k)""",
    "runbook_json": f"SELECT group_name, max(description) OVER (PARTITION BY scope, group_name) AS description, CAST(row_number() OVER (PARTITION BY scope, group_name ORDER BY step_no, cmd, comment NULLS FIRST) AS INT) AS step_no, cmd, comment FROM (SELECT scope, group_name, description, step_no, cmd, comment FROM {_STEPS})",
    "runbook_tables": f"SELECT group_name, CAST(row_number() OVER (PARTITION BY scope, group_name ORDER BY step_no, '| `' || cmd || '` | ' || coalesce(comment, '') || ' |') AS INT) AS step_no, cmd, nullif(comment, '') AS comment FROM {_STEPS}",
    "runbook_found": f"SELECT '{REPO}' AS scope, step_no, 'own ' || cmd AS cmd FROM {_STEPS} WHERE scope = '_global' AND group_name = 'switch-debug-2'",
    "runbook_edits": f"""WITH s AS (SELECT scope, CASE WHEN scope = '_global' AND group_name = 'switch-debug-2' THEN 'switch-check' ELSE group_name END AS group_name, step_no, cmd FROM {_STEPS}), t AS (
  SELECT * FROM s WHERE NOT (scope = '{REPO}' AND group_name IN ('folder-deploy', 'widget-deploy')) UNION ALL SELECT '{REPO}', group_name, step_no, cmd FROM s WHERE scope = '_global' AND group_name = 'widget-deploy'), u AS (
  SELECT * FROM t UNION ALL SELECT '{REPO}', group_name, step_no + (SELECT coalesce(max(step_no), 0) FROM t x WHERE x.scope = '{REPO}' AND x.group_name = 'widget-deploy'), upper(cmd) FROM t WHERE scope = '_global' AND group_name = 'widget-deploy'
  AND upper(cmd) NOT IN (SELECT cmd FROM t x WHERE x.scope = '{REPO}' AND x.group_name = 'widget-deploy'))
SELECT scope, group_name, count(*) AS n_steps, max(step_no) AS last_step FROM u GROUP BY scope, group_name""",
    "runbook_replaced": f"WITH s AS (SELECT * FROM {_STEPS}) SELECT scope, group_name, step_no, cmd FROM s WHERE (scope, group_name) NOT IN (SELECT (scope, group_name) FROM s WHERE step_no = 1) UNION ALL SELECT scope, group_name, step_no, upper(cmd) FROM s WHERE step_no = 1",
    "last_captured": f"SELECT max_by(command, seq) AS command FROM history WHERE repo = '{REPO}' AND trim(command) <> ''",
    "variable_status": f"""WITH {_DECLARED}, d AS (SELECT DISTINCT scope, name, max(nullif(v, chr(0))) OVER (PARTITION BY scope, name) AS dv FROM decl), f AS (SELECT name, max(nullif(v, chr(0))) AS value FROM decl GROUP BY name HAVING value IS NOT NULL)
SELECT d.scope, d.name, CASE WHEN d.scope = '{REPO}' AND f.name IS NOT NULL THEN 'own' WHEN f.name IS NOT NULL AND d.name >= 'M' THEN 'global' WHEN dv IS NOT NULL THEN 'default' ELSE 'prompt' END AS status FROM d LEFT JOIN f USING (name)""",
    "pattern_documents": f"WITH n AS ({_FIRST}) SELECT tool, pattern, example, CASE WHEN tool >= 'g' THEN frequency ELSE -frequency END AS frequency FROM n UNION ALL SELECT 'gone', 'gone x', 'gone x', 1",
    "pattern_hits": f"WITH n AS ({_FIRST}) SELECT * FROM n WHERE contains(lower(pattern), 'git') AND contains(lower(pattern), 'push') ORDER BY frequency DESC, pattern LIMIT 10",
    "to_generalise": r"""WITH p AS (SELECT regexp_extract(command, '^\s*(\S+)', 1) AS tool, command, count(*) AS n FROM history WHERE regexp_matches(command, '\S') GROUP BY ALL), v AS (SELECT tool, sum(n) AS volume FROM p GROUP BY tool HAVING volume >= 5)
SELECT tool, command, n FROM p JOIN v USING (tool) WHERE NOT starts_with(command, 'git ') ORDER BY volume DESC, tool, n DESC, command LIMIT 50""",
    "corrupt_patterns": rf"""WITH {_GUESSES}, m AS (SELECT pattern, command, list_filter(regexp_extract_all(regexp_replace(pattern, '<[^>]*>', '', 'g'), '[;|&<>$`\n]'), lambda c: NOT contains(command, c)) AS bad FROM g)
SELECT list_contains(regexp_extract_all(pattern, '<([^>]*)>', 1), 'value') OR len(bad) > 0 AS corrupt, count(*) AS n_patterns FROM m GROUP BY 1""",
    "trimmed_patterns": f"WITH {_GUESSES} SELECT command, array_to_string(str_split(pattern, ' ')[:len(str_split(command, ' '))], ' ') AS pattern FROM g",
    "streamed_picks": f"WITH {_PICKS} SELECT command, weight AS count, {NOW} AS ts FROM picks",
    "windowed_counts": "SELECT ts // 300 * 300 AS start, count(*) AS n, count(*) FILTER (exit_code <> 0) AS failed FROM history WHERE ts IS NOT NULL GROUP BY 1",
    "audit_tail": "SELECT ts, tool, results, ok, error FROM agent_audit ORDER BY ts DESC, tool DESC, results DESC LIMIT 20",
    "agent_runbooks": f"SELECT scope, group_name, count(DISTINCT (step_no, cmd)) AS n_steps, count(*) OVER () AS audited FROM {_STEPS} GROUP BY scope, group_name",
    "inspections": f"SELECT seq FROM {_TOKENS.format('history')} WHERE {_LOOKING}",
    "shapes": f"SELECT command, array_to_string({_SHAPE}, ' ') AS shape FROM {_TOKENS.format('(SELECT DISTINCT command FROM history WHERE command IS NOT NULL)')}",
    "step_sequences": f"""{_MINED}, st AS (SELECT repo_key, run, seq, ts, coalesce(duration_ms, 0) // 1000 AS d, array_to_string({_SHAPE}, ' ') AS shape FROM {_TOKENS.format('r')} WHERE coalesce(exit_code = 0, true) AND trim(command) <> '' AND NOT {_LOOKING}), o AS (
  SELECT *, CASE WHEN lag(ts) OVER v IS NULL OR greatest(ts - d - lag(ts) OVER v, 0) > 900 THEN seq END AS op FROM st WINDOW v AS (PARTITION BY repo_key, run ORDER BY seq)), pt AS (
  SELECT *, max(op) OVER (PARTITION BY repo_key, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM o), w AS (SELECT repo_key, run, {_WINDOWS} FROM pt), gr AS ({_GRAMS}), l AS (SELECT repo_key, steps, run, max(ts) AS ts FROM gr GROUP BY ALL)
SELECT repo_key, steps, count(*) AS n_sessions, min(ts) AS first_seen, max(ts) AS last_seen FROM l GROUP BY repo_key, steps HAVING count(*) >= 3""",
    "step_candidates": f"""{_MINED}, st AS (SELECT repo_key, run, seq, ts, command, coalesce(duration_ms, 0) // 1000 AS d, {_SHAPE} AS sh FROM {_TOKENS.format('r')} WHERE coalesce(exit_code = 0, true) AND trim(command) <> '' AND NOT {_LOOKING}), o AS (
  SELECT *, CASE WHEN lag(ts) OVER v IS NULL OR greatest(ts - d - lag(ts) OVER v, 0) > 900 THEN seq END AS op FROM st WINDOW v AS (PARTITION BY repo_key, run ORDER BY seq)), pt AS (
  SELECT *, max(op) OVER (PARTITION BY repo_key, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM o), w AS (SELECT repo_key, run, {_LISTS} FROM pt), gr AS ({_LISTED}), l AS (
  SELECT repo_key, shapes, run, max_by(cmds, (ts, seqs)) AS cmds, max(ts) AS ts FROM gr GROUP BY ALL), n AS (SELECT repo_key, shapes, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM l GROUP BY ALL HAVING count(*) >= 3), k AS (
  SELECT repo_key, shapes, run, cmds, unnest(range(1, len(cmds) + 1)) AS i FROM l JOIN n USING (repo_key, shapes)), y AS (
  SELECT repo_key, shapes, run, i, shapes[i] AS e, regexp_extract_all(cmds[i], '{_T}') AS t FROM k), z AS (SELECT *, unnest(range(1, len(e) + 1)) AS j FROM y), v AS (
  SELECT repo_key, shapes, i, j, list(CASE WHEN e[j] = '¤' THEN t[j] ELSE substr(t[j], length(e[j])) END ORDER BY run) AS vec FROM z WHERE suffix(e[j], '¤') GROUP BY ALL), p AS (
  SELECT repo_key, shapes, count(DISTINCT vec) AS n_variables FROM v WHERE len(list_distinct(vec)) > 1 GROUP BY ALL)
SELECT repo_key, len(shapes) AS n_steps, occurrences, coalesce(n_variables, 0) AS n_variables, first_seen, last_seen FROM n LEFT JOIN p USING (repo_key, shapes) WHERE coalesce(n_variables, 0) <= 2""",
    "correction_pairs": f"""WITH h AS (SELECT coalesce(repo, '') AS rid, seq, command, ts, dir, exit_code, nullif(session, '') AS ses, struct_pack(command := command, ts := ts, dir := dir, exit_code := exit_code, d := coalesce(duration_ms, 0) // 1000, ses := nullif(session, '')) AS s FROM history WHERE command IS NOT NULL), a AS (
  SELECT *, {_NEXT} FROM h), b AS (SELECT *, {_FLAGS} FROM a WHERE exit_code <> 0), e AS (SELECT *, CASE {_ENDS} ELSE 4 END AS ends FROM b), f AS ({_FIX})
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY n) - 1 AS place, fix FROM f WHERE coalesce({_HEAD.format('command')} = {_HEAD.format('fix')} OR exit_code = 127 OR regexp_matches(command || fix, '["''\\\\]'), false)""",
    "latest_failure": f"SELECT seq, command AS failed FROM history WHERE exit_code <> 0 AND contains(lower(command), 'git') ORDER BY coalesce(repo = '{REPO}', false) DESC, ts DESC, seq DESC LIMIT 1",
    "may_hold_credential": f"""SELECT seq FROM history WHERE {' OR '.join(f"contains(lower(command), '{k}')" for k in detections.KEYWORDS)} OR len(list_filter(str_split_regex(command, '\\s+'), lambda w: length(regexp_replace(w, '["'']', '', 'g')) >= {detections.LONG_WORD})) > 0""",
    "sensitive_rows": "SELECT seq FROM history WHERE " + " OR ".join("regexp_matches(command, '{}')".format(p.replace("'", "''")) for p in redaction.CREDENTIALS),
    "hosts": r"""SELECT word, count(*) AS n FROM (SELECT unnest(str_split_regex(command, '\s+')) AS word FROM history) WHERE regexp_full_match(word, '(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?::[0-9]+)?') GROUP BY word""",
    "variable_names": r"SELECT name, upper(trim(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_')) AS variable FROM (SELECT DISTINCT unnest(str_split(dir, '/')) AS name FROM history)",
    "unescaped": f"SELECT scope, group_name, step_no, regexp_replace(regexp_replace(cmd, '\\$([A-Z])', '$$\\1', 'g'), '\\$\\$([A-Z][A-Z0-9_]+)', '$\\1', 'g') AS cmd FROM {_STEPS}",
    "ages": f"""WITH a AS (SELECT greatest({NOW} - ts, 0) AS a FROM history) SELECT CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN a // 60 || 'm ago' WHEN a < 86400 THEN a // 3600 || 'h ago' ELSE a // 86400 || 'd ago' END AS age, count(*) AS n_rows FROM a GROUP BY 1""",
}
