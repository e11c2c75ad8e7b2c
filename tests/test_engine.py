"""The engine's operators on small hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runlore import blocks
from runlore.functions import text
from runlore.functions.correction import corrects, slip
from runlore.functions.redaction import redact
from runlore.operators import agent, failures, importer, patterns, picks, promote, retention, runbooks, search, work_sessions
from runlore.sources import concepts, events, shell_history

H = "seq long, device string, command string, ts long, dir string, repo string, exit_code int, duration_ms long, session string, imported boolean"


def history(spark, rows):
    """Rows of (command, ts, exit_code) and, if given, repo."""
    full = [(i, "d", r[0], r[1], "/w", r[3] if len(r) > 3 else "/w/a", r[2], None, None, False) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, H)


@pytest.mark.parametrize(
    "failed,fix,code,want",
    [
        ("docker ps", "docker ps -a", 1, True), ("git psuh", "git push", 1, True), ("apt install x", "sudo apt install x", 1, True), ("gti status", "git status", 127, True), ("gti status", "git status", 1, False),
        ("ls /nope", "ls", 2, False), ("npm ci --frozen-lockfile", "npm ci", 1, True), ("pytest test_a.py", "pytest test_b.py", 1, False), ("npm run buld", "npm run build --if-present", 1, True),
        ("git push", "git pull", 1, False), ('echo "a', "echo a", 1, True), ("make test", "make test", 1, False), ("", "x", 1, False),
    ],
)
def test_corrections_table(failed, fix, code, want):
    assert corrects(failed, fix, code) is want


def test_correction_mining(spark):
    rows = [("git psuh", 100, 1), ("ls", 110, 0), ("git push", 120, 0), ("git psuh", 500, 1), ("git push", 600, 0), ("git psuh", 1000, 1), ("git push", 1010, 0), ("git push", 2000, 1), ("make x", 3000, 2), ("make x", 3001, 0), ("make x -j", 3002, 0)]
    got = failures.corrections(history(spark, rows)).collect()
    assert [(r.failed, r.fix, r.occurrences, r.first_seen, r.last_seen, r.fix_failures, r.confidence) for r in got] == [("git psuh", "git push", 2, 100, 1000, 1, "moderate")]
    assert failures.fixes_for(history(spark, rows), "psuh").count() == 1
    f = failures.recent_failures(history(spark, rows), 99).collect()
    assert [(r.command, r.retried) for r in f][:2] == [("make x", True), ("git push", False)]


def test_following_and_runs_across_blocks(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), s, r.randrange(4)) for s in range(120) if r.random() < 0.6]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    for block in (1, 3, 10, 1 << 41):
        got = {x.seq: [y.v for y in x.following] for x in blocks.with_following(df, ["k"], "seq", 3, ["v"], block=block).collect()}
        runs = {x.seq: x.run for x in blocks.with_runs(df, ["k"], "seq", ["v"], lambda p: F.col("v") < p["v"], block=block).collect()}
        for k in (None, "a", "b"):
            own = [x for x in rows if x[0] == k]
            start = None
            for i, x in enumerate(own):
                assert got[x[1]] == [y[2] for y in own[i + 1 : i + 4]]
                start = x[1] if i == 0 or x[2] < own[i - 1][2] else start
                assert runs[x[1]] == start


def test_search_and_expansion(spark):
    now = 1_000_000
    h = history(spark, [("git push origin", now - 10, 0), ("git push origin", now, 0), ("echo git push", now, 0), ("openssl x509 -in c.pem", now, 0), ("git commit -m fix", now, 0)])
    assert [r.command for r in search.search(h, "PUSH git", now).collect()] == ["git push origin", "echo git push"]
    assert search.search(h, "", now).count() == 0
    c, stop = concepts.load_concepts()
    got = search.search_any(h, "the command used to renew certificate", c, stop, now).collect()
    assert [r.command for r in got] == ["openssl x509 -in c.pem"]
    assert search.search_any(h, "docker zzzz", c, stop, now).count() == 0
    assert [x.words for x in search.fold("disk space of the host", c, stop)] == [("disk", "space"), ("host",)]
    assert len(search.fold("how to", c, stop)) == 2


def test_picks(spark):
    day = 86400
    ev = spark.createDataFrame([("a", 0), ("a", 21 * day), ("b", None), ("", 5), ("c", -4000 * day)], "command string, ts long")
    assert [tuple(r) for r in picks.pick_weights(ev, 21 * day).collect()] == [("a", 1.5)]
    stored = spark.createDataFrame([("a", 1.0, 0)], "command string, count double, ts long")
    merged = picks.merge_picks(stored, ev.where("ts = 1814400"), 21 * day).collect()
    assert [tuple(r) for r in merged] == [("a", 1.5, 21 * day)]


@pytest.mark.parametrize("a,b,want", [("psuh", "push", True), ("mian", "main", True), ("buld", "build", True), ("hostt", "host", True), ("instal", "install", True), ("push", "pull", False), ("prod-1", "prod-2", False), ("a_b", "axb", False), ("x", "x", False), ("", "a", False), ("ab", "abcde", False)])
def test_typos(a, b, want):
    assert slip(a, b) is want


def test_promote_finds_parametrised_sequence(spark):
    rows, t = [], 0
    for day, v in enumerate(("1.0", "1.1", "2.0", "2.0")):
        t = day * 86400
        rows += [(f"docker build -t api:{v} .", t, 0), ("git status", t + 5, 0), (f"docker push reg/api:{v}", t + 30, 0), ("kubectl apply -f k8s.yml", t + 60, 0), ("make nope", t + 70, 2)]
    got = promote.promote(history(spark, rows)).collect()
    assert len(got) == 1
    assert got[0].steps == ["docker build -t $BUILD_ARG .", "docker push $PUSH_ARG", "kubectl apply -f k8s.yml"]
    assert got[0].occurrences == 4 and got[0].saved == 12 and got[0].confidence == "moderate"
    existing = spark.createDataFrame([(got[0].steps,)], "steps array<string>")
    assert promote.promote(history(spark, rows), existing).count() == 0
    df = spark.createDataFrame([(0, ["a", "./x/deploy.sh"]), (1, ["terraform apply"]), (2, ["sudo terraform apply"]), (3, ["123"])], "i int, steps array<string>")
    assert [r.name for r in promote.with_names(df, [F.col("i")]).orderBy("i").collect()] == ["deploy", "terraform-apply", "terraform-apply-2", "routine-123"]
    taken = spark.createDataFrame([("terraform-apply-2",), ("deploy",)], "name string")
    assert [r.name for r in promote.with_names(df, [F.col("i")], taken).orderBy("i").collect()] == ["deploy-2", "terraform-apply-3", "terraform-apply-4", "routine-123"]


def test_inspection_and_shape(spark):
    q = lambda c: tuple(spark.createDataFrame([(c,)], "c string").select(text.is_inspection(F.col("c")), text.shape(F.col("c"))).first())
    assert q("sudo ls -la") == (True, ["sudo", "ls", "-la"])
    assert q("cat a > b")[0] is False and q("cat a > b")[1] == ["\u0001cat a > b"]
    assert q("git log x")[0] is True and q("git branch x")[0] is False and q("   ")[0] is True
    assert q('helm up x "a b" --set=k=v -n p')[1] == ["helm", "up", "\u0000", "\u0000", "--set=\u0000", "-n", "\u0000"]


def test_session_log(spark):
    rows = [("a", 100, 0), ("b", 400, 0), ("c", 701, 0), ("d", 702, 0, "/other")]
    got = sorted(tuple(r) for r in work_sessions.session_log(history(spark, rows)).select("started_at", "ended_at", "summary", "n_commands").collect())
    assert got == [(380, 400, "a (+1 more commands)", 2), (691, 701, "c", 1), (692, 702, "d", 1)]


def test_patterns(spark):
    rows = [(f"git checkout b{i % 3}", i, 0) for i in range(6)] + [("ls", 9, 0)] * 4
    h = history(spark, rows)
    assert {(r.tool, r.frequency) for r in patterns.tool_patterns(h).collect()} == {("git", 2)}
    cache = patterns.generalise(patterns.next_to_generalise(h, spark.createDataFrame([], "tool string, command string")), lambda t, c: f"git checkout <{c[-2:]}>")
    got = patterns.generalised_patterns(h, cache).collect()
    assert [(r.signature, r.frequency, r.example) for r in got] == [("git checkout <>", 6, "git checkout b0")]
    bad = spark.createDataFrame([("git x", "git <value>"), ("git x", "git <name>; rm"), ("git x", "git <branch>")], "command string, pattern string")
    assert [r[0] for r in bad.select(patterns.corrupt_pattern()).collect()] == [True, True, False]


def test_retention(spark):
    now, day = 200 * 86400, 86400
    h = history(spark, [("a", now - 89 * day, 0), ("b", now - 90 * day, 0), ("c", now - 91 * day, 0), ("d", None, 0)])
    assert {r.command for r in retention.rotate(h, now).collect()} == {"a", "d"}
    lines = spark.createDataFrame([("{bad",), (json.dumps({"ts": 5}),), (json.dumps({"ts": 5, "imported": True}),), (json.dumps({"command": "x"}),)], "value string")
    assert retention.rotate_lines(lines, now).count() == 3
    s = spark.createDataFrame([("i", "my pw", 5, ["pw 1", "ls"]), ("j", "x", now, ["pw"])], "id string, summary string, started_at long, commands array<string>")
    assert [tuple(r) for r in retention.forget_in_sessions(s, "pw").collect()] == [("i", "", 5, ["ls"])]
    assert retention.rotate_sessions(s, now).count() == 1
    assert {tuple(r) for r in retention.forget_targets({"s": s, "h": h}, "pw").collect()} == {("s", 2)}
    assert retention.forget(h, "a", ["command"]).count() == 3
    owned = retention.split_by_owner(spark.createDataFrame([('{"repo":"/w/a-b/c"}',), ('{"repo":"/w/a/b/c"}',), ("{}",), ("{}",)], "value string"), "old").collect()
    assert len({r.repo_key for r in owned}) == 3 and len(owned) == 3


def test_runbooks_round_trip(spark):
    doc = json.dumps({"deploy": {"description": "d", "commands": [{"cmd": "echo $TAG $$HOME_DIR $HOME", "comment": "c"}, {"cmd": "ls"}]}, "Bad Name": {"commands": [{"cmd": "x"}]}})
    steps = runbooks.import_json(spark.createDataFrame([(doc,)], "value string")).withColumn("scope", F.lit("_global")).withColumn("vars", F.lit(None).cast("array<struct<name:string,default_value:string>>"))
    assert steps.count() == 2
    assert [(r.n_steps, r.variables) for r in runbooks.listing(steps).collect()] == [(2, "TAG")]
    md = runbooks.export_markdown(steps).select(F.col("doc").alias("value"))
    assert sorted(tuple(r) for r in runbooks.import_markdown(md).collect()) == [("deploy", 1, "echo $TAG $$HOME_DIR $HOME", "c"), ("deploy", 2, "ls", None)]
    again = runbooks.import_json(runbooks.export_json(steps).select(F.col("doc").alias("value")), "deploy")
    assert again.count() == 2
    values = spark.createDataFrame([("TAG", "a$1\\b")], "name string, value string")
    assert runbooks.rendered(steps.where("step_no = 1"), values).first().cmd == "echo a$1\\b $HOME_DIR $HOME"
    both = runbooks.copy(steps, "deploy", "_global", "/r")
    assert runbooks.shadowing(both, "/r").count() == 1 and runbooks.lookup(both, "deploy", "/r").first().scope == "/r" and runbooks.lookup(both, "deploy", "/r", True).first().scope == "_global"
    assert runbooks.remove(both, "/r", "deploy").count() == 2 and runbooks.rename(both, "/r", "deploy", "x").where("group_name = 'x'").count() == 2
    assert runbooks.merge_steps(steps, steps).count() == 2


def test_resolution_prefers_empty_inline(spark):
    t = lambda rows: spark.createDataFrame(rows, "name string, value string")
    got = runbooks.resolve(t([(n, None) for n in "ABCDE"]).select("name"), t([("A", "")]), t([("A", "x"), ("B", "")]), t([("C", "s")]), t([("C", "d"), ("D", "d")])).collect()
    assert {r.name: (r.value, r.source) for r in got} == {"A": ("", "inline"), "B": ("", "env"), "C": ("s", "store"), "D": ("d", "default"), "E": (None, "prompt")}


def test_import(spark):
    e = spark.createDataFrame([(i, "f", c, t) for i, (c, t) in enumerate([("x", None), ("a", 1000), ("a", None), ("b", 0), ("c", 1300), ("password=hunter22", 1400), ("a", 99999)])], "line_no int, file string, command string, ts long")
    assert [r.ts for r in importer.dated(e, ["file"], "line_no", 2000).orderBy("line_no").collect()] == [970, 1000, 1100, 1200, 1300, 1400, 1700]
    got = importer.plan(e, spark.createDataFrame([("a",), ("a",)], "command string"), "file", "line_no")
    assert [r.verdict for r in got.orderBy("line_no").collect()] == ["new", "duplicate", "duplicate", "new", "new", "credential", "new"]
    assert importer.as_history(got).count() == 4


@pytest.mark.parametrize(
    "raw,want",
    [
        ("curl -H 'Authorization: Bearer abc12345'", "curl -H 'Authorization: Bearer [REDACTED]'"), ("psql postgres://u:pw@h/d", "psql postgres://u:[REDACTED]@h/d"), ("PGPASSWORD=x psql", "PGPASSWORD=[REDACTED] psql"),
        ("x run --token $API_TOKEN", "x run --token $API_TOKEN"), ("docker run -u 1000:1000 x", "docker run -u 1000:1000 x"), ("deploy --password --verbose", "deploy --password --verbose"), ("grep api_key ./src/config.py", "grep api_key ./src/config.py"),
        ("echo ghp_abcdefghijklmnop1234", "echo [REDACTED]"), ("aws configure set aws_secret_access_key wJalrXUtnFEMI", "aws configure set aws_secret_access_key [REDACTED]"), ("git show 45caf111aa", "git show 45caf111aa"),
    ],
)
def test_redaction(spark, raw, want):
    once, twice = spark.createDataFrame([(raw,)], "c string").select(redact(F.col("c")), redact(redact(F.col("c")))).first()
    assert once == want and twice == want


def test_event_lines(spark, tmp_path):
    lines = ['{"command":"a","ts":"5","dir":"","extra":1}', "", "{bad", "[]", '{"command":"b","ts":1.5,"dir":""}', '{"command":"c","ts":7,"dir":"/","duration_ms":-1}', '{"ts":1,"dir":""}', '{"command":"d","ts":8.0,"dir":"/","exit_code":3}']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    got = events.read_events(spark, str(tmp_path / "e.jsonl")).orderBy("seq").collect()
    assert [(r.command, r.ts, r.exit_code, r.imported) for r in got] == [("a", 5, None, False), ("d", 8, 3, False)]
    out = history(spark, [("ls", 1, 0), ("LS x", 2, 0, None)])
    events.write_history(out, str(tmp_path / "t"))
    assert {r.repo_key for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"_global", "w-a-" + __import__("hashlib").sha256(b"/w/a").hexdigest()[:8]}
    events.write_events(out, str(tmp_path / "j"))
    assert events.read_events(spark, str(tmp_path / "j/*")).count() == 2


def test_search_pushes_down_on_history_table(spark, tmp_path):
    events.write_history(history(spark, [("Git Push", 5, 0), ("ls", 6, 0)]), str(tmp_path / "t"))
    found = search.search(spark.read.parquet(str(tmp_path / "t")), "git push", 10)
    assert [r.command for r in found.collect()] == ["Git Push"]
    plan = found._jdf.queryExecution().toString()
    assert "StringContains(command_lc,git)" in plan
    assert json.loads(events.as_json(found).first().value)["repo"] == "/w/a"


def test_detections(spark):
    from runlore.functions import detections

    cmd = "curl --token=abcdef123456 https://x.test db.corp.test:5432 -H 'k: zz'"
    found = [("apiToken", "--token=abcdef123456"), ("same", "abcdef123456"), ("part", "abcdef1234"), ("host", "db.corp.test:5432"), ("short", "zz"), ("absent", "not in there"), ("url", "https://x.test")]
    df = spark.createDataFrame([(cmd, found)], "c string, f array<struct<name:string,value:string>>")
    got = df.select(detections.detections(F.col("f"), F.col("c")).alias("d"), detections.may_hold_credential(F.col("c")).alias("m"), detections.may_hold_credential(F.lit("ls -la")).alias("n")).first()
    assert [tuple(x) for x in got.d] == [("API_TOKEN", "abcdef123456")] and got.m and not got.n


def test_shell_files(spark, tmp_path):
    (tmp_path / "zsh_history").write_bytes(b": 1712345678:0;git push\nplain\\\nmore\n: 17:\nx\xff\n")
    (tmp_path / "bash_history").write_text("#1712345678\nls\npwd\n")
    (tmp_path / "fish_history").write_text("- cmd: a\\nb\n  when: 1712345678\njunk\n- cmd: c\n")
    got = shell_history.read_shell_history(spark, str(tmp_path))
    rows = {(r.file.rsplit("/", 1)[-1][:4], r.command, r.ts) for r in got.collect()}
    assert rows == {("zsh_", "git push", 1712345678), ("zsh_", "plain\nmore", None), ("zsh_", None, None), ("zsh_", "x�", None), ("bash", "ls", 1712345678), ("bash", "pwd", None), ("fish", "a\nb", 1712345678), ("fish", None, None), ("fish", "c", None)}
    assert {(r.n_entries, r.failed_lines) for r in shell_history.failed_lines(got).collect()} == {(3, 1), (2, 0), (2, 1)}
    with pytest.raises(ValueError):
        shell_history.parse_files(got, "tcsh")


def test_agent(spark):
    h = history(spark, [("curl -u me:secretpw x", 5, 1), ("ls", 6, 0)])
    steps = spark.createDataFrame([("_global", "g", None, 1, "ls $TAG", None, None)], "scope string, group_name string, description string, step_no int, cmd string, comment string, vars array<struct<name:string,default_value:string>>")
    log = []
    s = agent.Service(h, steps, enabled=True, audit=log.append, now=lambda: 10)
    ask = lambda tool, args: s.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": args}})
    assert "secretpw" not in json.dumps(ask("search_history", {"query": "curl"})) and "[REDACTED]" in json.dumps(ask("recent_failures", {}))
    assert json.loads(ask("list_runbooks", {})["result"]["content"][0]["text"])["count"] == 1 and ask("get_runbook", {"name": "g"})["result"]
    assert ask("search_history", {"query": "x", "limit": True})["error"] and ask("nope", {"token": "--password abc123"})["error"]
    assert log[-1]["ok"] is False and log[-1]["arguments"] == {"token": "--password [REDACTED]"} and log[0]["results"] == 1
    assert s.handle({"method": "x"}) is None and s.handle({"id": 2, "method": "initialize"})["result"] and len(s.handle({"id": 3, "method": "tools/list"})["result"]["tools"]) == 4
    s.enabled = False
    assert ask("search_history", {"query": "curl"})["error"]
