"""The read-only query service for agents: four tools over JSON-RPC messages, redacted and audited."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from runlore.functions.redaction import redact, redact_all
from runlore.functions.text import slug
from runlore.operators import failures, runbooks, search

MAX_LIMIT, SCAN_CAP = 50, 500
PROTOCOL = "2024-11-05"


class BadRequest(ValueError):
    """A request whose parameters do not fit; the message goes to the caller."""


class Service:
    """Answers requests from tables; nothing is written but the audit rows handed to ``audit``."""

    def __init__(self, history: DataFrame, steps: DataFrame, repo: str | None = None, enabled: bool = False, picks: DataFrame | None = None, audit: Callable[[dict], None] | None = None, now: Callable[[], int] = lambda: int(time.time())) -> None:
        self.history, self.steps, self.repo, self.enabled, self.picks, self.audit, self.now = history, steps, repo, enabled, picks, audit or (lambda row: None), now
        self.tools: dict[str, tuple[Callable[[dict], list[dict]], str]] = {
            "search_history": (self.search_history, "Commands that hold every word of a query, best first."),
            "list_runbooks": (self.list_runbooks, "Saved runbooks with their size and parameters."),
            "get_runbook": (self.get_runbook, "The steps of one runbook."),
            "recent_failures": (self.recent_failures, "Commands that failed, and what was run next."),
        }

    @staticmethod
    def text(args: dict, name: str, required: bool = False) -> str | None:
        v = args.get(name)
        if (v is None and required) or not (v is None or isinstance(v, str)) or (required and not v.strip()):
            raise BadRequest(f"{name} must be a string")
        return v

    @staticmethod
    def limit(args: dict, default: int = 10) -> int:
        v = args.get("limit", default)
        if isinstance(v, bool) or not isinstance(v, int):
            raise BadRequest("limit must be an integer")
        return max(1, min(MAX_LIMIT, v))

    @staticmethod
    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def search_history(self, args: dict) -> list[dict]:
        query, repo, n = self.text(args, "query", True), self.text(args, "repo"), self.limit(args)
        found = search.search(self.history, query, self.now(), self.repo, SCAN_CAP if repo else n, self.picks)
        if repo:  # after ranking, so that the cap of the scan keeps its meaning
            found = found.where((F.col("repo") == repo) | (slug(F.col("repo")) == slug(F.lit(repo)))).orderBy(F.desc("score"), F.desc("ts"), "command").limit(n)
        return self.rows(found.withColumns({"command": redact(F.col("command")), "score": F.round("score", 4)}))

    def list_runbooks(self, args: dict) -> list[dict]:
        here = F.coalesce(F.col("scope") != F.lit(self.repo), F.lit(True))
        return self.rows(runbooks.listing(self.steps).orderBy(here, "scope", "group_name"))

    def get_runbook(self, args: dict) -> list[dict]:
        found = runbooks.lookup(self.steps, self.text(args, "name", True), self.repo)
        return self.rows(found.select("scope", "group_name", "step_no", redact(F.col("cmd")).alias("cmd"), redact(F.col("comment")).alias("comment")))

    def recent_failures(self, args: dict) -> list[dict]:
        found = failures.recent_failures(self.history, self.limit(args), self.text(args, "repo"))
        return self.rows(found.withColumns({"command": redact(F.col("command")), "followed_by": redact_all(F.col("followed_by"))}))

    def call(self, tool: str, args: dict) -> list[dict]:
        """The rows of a tool; every call, refused ones too, leaves an audit row with redacted arguments."""
        ok, error, out = False, None, []
        try:
            if not self.enabled:
                raise BadRequest("agent access is off")
            if tool not in self.tools:
                raise BadRequest(f"unknown tool {tool}")
            out = self.tools[tool][0](args)
            ok = True
            return out
        except BadRequest as e:
            error = str(e)
            raise
        finally:
            self.audit({"ts": self.now(), "tool": tool, "arguments": self._masked(args), "results": len(out), "ok": ok, "error": error})

    def _masked(self, args: dict) -> dict[str, str]:
        items = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in list(args.items())[:10]]
        if not items:
            return {}
        df = self.history.sparkSession.createDataFrame([Row(k=k, v=v) for k, v in items])
        return {r["k"]: r["v"] for r in df.select("k", redact(F.col("v")).alias("v")).collect()}

    def handle(self, message: dict) -> dict | None:
        """The response to one message; None for a notification."""
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "runlore", "version": "0.1.0"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object"}} for n, (_, d) in self.tools.items()]}}
        if method == "tools/call":
            try:
                out = self.call(params.get("name"), params.get("arguments") or {})
            except BadRequest as e:
                return reply | {"error": {"code": -32602, "message": str(e)}}
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps({"count": len(out), "rows": out}, default=str)}]}}
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}
