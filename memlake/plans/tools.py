"""The seven tools that a model has, and the commands that a user has, over the service.

Tools take plain arguments and give a dictionary in JSON's types; lists are pages of at most 50 items with the total. Commands give
a DataFrame or a text. Ids may be given by their beginnings.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.config import pending_max, write_policy
from memlake.functions.refs import refs_string
from memlake.functions.text import clamp_text, workspace_key
from memlake.operators import capture, filters, provenance, recall, report
from memlake.operators.portrait import history
from memlake.plans.lineage import cut
from memlake.plans.service import MemoryService
from memlake.schema import KINDS, SCOPES, default_scope, ranking
from memlake.sources import sessions as logs
from memlake.sources import store as files

#: Items of a page.
ITEMS = 50
#: Results of a search, and of its default.
SEARCH = 10
INPUT = "input_id string, arrival bigint, kind string, text string, subject string, field string, value string, tags array<string>, importance double, pinned boolean, facet string, branch string, scope struct<level:string,key:string>, origin string, sessionId string, confidence double, refs array<struct<sessionId:string,from:bigint,to:bigint,via:string>>"
WAITS = "已提议，尚未生效：writePolicy=ask 时模型来源的写入进待确认队列，只有用户能让它生效（模型无法自我批准）。"


def page(rows: DataFrame, order: list, most: int = ITEMS) -> dict[str, Any]:
    """A page of rows as dictionaries, how many there are in all, and whether some were left out; items are never cut."""
    total = rows.count()
    items = [r.asDict(recursive=True) for r in rows.orderBy(*order).limit(most).collect()]
    return {"items": items, "count": len(items), "total": total, "truncated": total > len(items)}


class Tools:
    """session: the session's id; cwd: its folder; events: what was said in it, which tells whose wish a write is."""

    def __init__(self, service: MemoryService, session: str | None = None, cwd: str | None = None, events: DataFrame | None = None):
        self.service, self.spark, self.session, self.cwd, self.events = service, service.spark, session, cwd, events
        self.all: dict[str, Callable[..., dict[str, Any]]] = {f"memory_{n}": getattr(self, n) for n in ("write", "recall", "list", "forget", "stats", "maintain", "explain")}

    def call(self, name: str, **arguments: Any) -> dict[str, Any]:
        if name not in self.all:
            return {"ok": False, "error": "no such tool"}
        self.service.counters[name] += 1
        return self.all[name](**arguments)

    def origin(self) -> str:
        """Whose wish a write is: the tool never says so itself."""
        if self.service.cfg.trust_tool_writes:
            return "user_explicit"
        if self.events is None or self.session is None:
            return "model_proposed"
        row = logs.last_request(self.events.where(F.col("sessionId") == self.session)).first()
        return row["origin"] if row else "model_proposed"

    def scope(self, kind: str, level: str | None = None) -> tuple[str, str]:
        row = self.spark.range(1).select(default_scope(F.lit(kind)).alias("level"), workspace_key(F.lit(self.cwd).cast("string")).alias("key")).first()
        level = level or row["level"]
        return level, (row["key"] or "*") if level == "workspace" else "*"

    def write(self, kind: str, text: str, subject: str | None = None, field: str | None = None, value: str | None = None, tags: list[str] | None = None, scopeLevel: str | None = None, importance: float | None = None, pinned: bool = False, facet: str | None = None, branch: bool | str | None = None) -> dict[str, Any]:
        """branch: true for the current branch, or a name; one that isn't known leaves the record without any, and says so."""
        if kind not in KINDS or scopeLevel not in (None, *SCOPES):
            return {"ok": False, "error": "rejected_invalid"}
        notices, tag = [], branch if isinstance(branch, str) else None
        if branch is True:
            tag = self.service.branch
            if tag is None:
                notices.append("当前分支未知：这条记忆没有分支标签，跨分支成立。")
        facet = ("persona" if str(facet or "").strip().lower() == "persona" else "work") if kind == "agent_self" else None
        refs = [(self.session, None, None, "tool")] if self.session else None
        row = ("tool", 0, kind, text, subject, field, value, tags or [], importance, pinned is True, facet, tag, self.scope(kind, scopeLevel), self.origin(), self.session, None, refs)
        result = self.service.write(self.spark.createDataFrame([row], INPUT)).first().asDict()
        out = {"ok": result["ok"], "status": result["outcome"], "id": result["id"], "persisted": result["persisted"]} if result["ok"] else {"ok": False, "error": result["outcome"]}
        if result["outcome"] == "pending":
            notices.append(WAITS)
        return out | ({"branch": tag} if tag else {}) | ({"notice": " ".join(notices)} if notices else {})

    def recall(self, query: str = "", kind: str | None = None, scopeLevel: str | None = None, tag: str | None = None, limit: int = 8) -> dict[str, Any]:
        """Archived records count as well: they only aren't shown by themselves."""
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        hits = cut(self.spark, self.service.recall(asked, "query", kind, scopeLevel, tag, True, limit=limit))
        self.service.store.mark_used(hits.select("id"), self.service.clock())
        view = hits.join(self.service.store.records(), "id")
        return page(view.select("rank", "id", "kind", "scope", "origin", "text", "pinned", F.round("score", 3).alias("score"), "observedAt", refs_string(F.col("refs")).alias("refs")), ["rank"])

    def list(self, kind: str | None = None, status: str = "active", limit: int = 50) -> dict[str, Any]:
        """What waits for approval is in no ordinary list."""
        rows = self.service.visible().where(filters.status_selected(status) & (F.col("status") != "pending"))
        rows = rows.where(F.col("kind") == kind) if kind else rows
        rows = rows.orderBy(*ranking()).limit(max(1, min(100, int(limit))))
        return page(rows.select("id", "kind", "status", "origin", "scope", "pinned", "importance", "confidence", "text", refs_string(F.col("refs")).alias("refs")), ranking())

    def forget(self, id: str | None = None, query: str | None = None, confirm: bool = False) -> dict[str, Any]:
        if id:
            found = filters.by_prefix(self.service.store.records(), id).select("id", "status", "text").collect()
            if not found:
                return {"ok": False, "error": "not_found"}
            if found[0]["status"] == "pending":
                return {"ok": False, "error": "pending_requires_decision", "id": found[0]["id"]}
            self.service.forget(self.spark.createDataFrame([(found[0]["id"],)], "id string"))
            return {"ok": True, "deleted": [found[0]["id"]], "text": found[0]["text"]}
        if not query:
            return {"ok": False, "error": "provide id or query"}
        hits = self.service.matching(query)
        view = hits.join(self.service.store.records().select("id", "text"), "id").select("rank", "id", "text")
        if not confirm:
            return {"ok": False, "needsConfirm": True, **page(view, ["rank"])}
        self.service.forget(hits)
        return {"ok": True, "deleted": [r["id"] for r in hits.orderBy("rank").collect()]}  # 20 at most

    def stats(self) -> dict[str, Any]:
        out = self.service.report()
        most = pending_max(self.service.cfg)
        return out | {"writePolicy": write_policy(self.service.cfg), "pending": out["status"].get("pending", 0), "pendingMax": most, "capabilities": self.service.capabilities()}

    def maintain(self) -> dict[str, Any]:
        before = self.service.report()["status"]
        self.service.consolidate()
        return {"ok": True, "before": before, "after": self.service.report()["status"]}

    def explain(self, text: str, apply: bool = False) -> dict[str, Any]:
        """What capture would take from a text and why not the rest, and what it would recall; apply: write it, as the model's own wish."""
        cfg, now = self.service.cfg, self.service.clock()
        said = self.spark.createDataFrame([("t", text)], "message_id string, text string")
        found = cut(self.spark, capture.candidates(said, cfg))
        origin = self.origin()
        items = [r.asDict() | {"writeOrigin": origin} | ({"facet": "work"} if r["kind"] == "agent_self" else {}) for r in found.orderBy("place").select("place", "signal", "kind", "origin", "confidence", "importance", "text").collect()]
        out: dict[str, Any] = {"candidates": items, "skipped": {r["reason"]: r["n"] for r in capture.skipped(said, cfg).collect()}}
        if apply:
            rows = [(f"explain#{c['place']}", c["place"], c["kind"], c["text"], None, None, None, [], c["importance"], False, None, None, self.scope(c["kind"]), origin, self.session, c["confidence"], None) for c in items]
            done = self.service.write(self.spark.createDataFrame(rows, INPUT)).orderBy("input_id").collect() if rows else []
            out |= {"applied": True, "written": [{"ok": r["ok"], "status": r["outcome"], "id": r["id"], "persisted": r["persisted"]} for r in done]}
            if any(r["outcome"] == "pending" for r in done):
                out["notice"] = WAITS
            return out
        probes = self.spark.createDataFrame([(str(c["place"]), c["text"]) for c in items[:3]], "query_id string, query string")
        if items:
            pool = cut(self.spark, self.service.store.records().where(filters.active()))
            hits = cut(self.spark, recall.recall(pool, probes, now, cfg, "query", 3))
            detail = recall.explain(pool, probes, cfg).join(hits.select("query_id", "id"), ["query_id", "id"], "left_semi")
            told = detail.groupBy("query_id", "id").agg(F.sort_array(F.collect_list("token")).alias("matchedTokens"), F.round(F.first("score"), 3).alias("matchScore"), F.first("passes").alias("passesMatchThreshold"))
            rows = hits.join(told, ["query_id", "id"], "left").join(probes.select("query_id", clamp_text(F.col("query"), 60).alias("text")), "query_id")
            out["matching"] = [r.asDict() for r in rows.select("query_id", "rank", "id", "text", F.round("score", 3).alias("score"), "matchedTokens", "matchScore", "passesMatchThreshold").orderBy("query_id", "rank").collect()]
        out["portrait"] = page(report.portrait_view(self.service.store.records()), ["id"])
        out["blocked_by_branch"] = provenance.blocked_by_branch(self.service.store.records(), self.service.branch).first()["blocked"]
        return out


class Commands:
    """What a user can ask for by name: overview, search, forget, self, help, sleep, and those that administer."""

    def __init__(self, service: MemoryService, tools: Tools | None = None):
        self.service, self.tools = service, tools or Tools(service)

    def run(self, line: str, **options: Any) -> Any:
        """A command by its words; `admin` before one of those that administer may be left out."""
        words = line.split(maxsplit=1)
        if words and words[0] == "admin":
            words = words[1].split(maxsplit=1) if len(words) > 1 else ["help"]
        name, rest = (words[0] if words else "overview").replace("-", "_"), words[1] if len(words) > 1 else ""
        f = getattr(self, f"do_{name}", None)
        if f is None:
            return self.do_help("")
        return f(rest.strip(), **options)

    def records(self) -> DataFrame:
        return self.service.store.records()

    def _one(self, prefix: str, pending: bool = False) -> DataFrame:
        found = filters.by_prefix(self.records(), prefix, pending)
        if not prefix or not found.take(1):
            raise LookupError("no record has this prefix")
        return cut(self.service.spark, found.select("id"))

    def names(self) -> list[str]:
        return sorted(n[3:].replace("_", "-") for n in dir(self) if n.startswith("do_"))

    # for everyone
    def do_overview(self, _: str) -> DataFrame:
        return provenance.stats(self.records()).orderBy("kind", "status")

    def do_search(self, query: str, limit: int = SEARCH) -> DataFrame:
        asked = self.service.spark.createDataFrame([("q", query)], "query_id string, query string")
        hits = self.service.recall(asked, include_archived=True, limit=min(SEARCH, limit))
        return hits.join(report.list_lines(self.records()), "id").select("rank", "id", "score", "line").orderBy("rank")

    def do_forget(self, prefix: str) -> None:
        self.service.forget(self._one(prefix))

    def do_self(self, what: str) -> DataFrame:
        if what == "history":
            return history(self.records())
        return self.service.self_text() if what != "view" else report.portrait_view(self.records())

    def do_help(self, _: str) -> list[str]:
        return self.names()

    def do_sleep(self, _: str, sessions: DataFrame, events: DataFrame, apply: bool = False, backup: str | None = None) -> DataFrame:
        return self.service.plan_text(self.service.sleep(sessions, events, apply, backup))

    # for administering
    def do_list(self, _: str, kind: str | None = None, archived: bool = False) -> DataFrame:
        rows = self.service.visible().where(filters.status_selected(None, archived))
        rows = rows.where(F.col("kind") == kind) if kind else rows
        return report.list_lines(rows.orderBy(*ranking()).limit(100))

    def do_show(self, prefix: str) -> DataFrame:
        return self.records().join(self._one(prefix), "id", "left_semi")

    def do_stats(self, _: str) -> dict[str, Any]:
        return self.tools.stats()

    def do_pending(self, _: str) -> DataFrame:
        return self.service.pending_text()

    def do_approve(self, prefix: str) -> None:
        self.service.approve(self._one(prefix, True))

    def do_reject_pending(self, prefix: str) -> None:
        self.service.reject(self._one(prefix, True))

    def do_export(self, path: str) -> None:
        self.service.export(path)

    def do_import(self, path: str) -> DataFrame:
        return self.service.import_(files.read_export(self.service.spark, path))

    def do_clear(self, _: str, yes: bool = False, **which: Any) -> None:
        if not yes:
            raise ValueError("this can't be undone: say yes")
        self.service.clear(**which)

    def do_consolidate(self, _: str) -> bool:
        return self.service.consolidate()

    def do_branch(self, _: str, all: bool = False) -> DataFrame:
        return provenance.branches(self.records(), self.service.branch) if all else self.service.branch_text()

    def do_trace(self, where: str) -> DataFrame:
        session, _, seq = where.partition("#")
        return self.service.trace(session.strip(), int(seq) if seq.strip() else None)

    def do_verify(self, prefix: str, messages: DataFrame) -> DataFrame:
        return provenance.verify(self.do_show(prefix), messages)

    def do_audit(self, _: str, limit: int = 20, logs: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """With logs (text) and the lines that were shown, those are looked for; else nothing is said to be checked."""
        verify = provenance.shown(lines, logs).first().asDict() if logs is not None and lines is not None else None
        return self.service.audit_text(limit, verify)

    def do_pin(self, prefix: str) -> None:
        one = self._one(prefix)
        on = self.records().join(one, "id", "left_semi").first()["pinned"]
        self.service.pin(one, not on)

    def do_archive(self, prefix: str) -> None:
        self.service.set_status(self._one(prefix), "archived")

    def do_restore(self, prefix: str) -> None:
        self.service.restore(self._one(prefix))

    def do_confirm(self, prefix: str) -> None:
        self.service.confirm(self._one(prefix))

    def do_reject(self, prefix: str) -> None:
        """Refuse an observation of the self portrait: it becomes invalid, and its fingerprint is refused from then on."""
        one = self._one(prefix)
        hashes = cut(self.service.spark, self.records().join(one, "id", "left_semi").select("hash"))
        self.service.set_status(one, "invalid")
        self.service.store.reject(hashes)

    def do_refresh(self, prefix: str) -> None:
        self.service.refresh(self._one(prefix))

