"""Predicates that choose records; all are plain columns, which reach the scan where the columns are stored flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import Config
from memlake.functions.text import normalize_branch
from memlake.schema import KINDS, SCOPES, user_side


def active() -> Column:
    return F.col("status") == "active"


def branch_visible(current: str | None, cfg: Config, branch: str = "branch") -> Column:
    """Records without a branch, and those of the current one if it is known."""
    if not cfg.branch_aware:
        return F.lit(True)
    own = normalize_branch(F.col(branch))
    here = normalize_branch(F.lit(current).cast("string"))
    return own.isNull() | F.coalesce(own == here, F.lit(False))


def branch_selected(which: str | list[str] | None, current: str | None) -> Column:
    """null: all; 'current': the current branch's; a name or a list of names: those (an empty list: none)."""
    if which is None:
        return F.lit(True)
    names = [current] if which == "current" else [which] if isinstance(which, str) else list(which)
    names = [n for n in names if n is not None]
    return F.coalesce(normalize_branch(F.col("branch")).isin(*names), F.lit(False)) if names else F.lit(False)


def status_selected(status: str | None = None, include_archived: bool = False) -> Column:
    if status == "all":
        return F.lit(True)
    if status is not None:
        return F.col("status") == status
    return F.col("status").isin("active", "archived") if include_archived else active()


def recall_pool(records: DataFrame, kind: str | None = None, scope_level: str | None = None, tag: str | None = None, include_archived: bool = False, status: str | None = None) -> DataFrame:
    records = records.where(status_selected(status, include_archived))
    if kind:
        records = records.where(F.col("kind") == kind)
    if scope_level:
        records = records.where(F.col("scope.level") == scope_level)
    if tag:
        records = records.where(F.array_contains("tags", tag))
    return records


def resident(workspace: str | None) -> Column:
    here = (F.col("scope.level") == "profile") | ((F.col("scope.level") == "workspace") & F.coalesce(F.col("scope.key") == F.lit(workspace), F.lit(False)))
    return active() & ~F.col("kind").isin("agent_self", "episodic") & ~F.coalesce(F.array_contains("tags", "summary"), F.lit(False)) & here


def portrait_eligible(cfg: Config) -> Column:
    """User-side records of some confidence; the model's own only where several sessions repeat them."""
    user = user_side(F.col("origin")) & (F.col("confidence") >= cfg.self_portrait_min_confidence)
    sessions = F.coalesce(F.size("reinforcement.sessions"), F.lit(0))
    model = (F.col("origin") == "model_proposed") & (F.col("confidence") >= cfg.self_portrait_model_min_confidence) & (sessions >= cfg.self_portrait_promote_sessions)
    return active() & (F.col("kind") == "agent_self") & (user | model)


def workspace_recall(workspace: str | Column | None) -> Column:
    """Not of other workspaces, and never the self portrait; the workspace can be a column."""
    here = workspace if isinstance(workspace, Column) else F.lit(workspace)
    return ((F.col("scope.level") != "workspace") | F.coalesce(F.col("scope.key") == here, F.lit(False))) & (F.col("kind") != "agent_self")


def clear_selected(kind: str | None = None, scope_level: str | None = None, everything: bool = False) -> Column:
    """What a clear takes: kind and scope together, or everything; never what waits for approval."""
    if everything and (kind or scope_level):
        raise ValueError("everything excludes kind and scope_level")
    if not everything and not (kind or scope_level):
        raise ValueError("name a kind or a scope level, or everything")
    if (kind and kind not in KINDS) or (scope_level and scope_level not in SCOPES):
        raise ValueError("no such kind or scope level")
    out = F.col("status") != "pending"
    if kind:
        out = out & (F.col("kind") == kind)
    if scope_level:
        out = out & (F.col("scope.level") == scope_level)
    return out


def by_prefix(records: DataFrame, prefix: str, pending: bool = False) -> DataFrame:
    """The record that an id prefix names; a pending one must be named by exactly one."""
    found = records.where(F.startswith("id", F.lit(prefix)))
    if pending:
        found = found.where(F.col("status") == "pending")
        n = len(found.select("id").take(2))
        if n != 1:
            raise LookupError("no pending record has this prefix" if n == 0 else "several pending records have this prefix")
        return found
    return found.orderBy("id").limit(1)


def page(records: DataFrame, limit: int, most: int, default: int, order: list | None = None) -> DataFrame:
    """At most so many rows, each with the total and whether rows were left out."""
    n = default if limit is None else max(1, min(most, int(limit)))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    rows = records.orderBy(*(order or [F.col("id")])).limit(n)
    return rows.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > n)  # one row
