"""Records and what happened to them as text for people: lines, queues, branches, audits, plans.

Each text is one row. What is listed is a page (a queue, a ring, a plan); counts are made over everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config, audit_max, budget, pending_max
from memlake.functions.refs import format_refs, refs_string, sanitize
from memlake.functions.text import clamp_text, normalize_branch, normalize_facet, stamp
from memlake.operators.provenance import ACTIONS, branches
from memlake.operators.replay import Plan
from memlake.plans.lineage import cut

#: Tokens of a field of an audit's line, and characters of an id that is shown.
FIELD_TOKENS, ID_CHARS = 300, 8
#: Entries that a text lists where nothing else bounds them.
PAGE = 1_000


def facet() -> Column:
    return normalize_facet(F.coalesce("facet", F.lit("work")))


def kind_label() -> Column:
    return F.when(F.col("kind") == "agent_self", F.concat(F.lit("agent_self/"), facet())).otherwise(F.col("kind"))


def short(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.substring(c, 1, ID_CHARS)).otherwise("-")


def list_lines(records: DataFrame) -> DataFrame:
    """(id, line): a record in one line, a star for a pinned one."""
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    star = F.when(F.col("pinned"), "★").otherwise(" ")
    return records.select("id", F.concat(F.substring("id", 1, ID_CHARS), F.lit("  "), pad(F.col("kind"), 13), F.lit(" "), pad(F.col("scope.level"), 9), star, F.lit(" "), "text").alias("line"))


def portrait_view(records: DataFrame) -> DataFrame:
    """The self portrait's records as a diagnosis shows them: facet, where they came from and what they replaced."""
    rows = records.where(F.col("kind") == "agent_self")
    at = F.date_format(F.timestamp_millis("observedAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(
        "id", "status", facet().alias("facet"), "subject", "origin", "pinned", "confidence", at.alias("observedAt"), "text", refs_string(F.col("refs")).alias("refs"),
        F.when(F.length("supersededBy") > 0, F.col("supersededBy")).alias("supersededBy"), F.when(F.size("supersedes") > 0, F.col("supersedes")).alias("supersedes"),
    )


def _text(rows: DataFrame, line: Column, order: list[Column], head: Column, foot: Column, page: int = PAGE) -> DataFrame:
    """One row, the text of a head, lines in order and a foot (each may be null); the head can count on `n`, all rows."""
    few = rows.select(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")).orderBy(*[f"o{i}" for i in range(len(order))]).limit(page)
    names = [f"o{i}" for i in range(len(order))]
    listed = few.agg(F.transform(F.array_sort(F.collect_list(F.struct(*names, "line"))), lambda r: r["line"]).alias("lines"))
    both = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(listed))  # a row each
    return both.select(F.array_join(F.array_compact(F.concat(F.array(head), "lines", F.array(foot))), "\n").alias("text"))


def _item(c: Column, cfg: Config, tokens: float) -> Column:
    return clamp_text(c, tokens, budget(cfg.chars_per_token, DEFAULTS.chars_per_token))


def pending_text(records: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """What waits for approval, the newest first: id, kind, origin, time, references and the text's beginning."""
    rows = records.where(F.col("status") == "pending")
    refs = format_refs(F.col("refs"))
    parts = F.array_compact(F.array(kind_label(), F.col("origin"), stamp(F.col("observedAt")), F.when(refs != "", F.concat(F.lit("引用 "), refs))))
    line = F.concat(F.lit("  - "), "id", F.lit(" · "), F.array_join(parts, " · "), F.lit(" · "), _item(F.col("text"), cfg, cfg.max_item_tokens))
    most = pending_max(cfg)
    limit = f"{most:g}" if most > 0 else "不限"
    head = F.when(F.col("n") == 0, "[待确认写入 · 0 条]\n没有待确认的写入。").otherwise(F.concat(F.lit("[待确认写入 · 共 "), F.col("n").cast("string"), F.lit(f" 条 · 上限 {limit}]")))
    foot = F.when(F.col("n") > 0, "用 /memory approve <id 前缀> 让它生效；/memory reject-pending <id 前缀> 保留为无效（便于审计）。")
    return _text(rows, line, [-F.col("observedAt"), F.col("id")], head, foot)


def branch_text(records: DataFrame, current: str | None) -> DataFrame:
    """The current branch, how many records belong to branches, and each branch's number."""
    named = branches(records, current)
    here = normalize_branch(F.lit(current).cast("string"))
    mark = F.when(F.coalesce(F.col("branch") == here, F.lit(False)), "（当前分支）").otherwise("")
    line = F.concat(F.lit("  - "), "branch", F.lit("："), F.col("n").cast("string"), F.lit(" 条"), mark)
    counts = records.agg(F.count(normalize_branch(F.col("branch"))).alias("tagged"), F.count(F.lit(1)).alias("all"))
    listed = named.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "branch", line.alias("line")))), lambda r: r["line"]).alias("lines"))  # branches, not records
    rows = counts.crossJoin(F.broadcast(listed))  # a row each
    head = F.array(
        F.concat(F.lit("[记忆分支 · 当前分支："), F.coalesce(here, F.lit("unknown")), F.lit("]")),
        F.concat(F.lit("带分支标签的记忆："), F.col("tagged").cast("string"), F.lit(" 条（库内共 "), F.col("all").cast("string"), F.lit(" 条）。")),
        F.when(F.col("tagged") == 0, "没有任何分支专属记忆：全部记忆都跨分支成立。").otherwise("按分支分组："),
    )
    foot = F.array(F.when(here.isNull(), "当前分支未知（不在 git 仓库或读不到 HEAD）：带标签的记忆此时一律不注入（fail-closed）。"))
    return rows.select(F.array_join(F.array_compact(F.concat(head, "lines", foot)), "\n").alias("text"))


def _field(name: str, cfg: Config, fallback: str) -> Column:
    text = _item(F.col(name).cast("string"), cfg, FIELD_TOKENS)
    return F.when(F.length(text) > 0, text).otherwise(fallback)


def attempt_line(cfg: Config = DEFAULTS) -> Column:
    """A line of the ring, over at, id, kind, origin, via, action, reason."""
    reason = _field("reason", cfg, "")
    parts = F.array(
        F.when(_field("id", cfg, "") == "", "（无 id）").otherwise(F.substring(_field("id", cfg, ""), 1, ID_CHARS)), _field("action", cfg, "（未知动作）"), F.concat(F.lit("via="), _field("via", cfg, "（无）")), F.concat(F.lit("origin="), _field("origin", cfg, "（未知）")),
        F.concat(F.lit("kind="), _field("kind", cfg, "（未知）")), stamp(F.col("at")), F.when(reason != "", F.concat(F.lit("原因："), reason)),
    )
    return F.concat(F.lit("  - "), F.array_join(F.array_compact(parts), " · "))


def _counts(rows: DataFrame, name: Column) -> dict[str, int]:
    return {r["k"]: r["n"] for r in rows.groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a fixed set of names


def audit_text(attempts: DataFrame, records: DataFrame, cfg: Config = DEFAULTS, current: str | None = None, verify: dict | None = None, limit: int = 20) -> DataFrame:
    """The latest attempts (at most 200), counts by action and way, the store's state, and what a check of shown lines found.

    attempts: the ring, at, id, kind, origin, via, action, reason; verify: checked, matched, missing, sample, gap, or None where
    nothing was checked, which is said as such.
    """
    spark = records.sparkSession
    most = audit_max(cfg)
    ring = attempts.orderBy(F.col("at").desc(), F.col("id").desc_nulls_last()).limit(max(0, min(int(most), max(1, min(200, int(limit))))))
    shown = [r["line"] for r in ring.select("at", "id", attempt_line(cfg).alias("line")).orderBy(F.col("at").desc(), F.col("id").desc_nulls_last()).collect()]  # 200 lines at most
    out = [f"[记忆审计 · 内存尝试环 {len(shown)} 条 · 容量 {most}]"]
    if not shown:
        out.append("最近尝试：本轮没有记录到被拒或入队的尝试。")
        if most <= 0:
            out.append(f"（auditMax={most}：审计环关闭，任何尝试都不记录；成功的写入仍由记录本身派生，见下方库内状态。）")
    else:
        out += ["最近尝试（新在前；成功的写入由记录本身派生，不在此列；内存环重启即失）：", *shown]
    by_action = _counts(ring.where(F.col("action").isin(*ACTIONS)), F.col("action"))
    out.append("按 action 计数：" + " · ".join(f"{a} {by_action.get(a, 0)}" for a in ACTIONS))
    by_via = _counts(ring, _field("via", cfg, "（无 via）"))
    out.append("按 via 计数：" + (" · ".join(f"{v} {n}" for v, n in sorted(by_via.items(), key=lambda x: (-x[1], x[0]))) if by_via else "（本轮没有尝试）"))
    state = records.agg(F.count(F.lit(1)).alias("n"), F.sum((F.size(sanitize(F.col("refs"))) > 0).cast("int")).alias("refs"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("active", "pending", "archived", "invalid")]).first()
    here = spark.range(1).select(normalize_branch(F.lit(current).cast("string"))).first()[0] or "unknown"
    out.append(f"库内状态：共 {state['n']} 条 · active {state['active']} · pending {state['pending']} · archived {state['archived']} · invalid {state['invalid']}（当前分支：{here}）。")
    share = math.floor(100 * (state["refs"] or 0) / state["n"] + 0.5) if state["n"] else 0
    out.append(f"来源引用：带 refs 的 {state['refs'] or 0} 条（占 {share}%）；成功写入/合并/失效/归档都由记录派生，重启后仍在。")
    out += verify_lines(verify)
    return spark.createDataFrame([("\n".join(out),)], "text string")


def verify_lines(verify: dict | None) -> list[str]:
    """What was checked, or that nothing was; a gap is never said to be a pass."""
    if verify is None:
        return ["--verify：未做核对 —— 本轮没有比对注入内容是否逐字出现在会话日志里；未核对不等于一致。"]
    checked, matched, missing = (int(verify.get(k) or 0) for k in ("checked", "matched", "missing"))
    if verify.get("gap"):
        return [f"--verify：无法核对 —— 原因：{verify['gap']}", f"  已尝试核对 {checked} 行（命中 {matched} · 缺失 {missing}）；缺口存在时不能把「没核对到」读成一致。"]
    first = f"--verify：核对 {checked} 行 · 命中 {matched} 行 · 缺失 {missing} 行（逐字 includes 判定，不做模糊匹配）。"
    if missing:
        return [first, f"  未命中样例：{verify.get('sample') or '（本次未提供样例）'}"]
    return [first, "  逐字核对通过：注入内容全部出现在会话日志里。" if checked else "  本会话日志里没有可比对的注入行（checked=0），因此这次核对没有结论。"]


def plan_text(made: Plan, records: DataFrame, cfg: Config = DEFAULTS, notes: tuple[str, ...] = ()) -> DataFrame:
    """A replay's plan before anything is written; each list is a page of the plan's own."""
    spark = records.sparkSession
    stats = made.stats.first()
    out = ["[记忆梳理稿 · 预览]", f"回看 {stats['sessions']} 个会话 · {stats['messages']} 条消息 · {stats['chars']} 字符；与库内指纹重复而跳过 {stats['duplicates']} 条。"]
    refs = format_refs(F.col("refs"))
    where = F.when(refs != "", F.concat(F.lit("会话 "), refs)).otherwise(F.concat(F.lit("会话 "), short(F.col("sessionId"))))
    parts = F.array_join(F.array_compact(F.array(F.col("origin"), where, stamp(F.col("at")))), " · ")
    added = made.backfill.select("at", "hash", F.concat(F.lit("  - "), _item(F.col("text"), cfg, cfg.max_item_tokens), F.lit("（"), parts, F.lit("）")).alias("line"))
    subject = lambda c: F.when(F.length(c) > 0, c).otherwise("(无主题)")
    text = records.select(F.col("id").alias("lead"), "subject", "text")
    groups = made.merges.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).join(text, "lead")
    groups = groups.select("lead", F.concat(F.lit("  - "), subject(F.col("subject")), F.lit("："), F.col("n").cast("string"), F.lit(" 条，保留 "), short(F.col("lead")), F.lit("「"), "text", F.lit("」")).alias("line"))
    lost = made.conflicts.join(records.select(F.col("id").alias("loser"), "subject"), "loser")
    lost = lost.select("winner", "loser", F.concat(F.lit("  - 保留 "), short(F.col("winner")), F.lit("，失效 "), short(F.col("loser")), F.lit("（"), subject(F.col("subject")), F.lit("）")).alias("line"))
    gists = made.gists.select("at", "key", F.concat(F.lit("  - "), "key", F.lit("："), "text").alias("line"))
    lists = [("补录", "条（按时间升序）", added, ["at", "hash"]), ("合并", "组", groups, ["lead"]), ("失效", "条", lost, ["winner", "loser"])]
    body = []
    for name, unit, rows, order in lists:
        rows = cut(spark, rows)  # counted and listed
        if n := rows.count():
            body += [f"{name} {n} {unit}：", *(r["line"] for r in rows.orderBy(*order).limit(PAGE).collect())]
    archive, gists = cut(spark, made.archive), cut(spark, gists)
    if n := archive.count():
        body.append(f"归档 {n} 条：" + "、".join(r["i"] for r in archive.orderBy("id").limit(5).select(short(F.col("id")).alias("i")).collect()) + (f" 等 {n} 条" if n > 5 else ""))
    if n := gists.count():
        body += [f"项目印象 {n} 条：", *(r["line"] for r in gists.orderBy(F.col("at").desc(), "key").limit(PAGE).collect())]
    out += body or ["无需改动：没有可补录的候选，也没有需要合并/失效/归档的条目。"]
    if stats["truncated"]:
        out.append(f"裁剪：补录候选超出上限，本次少补录 {stats['truncated']} 条（见下方说明）。")
    if notes:
        out += ["说明：", *(f"  - {n}" for n in notes)]
    out.append("以上为计划，未写入任何内容；确认后用 /sleep --apply 落盘（会先自动导出备份）。")
    return spark.createDataFrame([("\n".join(out),)], "text string")
