"""Replaying whole sessions: transcripts within budgets, and the plan of what to add, merge, resolve, archive and summarise."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config, budget, cap
from memlake.functions.safety import explicit_request, mask_pii, render_equivalent
from memlake.functions.text import MARKERS, clamp_text, derive_subject, gist_text, markers, normalize_text, record_hash, workspace_key
from memlake.operators.capture import SIGNALS, candidates
from memlake.operators.govern import archivable, conflicts, merge_groups
from memlake.schema import default_scope, user_side
from memlake.sources.sessions import messages, real_user, subagent



def fit_newest(groups: Column, limit: float) -> Column:
    """Of groups in order of time (chars, user_chars, n_context): how each is kept, from the newest back.

    2: with its context, 1: the user's message alone, 0: not. The first group of which not even the message fits ends it.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, g: Column) -> Column:
        whole = ~acc["over"] & (acc["used"] + g["chars"] <= limit)
        alone = ~acc["over"] & ~whole & (acc["used"] + g["user_chars"] <= limit)
        used = F.when(whole, acc["used"] + g["chars"]).when(alone, acc["used"] + g["user_chars"]).otherwise(acc["used"])
        keep = F.when(whole, 2).when(alone, 1).otherwise(0)
        return F.struct(used.cast("long").alias("used"), (acc["over"] | (keep == 0)).alias("over"), F.array_append(acc["kept"], keep.cast("int")).alias("kept"))

    return F.reverse(F.aggregate(F.reverse(groups), start, step, lambda acc: acc["kept"]))


def fit_sessions(listed: DataFrame, total: float) -> DataFrame:
    """(sessionId) of the sessions (sessionId, createdAt, size) that a budget holds, from the newest: one that doesn't fit is left out.

    An ordered pass over a row for each session: they stream through one task, which holds a number.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0
        for batch in batches:
            keep = []
            for size in batch.column("size").to_pylist():
                keep.append(used + size <= total)
                used += size if keep[-1] else 0
            yield pa.RecordBatch.from_arrays([batch.column("sessionId").filter(pa.array(keep, pa.bool_()))], names=["sessionId"])

    return listed.repartition(1).sortWithinPartitions(F.col("createdAt").desc(), "sessionId").mapInArrow(fold, "sessionId string")


def transcripts(sessions: DataFrame, events: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Messages kept of each session: sessionId, cwd, createdAt, pos, seq, time, role, text, dropped.

    A user's message takes along the last few assistant texts since the one before. Sessions of sub-agents don't count. A
    session has a budget of characters, filled from its newest message; all sessions have one, filled from the newest session,
    where one that doesn't fit is left out and the next is tried.
    """
    total = budget(cfg.sleep_max_chars_total, DEFAULTS.sleep_max_chars_total)
    limit = min(budget(cfg.sleep_max_chars_per_session, DEFAULTS.sleep_max_chars_per_session), total)
    context = cap(cfg.sleep_assistant_context, DEFAULTS.sleep_assistant_context)
    own = sessions.where(~subagent()).select("sessionId", "cwd", F.coalesce("createdAt", F.lit(0)).alias("createdAt"))
    rows = messages(events).join(own.select("sessionId"), "sessionId", "left_semi")
    rows = rows.where(real_user() | (F.col("role") == "assistant")).withColumn("text", clamp_text(F.col("text"), limit / 2.5, 2.5)).where(F.col("text") != "")
    order = Window.partitionBy("sessionId").orderBy(F.col("seq").asc_nulls_last(), F.col("time").asc_nulls_last(), "role", "text")
    is_user = F.col("role") == "user"
    # a group is a user's message and what the assistant said since the one before
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("group", F.sum(is_user.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - is_user.cast("int"))
    inside = Window.partitionBy("sessionId", "group", "role").orderBy(F.col("pos").desc())
    rows = rows.withColumn("back", F.row_number().over(inside)).where(is_user | (F.col("back") <= (context if math.isfinite(context) else 1 << 30)))
    grouped = rows.groupBy("sessionId", "group").agg(
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.when(is_user, F.length("text")).otherwise(0)).alias("user_chars"),
        F.sum((~is_user).cast("int")).alias("n_context"),
        F.max(is_user.cast("int")).alias("has_user"),
    ).where("has_user = 1")
    per = grouped.groupBy("sessionId").agg(F.array_sort(F.collect_list(F.struct("group", "chars", "user_chars", "n_context"))).alias("groups"))
    per = per.withColumn("kept", fit_newest(F.col("groups"), float(limit)))
    chosen = per.select("sessionId", F.explode(F.arrays_zip("groups", "kept")).alias("z")).select("sessionId", "z.groups.*", F.col("z.kept").alias("kept"))
    totals = chosen.groupBy("sessionId").agg(F.sum(F.when(F.col("kept") == 2, F.col("chars")).when(F.col("kept") == 1, F.col("user_chars")).otherwise(0)).alias("size"), F.sum(F.when(F.col("kept") == 2, 0).when(F.col("kept") == 1, F.col("n_context")).otherwise(1 + F.col("n_context"))).alias("dropped"))
    # sessions that are replayed are a stated few, but their number is not relied on: those that can't fit alone are left out first
    listed = totals.join(own, "sessionId").where((F.col("size") > 0) & (F.col("size") <= total)).select("sessionId", "createdAt", "size")
    within = fit_sessions(listed, float(total))
    out = rows.join(chosen.where("kept > 0").select("sessionId", "group", "kept"), ["sessionId", "group"]).where((F.col("kept") == 2) | is_user).join(within, "sessionId", "left_semi")
    return out.join(own, "sessionId").join(totals.select("sessionId", "dropped"), "sessionId").select("sessionId", "cwd", "createdAt", "pos", "seq", "time", "role", "text", "dropped")


@dataclass(frozen=True)
class Plan:
    """What a replay would do; nothing is written before apply()."""

    backfill: DataFrame
    merges: DataFrame
    conflicts: DataFrame
    archive: DataFrame
    gists: DataFrame
    stats: DataFrame


def backfill(transcript: DataFrame, records: DataFrame, now: int, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> DataFrame:
    """Explicit requests of the transcript that no record has yet, and whether each is a duplicate.

    Only user messages with an explicit request count, only candidates of that origin, never the self portrait. A fingerprint
    that any record of whatever status has, or that came before, is a duplicate.
    """
    asked = transcript.where((F.col("role") == "user") & explicit_request(F.col("text")))
    asked = asked.withColumn("message_id", F.concat_ws("#", "sessionId", F.col("pos").cast("string")))
    found = candidates(asked.select("message_id", "sessionId", "cwd", "createdAt", "pos", "seq", "time", "text"), cfg, signals)
    found = found.where((F.col("kind") != "agent_self") & (F.col("origin") == "user_explicit"))
    level = default_scope(F.col("kind"))
    key = F.when(level == "workspace", F.coalesce(workspace_key(F.col("cwd")), F.lit("*"))).otherwise("*")
    found = found.withColumn("scope", F.struct(level.alias("level"), key.alias("key"))).withColumn("subject", derive_subject(F.col("text"), F.col("signal")))
    view = render_equivalent(F.col("text"))
    limit = budget(cfg.sleep_max_chars_per_session, DEFAULTS.sleep_max_chars_per_session)
    found = found.withColumn("text", clamp_text(mask_pii(F.col("text"), view), limit / 2.5, 2.5)).where(F.col("text") != "")
    found = found.withColumn("hash", record_hash(F.col("kind"), F.col("scope.level"), F.col("scope.key"), F.col("subject"), F.col("text")))
    at = F.coalesce("time", "createdAt")
    found = found.withColumn("at", at).withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(F.col("createdAt").desc(), "sessionId", "pos", "place")))
    known = records.select("hash").distinct().withColumn("known", F.lit(True))
    found = found.join(known, "hash", "left").withColumn("duplicate", F.coalesce("known", F.lit(False)) | (F.col("n") > 1))
    refs = F.when(F.col("seq").isNotNull(), F.array(F.struct(F.col("sessionId"), F.col("seq").alias("from"), F.lit(None).cast("long").alias("to"), F.lit("sleep").alias("via"))))
    return found.select("hash", "kind", "origin", "confidence", "importance", "scope", "subject", "text", "sessionId", "at", refs.alias("refs"), "duplicate")


def newest(found: DataFrame, most: float) -> DataFrame:
    fresh = found.where(~F.col("duplicate")).drop("duplicate")
    if not most:
        return fresh.limit(0)
    rows = fresh.orderBy(F.col("at").desc(), F.col("sessionId").desc(), F.col("hash").desc())
    return rows.limit(int(most)) if math.isfinite(most) else rows


def gists(transcript: DataFrame, records: DataFrame, cfg: Config = DEFAULTS, table: list[tuple[str, str]] = MARKERS) -> DataFrame:
    """A project's impression from the markers in its sessions, if it is new: key, text, at; the latest first."""
    rows = transcript.withColumn("key", workspace_key(F.col("cwd"))).where("key is not null").select("key", "createdAt", F.explode_outer(markers(F.col("text"), table)).alias("m"))
    order = F.array(*[F.lit(name) for name, _ in table])
    grouped = rows.groupBy("key").agg(F.collect_set("m").alias("m"), F.max("createdAt").alias("at")).where(F.size("m") >= int(cap(cfg.gist_min_markers, DEFAULTS.gist_min_markers)))
    text = clamp_text(gist_text(F.filter(order, lambda x: F.array_contains(F.col("m"), x))), cfg.max_item_tokens, cfg.chars_per_token)
    out = grouped.select("key", text.alias("text"), "at").where(F.col("text") != "")
    same = records.where((F.col("status") == "active") & (F.col("kind") == "project_gist") & (F.col("scope.level") == "workspace") & (F.col("subject") == "project.overview")).select(F.col("scope.key").alias("key"), "text")
    most = cap(cfg.sleep_max_gists, DEFAULTS.sleep_max_gists)
    out = out.join(same, ["key", "text"], "left_anti").orderBy(F.col("at").desc(), "key")
    return out.limit(int(most)) if math.isfinite(most) else out


def plan(records: DataFrame, sessions: DataFrame, events: DataFrame, now: int, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> Plan:
    """A pure function of records and sessions."""
    script = transcripts(sessions, events, cfg)
    found = backfill(script, records, now, cfg, signals)
    most = cap(cfg.sleep_max_backfill, DEFAULTS.sleep_max_backfill)
    added = newest(found, most)
    pins = records.where("pinned").select("id")
    groups = merge_groups(records, cfg)
    frozen = groups.join(pins, "id", "left_semi").select("lead").distinct()
    merges = groups.join(frozen, "lead", "left_anti")
    sides = records.select("id", "kind", "origin", "pinned")
    lost = sides.select(F.col("id").alias("loser"), F.col("kind").alias("k"), F.col("origin").alias("o"), F.col("pinned").alias("p"))
    settled = conflicts(records).join(lost, "loser").where((F.col("k") != "agent_self") & ~F.col("blocked") & ~user_side(F.col("o")) & ~F.col("p")).select("winner", "loser")
    archive = records.where(archivable(now, cfg)).select("id")
    counts = script.agg(F.count_distinct("sessionId").alias("sessions"), F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    dups = found.agg(F.coalesce(F.sum(F.col("duplicate").cast("int")), F.lit(0)).alias("duplicates"), F.coalesce(F.sum((~F.col("duplicate")).cast("int")), F.lit(0)).alias("fresh"))
    left = F.greatest(F.lit(0), F.col("fresh") - most) if math.isfinite(most) else F.lit(0)
    stats = counts.crossJoin(dups).select("sessions", "messages", "chars", "duplicates", left.cast("long").alias("truncated"))  # one row each
    return Plan(added, merges, settled, archive, gists(script, records, cfg), stats)


def present(found: DataFrame, records: DataFrame) -> DataFrame:
    """Those of found (hash, scope, text) that the store has, whatever their status: by fingerprint, or by scope and plain text."""
    same = ["level", "key", "plain"]
    words = lambda df: df.withColumns({"level": F.col("scope.level"), "key": F.col("scope.key"), "plain": normalize_text(F.col("text"))})
    by_hash = found.join(records.select("hash").distinct(), "hash", "left_semi").select("hash")
    by_text = words(found).join(words(records).select(*same).distinct(), same, "left_semi").select("hash")
    return found.join(by_hash.unionByName(by_text).distinct(), "hash", "left_semi")


def apply(records: DataFrame, made: Plan, now: int, cfg: Config = DEFAULTS) -> DataFrame:
    """Records after a plan: what it adds, merges, resolves and archives, and the projects' impressions.

    Applying a plan again adds nothing: what the store has by then is left out, and a project's impression is renewed in place.
    """
    from memlake.operators.govern import apply_conflicts, apply_merges
    from memlake.schema import make_records

    out = apply_merges(records, made.merges, cfg.consolidate_max_records)
    out = apply_conflicts(out, made.conflicts.withColumn("blocked", F.lit(False)), now)
    old = made.archive.select("id", F.lit(True).alias("old"))
    out = out.join(old, "id", "left").withColumn("status", F.when(F.col("old") & (F.col("status") == "active"), "archived").otherwise(F.col("status"))).select(*records.columns)
    fresh = made.backfill.join(present(made.backfill, records).select("hash"), "hash", "left_anti")
    added = make_records(fresh.drop("hash").withColumnRenamed("at", "observedAt"), now)
    # a project's impression: the first active one is renewed, others go, and where there is none it is new
    mine = (F.col("kind") == "project_gist") & (F.col("subject") == "project.overview") & (F.col("status") == "active") & (F.col("scope.level") == "workspace")
    firsts = out.where(mine).groupBy(F.col("scope.key").alias("gist_key")).agg(F.min("id").alias("first"))
    known = firsts.join(made.gists.select(F.col("key").alias("gist_key"), F.col("text").alias("new_text")), "gist_key")
    out = out.withColumn("gist_key", F.when(mine, F.col("scope.key"))).join(known, "gist_key", "left")
    renewed = F.col("new_text").isNotNull() & (F.col("id") == F.col("first"))
    hashed = record_hash(F.col("kind"), F.col("scope.level"), F.col("scope.key"), F.col("subject"), F.col("new_text"), F.col("branch"))
    out = out.withColumns({
        "hash": F.when(renewed, hashed).otherwise(F.col("hash")),
        "observedAt": F.when(renewed, F.lit(now).cast("long")).otherwise(F.col("observedAt")),
        "status": F.when(F.col("new_text").isNotNull() & ~renewed, "archived").otherwise(F.col("status")),
        "text": F.when(renewed, F.col("new_text")).otherwise(F.col("text")),
    }).select(*records.columns)
    first = made.gists.join(firsts.select(F.col("gist_key").alias("key")), "key", "left_anti")
    first = first.select(F.lit("project_gist").alias("kind"), F.lit("gist").alias("precision"), F.lit("observed").alias("origin"), F.struct(F.lit("workspace").alias("level"), "key").alias("scope"), F.lit("project.overview").alias("subject"), "text")
    return out.unionByName(added.select(*records.columns)).unionByName(make_records(first, now).select(*records.columns))
