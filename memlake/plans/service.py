"""The store's operations as one object: what tools, commands and other programs call."""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config, write_policy
from memlake.functions.refs import refs_string
from memlake.functions.text import vector_key
from memlake.functions.vectors import finite
from memlake.operators import capture, filters, govern, inject, provenance, recall, render, replay, report
from memlake.operators import write as writing
from memlake.plans.lineage import cut
from memlake.schema import ranking
from memlake.sources import sessions as logs
from memlake.sources import store as files
from memlake.sources.store import Store

PROTOCOL = "1.3"
#: Seconds between two self-reports.
REPORT_SECONDS = 2.0
VECTORS = "vector_key string, vector array<double>"


class MemoryService:
    def __init__(self, spark: SparkSession, path: str, cfg: Config = DEFAULTS, clock: Callable[[], int] | None = None, branch: str | None = None):
        self.spark, self.cfg, self.store, self.branch = spark, cfg, Store(spark, path), branch
        self.clock = clock or (lambda: int(time.time() * 1000))
        self._embed: Callable[[DataFrame], DataFrame] | None = None
        self._embedder: dict[str, object] = {}
        self._last: dict[str, object] | None = None
        self.counters: Counter[str] = Counter()
        self._reported = float("-inf")

    # reading
    def capabilities(self) -> dict[str, object]:
        return {"protocol": PROTOCOL, "semantic": self._embed is not None, "branches": self.cfg.branch_aware, "write_policy": write_policy(self.cfg)}

    def visible(self, current: str | None = None) -> DataFrame:
        """Records of the current branch and of none, uses added up."""
        return self.store.with_usage().where(filters.branch_visible(current or self.branch, self.cfg))

    def list(self, status: str | None = None, kind: str | None = None, tag: str | None = None, branch: str | list[str] | None = None, current: str | None = None, limit: int | None = None) -> DataFrame:
        """Records in order of their ranking, with their references as text; a limit counts from one on."""
        rows = filters.recall_pool(self.visible(current), kind, None, tag, status=status).where(filters.branch_selected(branch, current or self.branch))
        rows = rows.orderBy(*ranking())
        rows = rows.limit(int(limit)) if limit is not None and limit >= 1 else rows
        return rows.withColumn("refs_text", refs_string(F.col("refs")))

    def recall(self, queries: DataFrame, mode: str = "query", kind: str | None = None, scope_level: str | None = None, tag: str | None = None, include_archived: bool = False, current: str | None = None, limit: int = 8) -> DataFrame:
        """The best records for each query (query_id, query); what a semantic search fell back to is in last_recall()."""
        pool = filters.recall_pool(self.visible(current), kind, scope_level, tag, include_archived)
        if mode not in ("semantic", "hybrid"):
            self._last = {"mode": mode, "used": False, "fallback": None, "candidates": None, "vectors": 0}
            return recall.recall(pool, queries, self.clock(), self.cfg, mode if mode == "memory" else "query", limit)
        pool = cut(self.spark, pool)
        queries = queries.withColumn("query_id", F.col("query_id").cast("string"))
        n = pool.count()
        keys = pool.select("id", vector_key(F.col("text"), F.col("subject"), F.col("tags")).alias("vector_key"), "text")
        none = F.lit(None).cast("string")
        asked = queries.select("query_id", vector_key(F.col("query"), none, F.lit(None).cast("array<string>")).alias("vector_key"), F.col("query").alias("text"))
        vectors, reason = self.vectors(keys.select("vector_key", "text").unionByName(asked.select("vector_key", "text")))
        if vectors is None:
            self._last = recall.diagnostics(mode, None, n, 0, reason)
            return recall.recall(pool, queries, self.clock(), self.cfg, "query", limit).select("query_id", "id", "score", "rank", F.lit(True).alias("fallback"))
        own = keys.join(vectors, "vector_key").select("id", "vector")
        theirs = asked.join(vectors, "vector_key").select("query_id", "vector")
        hits = cut(self.spark, recall.semantic(pool, own, queries, theirs, self.clock(), self.cfg, mode, limit))
        self._last = recall.diagnostics(mode, hits, n, own.count())
        return hits

    def last_recall(self) -> dict[str, object] | None:
        return self._last

    def explain(self, queries: DataFrame) -> DataFrame:
        return recall.explain(self.store.records().where(filters.active()), queries, self.cfg)

    def stats(self) -> DataFrame:
        return provenance.stats(self.store.records())

    def trace(self, session: str, seq: int | None = None) -> DataFrame:
        return provenance.trace(self.store.records(), session, seq)

    def verify(self, messages: DataFrame) -> DataFrame:
        return provenance.verify(self.store.records(), messages)

    def pending(self) -> DataFrame:
        return writing.pending(self.store.records())

    def pending_text(self) -> DataFrame:
        return report.pending_text(self.store.records(), self.cfg)

    def branch_text(self, current: str | None = None) -> DataFrame:
        return report.branch_text(self.store.records(), current or self.branch)

    def resident_text(self, workspace: str | None = None, current: str | None = None) -> DataFrame:
        return render.context_text(self.visible(current), self.cfg, workspace)

    def self_text(self) -> DataFrame:
        return render.self_text(self.store.records(), self.cfg)

    def turn(self, turns: DataFrame, lines: DataFrame, mode: str = "inject") -> inject.Injected:
        """One step of a batch of turns (query_id, sessionId, turn, query, workspace); its state is kept in the store."""
        state = lambda name, ddl: self.store.table(name, ddl)
        step = inject.inject(self.visible(), turns, lines, state("shown", "sessionId string, id string, last_turn bigint"), state("gates", inject.GATES), self.clock(), self.cfg, self.store.mark("selfIntroAsks"), state("asked", "sessionId string"), mode, self._rescorer(turns))
        if mode != "off":
            used = cut(self.spark, step.hits.select("id").distinct())
            self.store.replace("shown", cut(self.spark, step.last))
            self.store.mark_used(used, self.clock())
        if mode == "inject":
            self.store.replace("gates", cut(self.spark, step.gates))
            self.store.replace("asked", cut(self.spark, step.asked_sessions))
            self.store.set_mark("selfIntroAsks", step.asks)
        self.counters["turns"] += 1
        return step

    def _rescorer(self, turns: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
        """What puts a turn's candidates in the order of their vectors too, where that is asked for; without vectors nothing changes."""
        if self.cfg.embedder_recall_mode != "recall" or self._embed is None:
            return None

        def rescore(found: DataFrame) -> DataFrame:
            found, records = cut(self.spark, found), self.store.records()
            none = F.lit(None).cast("string")
            keys = records.join(found.select("id").distinct(), "id", "left_semi").select("id", vector_key(F.col("text"), F.col("subject"), F.col("tags")).alias("vector_key"), "text")
            asked = turns.select("query_id", vector_key(F.col("query"), none, F.lit(None).cast("array<string>")).alias("vector_key"), F.col("query").alias("text"))
            vectors, reason = self.vectors(keys.select("vector_key", "text").unionByName(asked.select("vector_key", "text")))
            n = found.count()
            self._last = recall.diagnostics("hybrid", None, n, 0 if vectors is None else n, reason)
            if vectors is None:
                return found
            out = recall.rescore(found.select("query_id", "id", "match", "score"), records, keys.join(vectors, "vector_key"), asked.join(vectors, "vector_key"), self.cfg)
            return out.join(found.select("query_id", "id", "kind", "text"), ["query_id", "id"])

        return rescore

    # vectors
    def set_embedder(self, embed: Callable[[DataFrame], DataFrame] | None, dimensions: int | None = None, timeout: float | None = None) -> None:
        """embed: (id, text) -> (id, vector). Vectors are kept by what they were made of, and made once.

        A batch with a vector that is missing, not finite or of another length than the others (or than `dimensions`) doesn't
        count at all; nor does one that takes longer than `timeout` seconds.
        """
        self._embed, self._embedder = embed, {"dimensions": dimensions, "timeout": timeout}

    def vectors(self, texts: DataFrame) -> tuple[DataFrame | None, str | None]:
        """(vector_key, vector) of texts (vector_key, text), or none and why: no-embedder, timeout, embed-error."""
        if self._embed is None:
            return None, "no-embedder"
        wanted = texts.groupBy("vector_key").agg(F.min("text").alias("text"))
        have = self.store.table("vectors", VECTORS).dropDuplicates(["vector_key"])
        missing = cut(self.spark, wanted.join(have.select("vector_key"), "vector_key", "left_anti"))
        n = missing.count()
        self.counters["embed_misses"] += n
        self.counters["embed_hits"] += wanted.count() - n
        if not n:
            return have, None
        self.counters["embed_calls"] += 1
        made = lambda: cut(self.spark, self._embed(missing.select(F.col("vector_key").alias("id"), "text")).select("id", F.col("vector").cast("array<double>").alias("vector")))
        workers = ThreadPoolExecutor(1)
        try:
            out = workers.submit(made).result(self._embedder["timeout"])
        except TooLate:
            self.counters.update(embed_errors=1, embed_timeouts=1)
            return None, "timeout"
        except Exception:  # noqa: BLE001 - a failing embedder must not fail the search
            self.counters["embed_errors"] += 1
            return None, "embed-error"
        finally:
            workers.shutdown(wait=False)
        row = out.agg(F.count_distinct("id").alias("n"), F.count(F.when(~finite(F.col("vector")), 1)).alias("bad"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
        size = self._embedder["dimensions"] or row["most"]
        if row["n"] != n or row["bad"] or row["least"] != size or row["most"] != size:
            self.counters["embed_errors"] += 1
            return None, "embed-error"
        self.store.add("vectors", out.select(F.col("id").alias("vector_key"), "vector"))
        return self.store.table("vectors", VECTORS).dropDuplicates(["vector_key"]), None

    # writing
    def write(self, incoming: DataFrame, lines: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
        """Write rows (input_id, arrival, kind, text, ...); returns each one's result once its batch has landed.

        events: what was said in the sessions of the rows; rows that the model proposes then count as the user's own where the last
        message of the user asked for them.
        """
        if events is not None:
            asked = logs.last_request(events).withColumnRenamed("origin", "asked")
            said = F.col("origin") if "origin" in incoming.columns else F.lit(None).cast("string")
            incoming = incoming.join(asked, "sessionId", "left").withColumn("origin", F.when(F.coalesce(said, F.lit("model_proposed")) == "model_proposed", F.coalesce("asked", F.lit("model_proposed"))).otherwise(said)).drop("asked")
        if not self.cfg.refs_enabled and "refs" in incoming.columns:
            incoming = incoming.drop("refs")
        versions, results = writing.write(self.store.records(), incoming, self.clock(), self.cfg, lines, self.store.rejected())
        versions, results = cut(self.spark, versions), cut(self.spark, results)
        self.store.append(versions)
        self.note(results.select("id", "outcome", "ok").join(versions.select("id", "kind", "origin", F.get("refs.via", F.lit(0)).alias("via")).dropDuplicates(["id"]), "id", "left"))
        self.counters["writes"] += 1
        return results.withColumn("persisted", F.col("ok"))

    def note(self, results: DataFrame) -> None:
        """Attempts that left no active record, in the audit's ring."""
        action = F.when(F.col("outcome") == "pending", "pending").when(~F.col("ok"), "rejected")
        rows = results.withColumn("action", action).where("action is not null")
        self.store.add("attempts", rows.select(F.lit(self.clock()).cast("long").alias("at"), "id", "kind", "origin", "via", "action", F.when(~F.col("ok"), F.col("outcome")).alias("reason")))

    def attempts(self) -> DataFrame:
        return self.store.table("attempts", "at bigint, id string, kind string, origin string, via string, action string, reason string")

    def audit_text(self, limit: int = 20, verify: dict | None = None) -> DataFrame:
        return report.audit_text(self.attempts(), self.store.records(), self.cfg, self.branch, verify, limit)

    def capture(self, messages: DataFrame) -> DataFrame:
        """Capture from messages (message_id, text); corrections take over the slot of the record they are about."""
        found = capture.inherit(capture.candidates(messages, self.cfg), self.store.records(), self.clock(), self.cfg)
        rows = found.select(F.concat_ws("#", F.col("message_id").cast("string"), F.col("place").cast("string")).alias("input_id"), F.col("place").alias("arrival"), F.lit(None).cast("string").alias("sessionId"), "kind", "origin", "confidence", "importance", "text", "subject", "field", "value")
        return self.write(cut(self.spark, rows))

    def solidify(self, events: DataFrame) -> DataFrame:
        """Write what compaction summaries among the events leave behind, with the intervals they stand for."""
        rows = capture.solidify(logs.compaction_texts(events), self.cfg)
        return self.write(cut(self.spark, rows.select(F.concat_ws("#", "message_id", F.col("place").cast("string")).alias("input_id"), F.col("place").alias("arrival"), "sessionId", "kind", "origin", "text", "refs")))

    def forget(self, ids: DataFrame) -> None:
        """Delete records; what waits for approval must be decided on instead."""
        gone = cut(self.spark, self.store.records().where(F.col("status") != "pending").join(ids.select("id").distinct(), "id", "left_semi"))
        self.counters["deleted"] += gone.count()
        self.store.delete(gone)

    def matching(self, query: str) -> DataFrame:
        """At most 20 records that match a query closely; the branch doesn't matter here."""
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return cut(self.spark, recall.recall(self.store.records().where(filters.active()), asked, self.clock(), self.cfg, "query", 20, min_match=0.6))

    def forget_matching(self, query: str) -> DataFrame:
        hits = self.matching(query)
        self.forget(hits)
        return hits

    def clear(self, **which) -> None:
        self.store.delete(cut(self.spark, self.store.records().where(filters.clear_selected(**which))))

    def approve(self, ids: DataFrame) -> None:
        self.store.append(cut(self.spark, writing.approve(self.store.records(), ids, self.clock(), self.cfg)))

    def reject(self, ids: DataFrame) -> None:
        versions, hashes = writing.reject(self.store.records(), ids, self.clock())
        versions, hashes = cut(self.spark, versions), cut(self.spark, hashes)
        self.store.append(versions)
        self.store.reject(hashes)

    def restore(self, ids: DataFrame) -> None:
        self.store.append(cut(self.spark, writing.restore(self.store.records(), ids, self.clock())))

    def set_status(self, ids: DataFrame, status: str) -> None:
        self.store.append(cut(self.spark, writing.set_status(self.store.records(), ids, status, self.clock())))

    def confirm(self, ids: DataFrame) -> None:
        self.store.append(cut(self.spark, writing.confirm(self.store.records(), ids, self.clock())))

    def refresh(self, ids: DataFrame) -> None:
        """Observed now, so that decay begins again; what waits for approval is left alone."""
        rows = self.store.records().where(F.col("status") != "pending").join(ids.select("id").distinct(), "id", "left_semi")
        self.store.append(cut(self.spark, rows.withColumn("observedAt", F.lit(self.clock()).cast("long"))))

    def pin(self, ids: DataFrame, on: bool = True) -> None:
        self.store.append(cut(self.spark, writing.pin(self.store.records(), ids, on)))

    def consolidate(self, force: bool = True) -> bool:
        """Tidy the store, unless it was done within the interval; only changed records get a new version."""
        now = self.clock()
        if not force and now - self.store.mark("lastConsolidatedAt") < self.cfg.consolidate_interval_minutes * 60_000:
            return False
        before = self.store.with_usage()
        after = govern.consolidate(before, now, self.cfg)
        key = F.xxhash64(F.to_json(F.struct(*before.columns)))
        changed = after.withColumn("_k", key).join(self.store.records().select("id", key.alias("_k")), ["id", "_k"], "left_anti").drop("_k")
        self.store.append(cut(self.spark, changed))
        self.store.set_mark("lastConsolidatedAt", now)
        self.counters["consolidations"] += 1
        return True

    def consolidate_every(self, checkpoint: str, minutes: float | None = None):
        """Start the query that tidies the store once in an interval; one that is overdue is caught up with at once."""
        self.consolidate(force=False)
        every = self.cfg.consolidate_interval_minutes if minutes is None else minutes
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda *_: self.consolidate(force=False)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(every * 60))} seconds").start()

    def sleep(self, sessions: DataFrame, events: DataFrame, apply: bool = False, backup: str | None = None, n: int | None = None, cwd: str | None = None) -> replay.Plan:
        """Plan a replay of the newest sessions (of a folder, if it has some); applying it exports a backup first."""
        now = self.clock()
        made = replay.plan(self.store.records(), logs.newest(sessions, self.cfg.sleep_sessions if n is None else n, cwd), events, now, self.cfg)
        if apply:
            if backup is None:
                raise ValueError("applying a plan needs a folder for the backup")
            files.export(self.store.records(), backup, now)
            before = self.store.records()
            after = replay.apply(before, made, now, self.cfg)
            key = F.xxhash64(F.to_json(F.struct(*before.columns)))
            changed = after.withColumn("_k", key).join(before.select("id", key.alias("_k")), ["id", "_k"], "left_anti").drop("_k")
            self.store.append(cut(self.spark, changed))
            self.store.set_mark("lastSleepAt", now)
        return made

    def plan_text(self, made: replay.Plan) -> DataFrame:
        return report.plan_text(made, self.store.records(), self.cfg)

    def export(self, path: str) -> None:
        files.export(self.store.records(), path, self.clock())

    def import_(self, rows: DataFrame) -> DataFrame:
        made, counts = files.import_records(rows, self.clock(), self.cfg)
        counts = cut(self.spark, counts)
        incoming = made.withColumn("input_id", F.col("id")).withColumn("arrival", F.col("observedAt")).withColumn("sessionId", F.lit(None).cast("string"))
        self.store.append(cut(self.spark, writing.merge_by_hash(self.store.records(), incoming, self.cfg).drop("created", "n")))
        return counts

    # about itself
    def report(self) -> dict[str, object]:
        """What the service has done and what the store holds: numbers only, in JSON's types."""
        by: dict[str, int] = {}
        for r in self.store.records().groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect():
            by[r["status"]] = r["n"]
        names = ("lastConsolidatedAt", "lastSleepAt", "selfIntroAsks")
        audit = {r["action"]: r["n"] for r in provenance.action_counts(provenance.ring(self.attempts(), self.cfg)).collect()}
        return {
            "protocol": PROTOCOL, "at": self.clock(), "records": sum(by.values()), "status": by, "counters": dict(self.counters), "marks": {n: self.store.mark(n) for n in names},
            "audit": audit, "refs": provenance.refs_ratio(self.store.records()).first().asDict(), "last_recall": self._last, "branch": self.branch,
        }

    def write_report(self, path: str) -> bool:
        """Write the report as a JSON document beside others, not more often than every few seconds; it never fails its caller."""
        if time.monotonic() - self._reported < REPORT_SECONDS:
            return False
        self._reported = time.monotonic()
        try:
            self.spark.createDataFrame([(json.dumps(self.report()),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        except Exception:  # noqa: BLE001
            return False
        return True
