"""Streams of session events: turns closed by a marker, exact quotas and cooldowns, capture into a store.

State is kept by session or key; queries that run on let idle state expire, so that it doesn't grow with the stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.config import DEFAULTS, Config
from memlake.operators.capture import SIGNALS, candidates
from memlake.sources.sessions import message, real_user

#: A turn that starts so long after the last one closed begins with an empty buffer.
STALE_MS = 600_000
TURN = "sessionId string, turn bigint, closed_seq bigint, closed_at bigint, text string, n_messages int"


def _timeout(expire: bool) -> str:
    """Expiring state needs a query that runs on: with a trigger of availableNow Spark would wait for time-outs for ever."""
    return GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout


def _turns(expire: bool):
    return lambda key, batches, state: _turn_step(key, batches, state, expire)


def _turn_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expire: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turn, closed_at, texts = state.get if state.exists else (0, None, [])
    texts, out = list(texts), []
    rows = pd.concat(list(batches)).sort_values(["seq", "time"], na_position="last", kind="stable")
    for row in rows.itertuples(index=False):
        if row.type == "turn/start":
            if closed_at is None or row.time - closed_at > STALE_MS:
                texts = texts if closed_at is None else []
        elif row.type == "turn/end":
            turn += 1
            out.append((key[0], turn, row.seq, row.time, "\n".join(texts), len(texts)))
            texts, closed_at = [], int(row.time)
        elif row.user and row.text:
            texts.append(row.text)
    state.update((turn, closed_at, texts))
    if expire:
        state.setTimeoutDuration(86_400_000)
    yield pd.DataFrame(out, columns=["sessionId", "turn", "closed_seq", "closed_at", "text", "n_messages"])


def turns(events: DataFrame, expire: bool = False) -> DataFrame:
    """A row for each turn that a `turn/end` closes, with the real user's texts since the one before.

    expire: forget sessions that are idle for a day (only for queries that run on).
    """
    m = message(F.col("data"))
    rows = events.withColumn("m", m).select("sessionId", "type", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("time", F.lit(0)).alias("time"), F.coalesce("m.role", F.lit("user")).alias("role"), F.col("m.source").alias("source"), F.coalesce("m.text", F.lit("")).alias("text"))
    rows = rows.withColumn("user", (F.col("type") == "user/message") & real_user()).select("sessionId", "type", "seq", "time", "user", "text")
    return rows.groupBy("sessionId").applyInPandasWithState(_turns(expire), TURN, "turn bigint, closed_at bigint, texts array<string>", "append", _timeout(expire))


def turn_candidates(closed: DataFrame, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> DataFrame:
    """Candidates of closed turns (a micro-batch)."""
    rows = closed.withColumn("message_id", F.concat_ws("#", "sessionId", F.col("turn").cast("string")))
    return candidates(rows.select("message_id", "sessionId", "turn", "closed_seq", "closed_at", "text"), cfg, signals)


def capture_batch(store, stream: str, batch: DataFrame, number: int, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> None:
    """Write the candidates of a stream's micro-batch into a store, once.

    The batch has a name of its own in the log, so that it can't replace another writer's. One that has landed is skipped when it
    comes again; one that was broken off is judged against the store without it and replaces itself.
    """
    from memlake.operators.write import write
    from memlake.plans.lineage import cut

    name, mark = f"stream-{stream}-{number}", f"stream:{stream}"
    if store.mark(mark) > number:
        return
    found = turn_candidates(batch, cfg, signals)
    rows = found.select(F.concat_ws("#", "message_id", F.col("place").cast("string")).alias("input_id"), F.col("closed_at").alias("arrival"), "sessionId", "kind", "origin", "confidence", "importance", "text", F.array("signal").alias("tags"), F.col("closed_at").alias("observedAt"))
    rows = cut(batch.sparkSession, rows)
    if rows.take(1):
        versions, _ = write(store.records(without=name), rows, 0, cfg, rejected=store.rejected())
        store.append(cut(batch.sparkSession, versions), name)
    store.set_mark(mark, number + 1)


def capture_into(store, closed: DataFrame, checkpoint: str, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS, stream: str | None = None):
    """Start the query that writes closed turns' candidates into a store; a stream is known by its name, else by its checkpoint."""
    name = stream or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        capture_batch(store, name, batch, number, cfg, signals)

    return closed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Events that a store remembers of a stream.
RECENT = 30
SEEN = "sessionId string, last_seq bigint, turn_start bigint"


def observe_batch(store, events: DataFrame, number: int, stream: str = "events") -> None:
    """Note a micro-batch of events: each session's last number and last turn, and the latest events of all.

    What is wrong with a batch is noted beside (table `faults`), and never ends the stream. A batch that comes again changes nothing.
    """
    from memlake.operators.provenance import last_per_session
    from memlake.plans.lineage import cut

    spark, mark = events.sparkSession, f"observed:{stream}"
    if store.mark(mark) > number:
        return
    try:
        both = store.table("seen", SEEN).unionByName(last_per_session(events))
        seen = both.where("sessionId is not null").groupBy("sessionId").agg(F.max("last_seq").alias("last_seq"), F.max("turn_start").alias("turn_start"))
        few = events.select("sessionId", "type", "seq", "time").orderBy(F.col("time").desc_nulls_last(), F.col("seq").desc_nulls_last()).limit(RECENT)
        recent = store.table("recent", "sessionId string, type string, seq bigint, time bigint").unionByName(few).orderBy(F.col("time").desc_nulls_last(), F.col("seq").desc_nulls_last()).limit(RECENT)
        seen, recent = cut(spark, seen), cut(spark, recent)
        store.replace("seen", seen)
        store.replace("recent", recent)
    except Exception as fault:  # noqa: BLE001
        store.add("faults", spark.createDataFrame([(stream, number, f"{type(fault).__name__}: {fault}"[:500])], "stream string, batch bigint, fault string"))
    store.set_mark(mark, number + 1)


def observe(store, events: DataFrame, checkpoint: str, stream: str = "events"):
    """Start the query that notes a stream of events in a store."""
    return events.writeStream.foreachBatch(lambda batch, number: observe_batch(store, batch, number, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _quota(limit: int, window_ms: int, gap_ms: int, expire: bool = False):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, hashes, seen = (list(x) for x in state.get) if state.exists else ([], [], [])
        last = dict(zip(hashes, seen, strict=True))
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            times = [t for t in times if t > row.at - window_ms]
            reason = "over-hour-quota" if len(times) >= limit else "throttled" if row.hash in last and row.at - last[row.hash] < gap_ms else None
            if reason is None:
                times.append(int(row.at))
                last[row.hash] = int(row.at)
            out.append((key[0], row.id, row.hash, int(row.at), reason is None, reason))
        newest = max((int(t) for t in rows["at"]), default=0)
        last = {h: t for h, t in last.items() if t > newest - gap_ms}
        state.update((times, list(last), list(last.values())))
        if expire:
            state.setTimeoutDuration(max(window_ms, gap_ms))
        yield pd.DataFrame(out, columns=["key", "id", "hash", "at", "accepted", "reason"])

    return step


def quotas(writes: DataFrame, per_hour: int = 20, hour_ms: int = 3_600_000, gap_ms: int = 86_400_000, expire: bool = False) -> DataFrame:
    """Which writes (key, id, hash, at) a key may do: so many accepted ones an hour, a fingerprint once in a day."""
    return writes.select("key", "id", "hash", "at").groupBy("key").applyInPandasWithState(_quota(per_hour, hour_ms, gap_ms, expire), "key string, id string, hash string, at bigint, accepted boolean, reason string", "times array<bigint>, hashes array<string>, seen array<bigint>", "append", _timeout(expire))


def batch_quotas(writes: DataFrame, per_hour: int = 20, hour_ms: int = 3_600_000, gap_ms: int = 86_400_000) -> DataFrame:
    """The same over a table: a fold over each key's writes in order."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        class Once:
            exists, hasTimedOut = False, False
            update = setTimeoutDuration = staticmethod(lambda *_: None)

        return pd.concat(list(_quota(per_hour, hour_ms, gap_ms)((rows["key"].iloc[0],), iter([rows]), Once())))

    return writes.select("key", "id", "hash", "at").groupBy("key").applyInPandas(fold, "key string, id string, hash string, at bigint, accepted boolean, reason string")


def _cooldown(turns_apart: int, expire: bool):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -999
        out = []
        for row in pd.concat(list(batches)).sort_values("turn", kind="stable").itertuples(index=False):
            ok = row.turn - last >= turns_apart
            last = row.turn if ok else last
            out.append((key[0], key[1], int(row.turn), bool(ok)))
        state.update((int(last),))
        if expire:
            state.setTimeoutDuration(7 * 86_400_000)
        yield pd.DataFrame(out, columns=["sessionId", "id", "turn", "inject"])

    return step


def cooldown(hits: DataFrame, turns_apart: int = 3, expire: bool = False) -> DataFrame:
    """Whether each hit (sessionId, id, turn) may be shown: not within so many turns of the last time it was."""
    return hits.select("sessionId", "id", "turn").groupBy("sessionId", "id").applyInPandasWithState(_cooldown(turns_apart, expire), "sessionId string, id string, turn bigint, inject boolean", "last bigint", "append", _timeout(expire))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Events in tumbling windows, late ones within the watermark included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def distinct_writes(writes: DataFrame, ts: str = "ts", keep: str = "24 hours") -> DataFrame:
    """Writes without repeats of a fingerprint within the watermark; state goes with it."""
    return writes.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["hash"])
