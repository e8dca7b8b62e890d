"""Where records come from: interval joins of references with events, traces, audits of what was shown, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config, audit_max
from memlake.functions.refs import sanitize
from memlake.functions.text import normalize_branch, token_set

#: Bytes of lines that are looked for in one pass.
BLOCK_BYTES = 4 << 20
#: The attempts that an audit counts.
ACTIONS = ("created", "merged", "pending", "approved", "rejected-pending", "rejected", "invalidated", "archived", "forgotten")


def inside(start: Column, end: Column, seq: Column) -> Column:
    """Only a start is a point, only an end reaches back to the beginning, none is the whole session."""
    return F.when(start.isNull() & end.isNull(), True).when(end.isNull(), seq == start).when(start.isNull(), seq <= end).otherwise((seq >= start) & (seq <= end))


def referenced(records: DataFrame) -> DataFrame:
    """(id, sessionId, from, to, via) of every reference."""
    return records.select("id", F.explode(sanitize(F.col("refs"))).alias("r")).select("id", "r.*")


def verify(records: DataFrame, messages: DataFrame) -> DataFrame:
    """How much of each record's text its references hold: id, sessionId, from, to, events, coverage.

    A range join: equal sessions, sequence numbers between the ends. Messages: sessionId, seq, text.
    """
    refs = referenced(records).join(records.select("id", token_set(F.col("text")).alias("tokens")), "id")
    rows = refs.join(messages.select(F.col("sessionId").alias("s"), "seq", token_set(F.col("text")).alias("said")), (F.col("sessionId") == F.col("s")) & inside(F.col("from"), F.col("to"), F.col("seq")), "left")
    grouped = rows.groupBy("id", "sessionId", "from", "to").agg(F.count("seq").alias("events"), F.array_distinct(F.flatten(F.collect_list(F.array_intersect("tokens", "said")))).alias("seen"), F.first("tokens").alias("tokens"))
    cover = F.when(F.size("tokens") > 0, F.size("seen") / F.size("tokens")).otherwise(0.0)
    return grouped.select("id", "sessionId", "from", "to", "events", cover.alias("coverage"))


def trace(records: DataFrame, session: str, seq: int | None = None) -> DataFrame:
    """Records that refer to a session (whole id or a beginning of it, or of what follows its first dash) and an event."""
    refs = referenced(records)
    after = F.regexp_replace("sessionId", "^[^-]*-", "")
    named = refs.where(F.startswith("sessionId", F.lit(session)) | F.startswith(after, F.lit(session)))
    which = [r[0] for r in named.select("sessionId").distinct().limit(2).collect()]
    if len(which) > 1 and session not in which:
        raise LookupError("several sessions begin with this")
    if seq is not None:
        named = named.where(inside(F.col("from"), F.col("to"), F.lit(seq)))
    return named.join(records.select("id", "kind", "status", "text"), "id")


def blocks(lines: DataFrame) -> Iterator[list[str]]:
    """Different lines in blocks of at most BLOCK_BYTES bytes (or one longer line)."""
    held, size = [], 0
    for row in lines.where(F.length("line") > 0).select("line").distinct().orderBy("line").toLocalIterator():
        n = len(row["line"].encode())
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(row["line"])
        size += n
    if held:
        yield held


def holders(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line): which texts (id, text) hold which lines (line), word for word.

    One automaton of all lines of a block passes over each text once, so the work grows with the texts and not with their product
    with the lines; lines travel in blocks of bounded size.
    """
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.sparkSession.createDataFrame([], f"id {kind}, line string")
    for block in blocks(lines):

        def find(batches: Iterator[pa.RecordBatch], block: list[str] = block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for line in block:
                automaton.add_word(line, line)
            automaton.make_automaton()
            for batch in batches:
                found = [sorted({line for _, line in automaton.iter(t)}) if t else [] for t in batch.column("text").to_pylist()]
                owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), pa.array([x for f in found for x in f], pa.string())], names=["id", "line"])

        out = out.unionByName(texts.select("id", "text").mapInArrow(find, f"id {kind}, line string"))
    return out


def shown(lines: DataFrame, logs: DataFrame) -> DataFrame:
    """Whether each line (line) stands in some log text (text): checked, matched, missing. An empty line stands anywhere."""
    wanted = lines.select("line").distinct()
    hits = holders(logs.select(F.lit(0).alias("id"), "text"), wanted).select("line").distinct().withColumn("hit", F.lit(True))
    out = wanted.join(hits, "line", "left").withColumn("hit", F.when(F.col("hit") | (F.length("line") == 0), True))
    return out.agg(F.count(F.lit(1)).alias("checked"), F.count("hit").alias("matched"), (F.count(F.lit(1)) - F.count("hit")).alias("missing"))


def action_counts(attempts: DataFrame) -> DataFrame:
    """Attempts by action, with a row for each of the known ones."""
    all_ = attempts.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    n = attempts.where(F.col("action").isin(*ACTIONS)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(F.broadcast(n), "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n"))  # nine rows


def ring(attempts: DataFrame, cfg: Config = DEFAULTS, limit: int | None = None) -> DataFrame:
    """The latest attempts, newest first; 0 keeps none. limit: how many of them to list, 200 at most."""
    most = audit_max(cfg) if limit is None else min(audit_max(cfg), max(1, min(200, int(limit))))
    return attempts.orderBy(F.col("at").desc(), F.col("id").desc_nulls_last()).limit(most)


def stats(records: DataFrame) -> DataFrame:
    """Counts by kind and status, and how many have references."""
    return records.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size(sanitize(F.col("refs"))) > 0).cast("int")).alias("with_refs"))


def refs_ratio(records: DataFrame) -> DataFrame:
    has = (F.size(sanitize(F.col("refs"))) > 0).cast("int")
    return records.agg(F.count(F.lit(1)).alias("n"), F.sum(has).alias("with_refs"), F.coalesce(F.round(100 * F.sum(has) / F.count(F.lit(1))).cast("long"), F.lit(0)).alias("percent"))


def branches(records: DataFrame, current: str | None) -> DataFrame:
    """Records by branch, the fullest first, with whether it is the current one."""
    own = records.select(normalize_branch(F.col("branch")).alias("branch")).where("branch is not null")
    return own.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).withColumn("current", F.coalesce(F.col("branch") == F.lit(current), F.lit(False))).orderBy(F.col("n").desc(), "branch")


def blocked_by_branch(records: DataFrame, current: str | None) -> DataFrame:
    own = normalize_branch(F.col("branch"))
    return records.agg(F.count(F.when(own.isNotNull() & ~F.coalesce(own == F.lit(current), F.lit(False)), 1)).alias("blocked"))


def last_per_session(events: DataFrame) -> DataFrame:
    """The last sequence number and the last turn's start of each session."""
    start = F.when(F.col("type") == "turn/start", F.col("seq"))
    return events.groupBy("sessionId").agg(F.max("seq").alias("last_seq"), F.max(start).alias("turn_start"))


def cooled(hits: DataFrame, turns: int, by: list[str], turn: str = "turn") -> DataFrame:
    """Adds `since`, turns since the record was last shown, and `cooled`, whether it is shown: that is long enough ago.

    A hit within the cooldown isn't shown and doesn't begin another one, so a key's hits are one ordered pass; they stream through
    a task in order, which holds one number for the key at hand, however many hits it has.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", since long, cooled boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, -999
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            since, shown = [], []
            for k, at in zip(keys, batch.column(turn).to_pylist(), strict=True):
                if k != key:
                    key, last = k, -999
                since.append(at - last)
                shown.append(at - last >= turns)
                last = at if shown[-1] else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(since, pa.int64()), pa.array(shown, pa.bool_())], names=[*batch.schema.names, "since", "cooled"])

    return hits.repartition(*by).sortWithinPartitions(*by, turn).mapInArrow(fold, schema)
