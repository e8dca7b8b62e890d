"""What a turn's model sees besides: recalled records, a notice to reflect, a question about names, in that order.

A batch has one turn of each session at most. The state goes in and comes out as tables: when each record was last shown in a
session, and how often each session was asked to reflect; a turn that brings nothing leaves it as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config, budget, language
from memlake.functions.text import clamp_text
from memlake.operators import recall, render
from memlake.operators.portrait import naming_settled, should_introduce, should_reflect
from memlake.plans.lineage import cut

#: Messages in order of their places, by the name of their section.
SECTIONS = ("recall", "self-reflect", "self-intro")
#: Turns that a record's last showing is kept for, and notices of a session that are remembered.
KEEP_TURNS, KEEP_NOTICES = 200, 32
GATES = "sessionId string, last_reflect_turn bigint, reflections bigint, reflect_turns array<bigint>, session_turns bigint"


@dataclass(frozen=True)
class Injected:
    """messages: query_id, place, section, text; hits: the records shown; last and gates: the state after the batch; asks: all."""

    messages: DataFrame
    hits: DataFrame
    last: DataFrame
    gates: DataFrame
    asks: int
    asked_sessions: DataFrame


def step_gates(turns: DataFrame, gates: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Each session's turn with `reflect`, whether it gets the notice, and the session's state after it.

    turns: query_id, sessionId, turn (null or negative: no turn); gates: the state, a row for a session. A new session starts anew.
    """
    rows = turns.select("query_id", "sessionId", F.floor("turn").cast("long").alias("turn")).join(gates, "sessionId", "left")
    valid = F.coalesce(F.col("turn") >= 0, F.lit(False))
    rows = rows.withColumn("session_turns", F.greatest(F.coalesce("session_turns", F.lit(0)), F.when(valid, F.col("turn")).otherwise(0)))
    rows = rows.withColumn("reflect", valid & should_reflect(cfg))
    kept = F.coalesce("reflect_turns", F.array().cast("array<bigint>"))
    after = F.when(F.col("reflect"), F.slice(F.concat(kept, F.array("turn")), F.greatest(F.size(kept) + 2 - KEEP_NOTICES, F.lit(1)), F.lit(KEEP_NOTICES))).otherwise(kept)
    return rows.select(
        "query_id", "sessionId", "turn", "reflect", F.when(F.col("reflect"), F.col("turn")).otherwise(F.col("last_reflect_turn")).alias("last_reflect_turn"),
        (F.coalesce("reflections", F.lit(0)) + F.col("reflect").cast("long")).alias("reflections"), after.alias("reflect_turns"), "session_turns",
    )


def step_last(last: DataFrame, hits: DataFrame, turns: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """When records were last shown (sessionId, id, last_turn), after a batch; what is older than `keep` turns goes."""
    now = turns.select("sessionId", F.col("turn").alias("now"))
    both = last.select("sessionId", "id", "last_turn").unionByName(hits.select("sessionId", "id", F.col("turn").alias("last_turn")))
    newest = both.groupBy("sessionId", "id").agg(F.max("last_turn").alias("last_turn")).join(now, "sessionId", "left")
    return newest.where(F.col("now").isNull() | ((F.col("last_turn") >= F.col("now") - keep) & (F.col("last_turn") <= F.col("now")))).drop("now")


def notice(text: str, cfg: Config) -> Column:
    return clamp_text(F.lit(text), max(1, budget(cfg.max_injected_tokens, DEFAULTS.max_injected_tokens)), budget(cfg.chars_per_token, DEFAULTS.chars_per_token))


def inject(records: DataFrame, turns: DataFrame, lines: DataFrame, last: DataFrame, gates: DataFrame, now: int, cfg: Config = DEFAULTS, asks: int = 0, asked_sessions: DataFrame | None = None, mode: str = "inject", rescore: Callable[[DataFrame], DataFrame] | None = None) -> Injected:
    """One step for a batch of turns.

    turns: query_id, sessionId, turn, query, workspace, and dropped (a turn that was refused or broken off gets nothing and
    changes nothing) where there is such a column; lines: sessionId, line of what is shown already; last: sessionId, id,
    last_turn; asks: how often a name was asked for so far, in all sessions, and asked_sessions (sessionId) where. mode `dry`
    finds what would be shown, but gives no messages; `off` does nothing. rescore: puts candidates, some more than are shown, in
    another order.
    """
    spark = records.sparkSession
    none = turns.limit(0)
    asked_sessions = asked_sessions if asked_sessions is not None else none.select("sessionId")
    live = turns.where(~F.coalesce("dropped", F.lit(False))) if "dropped" in turns.columns else turns
    live = cut(spark, live if mode != "off" else none)
    names = live.select("query_id", "sessionId", "turn")
    mine = lambda df, *columns: df.join(names.select("query_id", "sessionId"), "sessionId").select("query_id", *columns)
    most = cfg.recall_top_k if rescore is None else max(cfg.recall_top_k, min(recall.MOST, 4 * cfg.recall_top_k))
    found = recall.turn_recall(records, live, mine(lines, "line"), mine(last, "id", "last_turn"), now, cfg, most)
    if rescore is not None:
        found = rescore(found).where(F.col("rank") <= cfg.recall_top_k)
    shown = cut(spark, render.recall_block(found, cfg))
    hits = shown.select("query_id", "place", "id").join(names, "query_id")
    after = step_last(last, hits, names)
    if mode != "inject":
        return Injected(spark.createDataFrame([], "query_id string, place int, section string, text string"), hits, after, gates, asks, asked_sessions)
    t = render.TEXTS[language(cfg.language)]
    stepped = cut(spark, step_gates(names, gates, cfg))
    recalled = render.recall_text(shown, cfg).select("query_id", F.lit(0).alias("place"), F.lit(SECTIONS[0]).alias("section"), "text")
    reflect = stepped.where("reflect").select("query_id", F.lit(1).alias("place"), F.lit(SECTIONS[1]).alias("section"), notice(t.reflect, cfg).alias("text"))
    settled = bool(records.agg(naming_settled().alias("s")).first()["s"])
    free = names.join(asked_sessions, "sessionId", "left_anti").withColumn("asks", F.lit(asks)).withColumn("settled", F.lit(settled)).where(should_introduce(cfg))
    # names are asked for a few times at most, in all sessions together
    room = max(0, int(min(cfg.self_intro_max_asks, 1 << 30)) - asks)
    chosen = cut(spark, free.orderBy("turn", "query_id").limit(room).select("query_id", "sessionId"))
    intro = chosen.select("query_id", F.lit(2).alias("place"), F.lit(SECTIONS[2]).alias("section"), notice(t.introduce, cfg).alias("text"))
    kept = gates.join(stepped.select("sessionId"), "sessionId", "left_anti")
    new_gates = kept.unionByName(stepped.select(*kept.columns))
    return Injected(recalled.unionByName(reflect).unionByName(intro), hits, after, new_gates, asks + chosen.count(), asked_sessions.unionByName(chosen.select("sessionId")).distinct())
