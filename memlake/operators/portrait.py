"""The self portrait: how a new statement meets what is there, and the chains of its revisions.

A statement's best match among the records of its facet and subject is found without a row for each pair: blocks of statements
meet blocks of records, each with an index of its tokens, and give one record for a statement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config
from memlake.functions.text import clamp_text, js_trim, merged_text, normalize_facet, normalize_text, token_set
from memlake.functions.vectors import clamp01
from memlake.schema import user_side

#: Subjects of names, which may be short.
NAMING = ("self.persona.name", "self.persona.address_user", "self.persona.address_self")
SHORTEST, SHORTEST_NAME = 8, 2
#: Statements (short) and records (long) of a block, on average, and groups (facet and subject) up to which they are broadcast.
ASKED_ROWS, HELD_ROWS, BROADCAST_GROUPS = 32_768, 4_096, 10_000


def best_in_block(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The best record of a block for each statement of a block, all of one facet and subject.

    asked: ask, digest, tokens; held: rid, digest, tokens, rpinned, rimportance, rconfidence. Equal texts come first, then those
    whose tokens contain the other's, then by Jaccard similarity, and ties by pinned, importance, confidence and id.
    """
    schema = pa.schema([("ask", pa.string()), ("rid", pa.string()), ("same", pa.bool_()), ("contains", pa.bool_()), ("alike", pa.float64())])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    ranked = pc.sort_indices(held, sort_keys=[("rpinned", "descending"), ("rimportance", "descending"), ("rconfidence", "descending"), ("rid", "ascending")])
    held = held.take(ranked).combine_chunks()
    words = held["tokens"].combine_chunks()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
    order = np.argsort(coded.indices.to_numpy(zero_copy_only=False), kind="stable")
    owner = np.repeat(np.arange(held.num_rows), sizes)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(code)))]).astype(np.int64)
    equal: dict[str | None, list[int]] = {}
    for i, d in enumerate(held["digest"].to_pylist()):
        if d is not None:
            equal.setdefault(d, []).append(i)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for digest, tokens in zip(asked["digest"].to_pylist(), asked["tokens"].to_pylist(), strict=True):
        places = [owner[first[c] : first[c + 1]] for c in map(code.get, tokens) if c is not None]
        both = np.bincount(np.concatenate(places), minlength=held.num_rows) if places else np.zeros(held.num_rows, np.int64)
        alike = both / np.maximum(len(tokens) + sizes - both, 1)
        contains = (both > 0) & (both >= np.minimum(len(tokens), sizes))
        value = alike + 2.0 * contains
        value[equal.get(digest, [])] += 4
        i = int(np.argmax(value))  # the first of equal ones, which are in order
        for column, x in zip(out, (i, i in equal.get(digest, []), bool(contains[i]), float(alike[i])), strict=True):
            column.append(x)
    return pa.Table.from_arrays([asked["ask"].combine_chunks(), held["rid"].take(pa.array(out[0])), pa.array(out[1]), pa.array(out[2]), pa.array(out[3])], schema=schema)


def best_matches(asked: DataFrame, held: DataFrame, asked_rows: int = ASKED_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """ask, rid, same, contains, alike: for each statement the best record of its group, in each block of records.

    asked: ask, facet, key, digest, tokens; held: facet, key, rid, digest, tokens, rpinned, rimportance, rconfidence.
    """
    groups = asked.select("facet", "key").distinct()
    held = held.join(F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups, ["facet", "key"], "left_semi")
    a, b = (max(1, -(-df.count() // n)) for df, n in ((asked, asked_rows), (held, held_rows)))
    left = asked.select("facet", "key", F.pmod(F.xxhash64("ask"), F.lit(a)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("shard"), "ask", "digest", "tokens")
    right = held.select("facet", "key", F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("block"), F.pmod(F.xxhash64("rid"), F.lit(b)).cast("int").alias("shard"), "rid", "digest", "tokens", "rpinned", "rimportance", "rconfidence")
    keys = ("facet", "key", "block", "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_in_block, "ask string, rid string, same boolean, contains boolean, alike double")


def converge(candidates: DataFrame, records: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """What becomes of each candidate (candidate_id, text, facet, subject, origin, confidence).

    Returns candidate_id, action (add, reinforce, refine, supersede, skip), target_id, text, confidence, reason, archive_target.
    """
    cut = lambda c: clamp_text(c, cfg.max_item_tokens, cfg.chars_per_token)
    c = candidates.select(
        "candidate_id", normalize_facet(F.coalesce("facet", F.lit("work"))).alias("facet"), normalize_text(F.coalesce("subject", F.lit(""))).alias("key"), "subject",
        cut(F.col("text")).alias("text"), F.length(js_trim(F.coalesce("text", F.lit("")))).alias("size"), "origin", F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.6).otherwise(clamp01(F.col("confidence"))).alias("confidence"),
    )
    r = records.where((F.col("status") == "active") & (F.col("kind") == "agent_self")).select(
        normalize_facet(F.coalesce("facet", F.lit("work"))).alias("facet"), normalize_text(F.coalesce("subject", F.lit(""))).alias("key"), F.col("id").alias("rid"), F.col("text").alias("rtext"),
        F.col("origin").alias("rorigin"), F.col("confidence").alias("rconfidence"), F.col("pinned").alias("rpinned"), F.col("importance").alias("rimportance"),
    ).where(F.col("key") != "")
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    none = F.array().cast("array<string>")
    c = c.withColumn("ask", F.sha2(F.concat_ws("\0", "facet", "key", F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))).cast("binary"), 256))
    words = lambda text: F.coalesce(token_set(text), none)
    asked = c.dropDuplicates(["ask"]).select("ask", "facet", "key", F.when(F.col("text").isNotNull(), digest(normalize_text(F.col("text")))).alias("digest"), words(F.col("text")).alias("tokens"))
    held = r.select("facet", "key", "rid", F.when(F.col("rtext").isNotNull(), digest(normalize_text(F.col("rtext")))).alias("digest"), words(F.col("rtext")).alias("tokens"), "rpinned", "rimportance", "rconfidence")
    both = c.join(best_matches(asked, held.where(F.col("rid").isNotNull())), "ask", "left").join(r, ["facet", "key", "rid"], "left")
    both = both.withColumns({"same": F.coalesce("same", F.lit(False)), "contains": F.coalesce("contains", F.lit(False)), "alike": F.coalesce("alike", F.lit(0.0))})
    best = Window.partitionBy("candidate_id").orderBy(F.col("same").desc(), F.col("contains").desc(), F.col("alike").desc(), F.col("rpinned").desc(), F.col("rimportance").desc(), F.col("rconfidence").desc(), "rid")
    both = both.withColumn("place", F.row_number().over(best)).where("place = 1")
    short = F.col("size") < F.when(F.coalesce(F.col("subject").isin(*NAMING), F.lit(False)), SHORTEST_NAME).otherwise(SHORTEST)
    action = F.when(F.col("same") | F.col("contains"), "reinforce").when(F.col("alike") >= cfg.self_portrait_merge_threshold, "refine").otherwise("supersede")
    owned = (user_side(F.col("rorigin")) | F.col("rpinned")) & ~user_side(F.col("origin"))
    action = F.when(short, "skip").when(F.col("rid").isNull(), "add").when(owned & ~(F.col("same") & (action == "reinforce")), "skip").otherwise(action)
    both = both.withColumn("action", action).withColumn("owned", F.coalesce(owned, F.lit(False)) & ~short)
    target = cut(F.col("rtext"))
    text = (
        F.when(F.col("owned"), F.col("rtext"))
        .when(F.col("action") == "reinforce", F.when(F.length("text") >= F.length(target), F.col("text")).otherwise(target))
        .when(F.col("action") == "refine", cut(merged_text(F.col("text"), target)))
        .otherwise(F.col("text"))
    )
    higher = F.greatest("confidence", F.coalesce("rconfidence", F.lit(0.0)))
    confidence = F.when(F.col("action") == "reinforce", F.least(F.lit(1.0), higher + 0.05)).when(F.col("action") == "refine", higher).otherwise(F.col("confidence"))
    reason = F.when(short, "too-short").when(F.col("action") == "skip", "user-owned").when(F.col("action") == "add", "added").when(F.col("action") == "reinforce", "reinforced").when(F.col("action") == "refine", "refined").otherwise("superseded")
    hit = F.col("action").isin("reinforce", "refine", "supersede")
    return both.select("candidate_id", "action", F.when(hit, F.col("rid")).alias("target_id"), text.alias("text"), confidence.alias("confidence"), reason.alias("reason"), (F.col("action") == "supersede").alias("archive_target"))


def history(records: DataFrame) -> DataFrame:
    """Chains of at least two revisions, oldest first: facet, subject, head, ids, latest; the newest chain first.

    A record's successor is what superseded it. Heads have no predecessor (in a pure ring the oldest is one). Every record finds
    its head by doubling its predecessor pointers, so a chain of n takes log n joins.
    """
    spark: SparkSession = records.sparkSession
    rows = records.where(F.col("kind") == "agent_self").select("id", normalize_facet(F.coalesce("facet", F.lit("work"))).alias("facet"), normalize_text(F.coalesce("subject", F.lit(""))).alias("key"), "subject", "observedAt", "supersededBy", "supersedes")
    forward = rows.where(F.length("supersededBy") > 0).select("facet", "key", F.col("id").alias("old"), F.col("supersededBy").alias("new"), F.lit(0).alias("way"))
    backward = rows.select("facet", "key", F.explode("supersedes").alias("old"), F.col("id").alias("new"), F.lit(1).alias("way"))
    inside = rows.select("facet", "key", "id")
    edges = forward.unionByName(backward).join(inside.withColumnRenamed("id", "old"), ["facet", "key", "old"], "left_semi").join(inside.withColumnRenamed("id", "new"), ["facet", "key", "new"], "left_semi").where("old <> new")
    # one successor for each record, one predecessor for each successor
    edges = edges.withColumn("n", F.row_number().over(Window.partitionBy("old").orderBy("way", "new"))).where("n = 1")
    edges = edges.withColumn("m", F.row_number().over(Window.partitionBy("new").orderBy("old"))).where("m = 1").select("old", "new")
    state = rows.select("id", "observedAt").join(edges.select(F.col("new").alias("id"), F.col("old").alias("up")), "id", "left")
    # least: the oldest record seen on the way up, which names a ring
    me = F.struct("observedAt", "id")
    state = state.select("id", "up", me.alias("least"), F.col("id").alias("top"))
    from memlake.plans.lineage import cut

    edges = cut(spark, edges)
    state = cut(spark, state)
    for _ in range(edges.count().bit_length() + 1):  # a ring has no end, so the number of rounds ends it
        parent = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"), F.col("top").alias("top2"))
        state = state.join(parent, "up", "left").select("id", F.col("up2").alias("up"), F.least("least", "least2").alias("least"), F.coalesce("top2", "top").alias("top"), F.col("up").alias("was"))
        state = cut(spark, state)
        if not state.where("was is not null and up is not null").take(1):
            break
        state = state.drop("was")
    head = F.when(F.col("up").isNull(), F.col("top")).otherwise(F.col("least.id"))
    chains = state.select("id", head.alias("head")).join(rows.select("id", "facet", "subject", "observedAt"), "id")
    out = chains.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("observedAt", "id"))).alias("c"), F.max("observedAt").alias("latest"), F.min_by("subject", F.struct("observedAt", "id")).alias("subject"), F.min("facet").alias("facet")).where(F.size("c") >= 2)
    return out.select("facet", "subject", "head", F.transform("c", lambda x: x["id"]).alias("ids"), "latest").orderBy(F.col("latest").desc(), "subject", "head")


def naming_settled() -> Column:
    """Over records: whether a name has been given (an aggregate)."""
    return F.coalesce(F.max((F.col("kind") == "agent_self") & (F.col("status") != "invalid") & F.col("subject").isin(*NAMING)), F.lit(False))


def should_reflect(cfg: Config = DEFAULTS) -> Column:
    """Over turn, last_reflect_turn, reflections, session_turns."""
    if not cfg.self_reflect_enabled or not cfg.self_reflect_max_per_session > 0:
        return F.lit(False)
    every = cfg.self_reflect_every_turns if 0 < cfg.self_reflect_every_turns < float("inf") else DEFAULTS.self_reflect_every_turns
    turns = F.coalesce("session_turns", "turn")
    waited = F.col("last_reflect_turn").isNull() | (F.col("turn") - F.col("last_reflect_turn") >= every)
    return (F.coalesce("reflections", F.lit(0)) < cfg.self_reflect_max_per_session) & (turns >= cfg.self_reflect_min_turn) & waited


def should_introduce(cfg: Config = DEFAULTS) -> Column:
    """Over turn, asks, settled."""
    if not cfg.self_intro_enabled or not cfg.self_intro_max_asks > 0:
        return F.lit(False)
    return ~F.coalesce("settled", F.lit(False)) & (F.coalesce("asks", F.lit(0)) < cfg.self_intro_max_asks) & (F.coalesce("turn", F.lit(0)) >= cfg.self_intro_min_turn)
