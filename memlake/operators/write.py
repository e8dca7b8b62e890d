"""Writing: secrets, masking, echoes, policy, rejected fingerprints, portraits, merging by fingerprint, and approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config, pending_max, write_policy
from memlake.functions.refs import normalize_refs
from memlake.functions.safety import has_pii, mask_pii, render_equivalent, scan_sensitive
from memlake.functions.text import record_parts
from memlake.operators.govern import echo
from memlake.schema import COLUMNS, KINDS, REFS, make_records, origin_rank

#: Outcomes of a write that isn't applied.
CODES = ("rejected_sensitive", "rejected_echo", "rejected_write_policy", "rejected_by_user", "pending_queue_full", "rejected_invalid", "portrait_skipped", "already_exists", "already_pending")


def decide(origin: Column, cfg: Config) -> Column:
    """What becomes of a write: only the model's own are queued or refused."""
    outcome = {"ask": "queue", "off": "reject"}.get(write_policy(cfg), "apply")
    return F.when(origin == "model_proposed", outcome).otherwise("apply")


def fold_mentions(mentions: Column, importance: Column, sessions: Column, boost: float) -> Column:
    """Importance after mentions in order: the greater one, and a boost for each new session."""
    start = F.struct(importance.cast("double").alias("i"), F.coalesce(sessions, F.array().cast("array<string>")).alias("s"))

    def step(acc: Column, m: Column) -> Column:
        new = m["session"].isNotNull() & ~F.array_contains(acc["s"], F.coalesce(m["session"], F.lit("")))
        best = F.greatest(acc["i"], m["importance"])
        return F.struct(F.when(new, F.least(F.lit(1.0), best + boost)).otherwise(best).alias("i"), F.when(new, F.array_append(acc["s"], m["session"])).otherwise(acc["s"]).alias("s"))

    return F.aggregate(mentions, start, step)


def merge_by_hash(existing: DataFrame, incoming: DataFrame, cfg: Config = DEFAULTS, exact: bool = False) -> DataFrame:
    """New versions of the records that incoming ones (with sessionId and arrival, their order) create or repeat.

    Equal fingerprints are one record, `created` says whether it is new. The highest confidence, the strongest origin, a pin and
    the sessions are kept whatever the order; importance and the time follow the order of arrival. A fingerprint has 32 bits, which
    some of 100 000 records have in common by chance; `exact` keeps those apart by what their fingerprints are made of.
    """
    order = F.struct("arrival", "id")
    parts = F.sha2(record_parts(F.col("kind"), F.col("scope.level"), F.col("scope.key"), F.col("subject"), F.col("text"), F.col("branch")), 256) if exact else F.lit("")
    rows = incoming.withColumn("sessionId", F.coalesce("sessionId", F.col("source.sessionId"))).withColumn("parts", parts)
    mention = F.struct("arrival", F.col("sessionId").alias("session"), "importance", "observedAt")
    grouped = rows.groupBy("hash", "parts").agg(
        F.min_by(F.struct(*COLUMNS), order).alias("first"),
        F.array_sort(F.collect_list(mention)).alias("mentions"),
        F.max("confidence").alias("best"),
        F.max_by("origin", origin_rank(F.col("origin"))).alias("strongest"),
        F.max("pinned").alias("any_pin"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("observedAt", order).alias("last"),
        F.flatten(F.collect_list(F.coalesce("refs", F.array().cast(REFS)))).alias("new_refs"),
    )
    old = existing.where(F.col("status") == "active").withColumn("parts", parts).groupBy("hash", "parts").agg(F.min_by(F.struct(*COLUMNS), "id").alias("old"))
    both = grouped.join(old, ["hash", "parts"], "left").withColumn("created", F.col("old").isNull()).withColumn("r", F.coalesce("old", "first"))
    # a new record's first mention is itself; only those after it can boost
    mentions = F.when(F.col("created"), F.slice("mentions", F.lit(2), F.greatest(F.size("mentions") - 1, F.lit(0)))).otherwise(F.col("mentions"))
    first_session = F.array_compact(F.array(F.get("mentions.session", F.lit(0))))
    known = F.when(F.col("created"), F.array_union("r.reinforcement.sessions", first_session)).otherwise(F.col("r.reinforcement.sessions"))
    both = both.withColumn("m", fold_mentions(mentions, F.col("r.importance"), known, cfg.repeat_mention_boost))
    out = both.select("created", "n", "best", "strongest", "any_pin", "last", "m", "new_refs", "r.*")
    new = {
        "confidence": F.greatest("confidence", "best"),
        "importance": F.col("m.i"),
        "origin": F.when(origin_rank(F.col("strongest")) > origin_rank(F.col("origin")), F.col("strongest")).otherwise(F.col("origin")),
        "pinned": F.col("pinned") | F.col("any_pin"),
        "observedAt": F.when(F.col("created") & (F.col("n") == 1), F.col("observedAt")).otherwise(F.col("last")),
        "reinforcement": F.struct(F.col("m.s").alias("sessions"), (F.col("reinforcement.count") + F.col("n") - F.col("created").cast("int")).cast("long").alias("count")),
        "refs": F.when(F.col("created") & (F.col("n") == 1), F.col("refs")).otherwise(normalize_refs(F.concat(F.col("new_refs"), F.coalesce("refs", F.array().cast(REFS))), cfg)),
    }
    return out.withColumns(new).select(*COLUMNS, "created", "n")


def screen(incoming: DataFrame, now: int, cfg: Config = DEFAULTS, lines: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Incoming rows as records with `input_id`, `arrival`, `sessionId` and `code`, the reason to refuse them (null: none).

    A pii_policy of reject refuses texts with addresses or numbers; mask masks them.
    """
    rows = incoming.withColumn("view", render_equivalent(F.col("text")))
    valid = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & (F.coalesce(F.trim("text"), F.lit("")) != "")
    code = F.when(~valid, "rejected_invalid").when(scan_sensitive(F.col("view")).isNotNull(), "rejected_sensitive")
    if cfg.pii_policy == "reject":
        code = code.when(has_pii(F.col("view")), "rejected_sensitive")
    rows = rows.withColumn("code", code).withColumn("text", mask_pii(F.col("text"), F.col("view")))
    if lines is not None:
        again = echo(rows.where(F.col("origin") == "model_proposed").select(F.col("input_id").alias("id"), "text"), lines, cfg.echo_threshold)
        rows = rows.join(again.select(F.col("id").alias("input_id"), F.lit(True).alias("echoed")), "input_id", "left")
        rows = rows.withColumn("code", F.coalesce("code", F.when(F.col("echoed"), "rejected_echo"))).drop("echoed")
    rows = rows.withColumn("code", F.coalesce("code", F.when(decide(F.col("origin"), cfg) == "reject", "rejected_write_policy")))
    extra = [c for c in ("input_id", "arrival", "sessionId", "code") if c in rows.columns]
    made = make_records(rows.withColumn("id", F.coalesce("id", F.concat(F.lit("in_"), F.col("input_id").cast("string"))) if "id" in rows.columns else F.concat(F.lit("in_"), F.col("input_id").cast("string"))), now)
    made = made.join(rows.select(F.concat(F.lit("in_"), F.col("input_id").cast("string")).alias("id"), *extra), "id")
    made = made.withColumn("id", F.concat(F.lit("m_"), F.col("hash"), F.lit("_"), F.col("input_id").cast("string")))
    if rejected is not None:
        made = made.join(rejected.select("hash", F.lit(True).alias("refused")), "hash", "left")
        made = made.withColumn("code", F.coalesce("code", F.when(F.col("refused"), "rejected_by_user"))).drop("refused")
    return made


def write(existing: DataFrame, incoming: DataFrame, now: int, cfg: Config = DEFAULTS, lines: DataFrame | None = None, rejected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions to append, a result for each input): input_id, ok, outcome, id, hash.

    incoming: input_id, arrival (its order), kind, text and whatever else of a record there is. Rows meant for approval wait as
    pending: one whose fingerprint is active or pending already is refused, and so are those beyond the queue's room.
    """
    screened = screen(incoming, now, cfg, lines, rejected)
    gate = F.when(F.col("code").isNotNull(), "refuse").otherwise(decide(F.col("origin"), cfg))
    screened = screened.withColumn("gate", gate)
    twins = existing.where(F.col("status").isin("active", "pending")).groupBy("hash").agg(F.max((F.col("status") == "active").cast("int")).alias("is_active"))
    queue = screened.where(F.col("gate") == "queue").join(twins, "hash", "left")
    queue = queue.withColumn("again", F.row_number().over(Window.partitionBy("hash").orderBy("arrival", "input_id")))
    queue = queue.withColumn("code", F.when(F.col("is_active") == 1, "already_exists").when((F.col("is_active") == 0) | (F.col("again") > 1), "already_pending"))
    room = pending_max(cfg)
    if room > 0:
        waiting = existing.where(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("waiting"))
        # the queue holds some dozens of rows: only the first that can fit are numbered
        fits = queue.where(F.col("code").isNull()).orderBy("arrival", "input_id").limit(int(room)).select("input_id", "arrival")
        fits = fits.withColumn("place", F.row_number().over(Window.orderBy("arrival", "input_id"))).crossJoin(F.broadcast(waiting)).where(F.col("place") + F.col("waiting") <= room)
        queue = queue.join(fits.select("input_id", F.lit(True).alias("fits")), "input_id", "left").withColumn("code", F.coalesce("code", F.when(F.col("fits").isNull(), "pending_queue_full"))).drop("fits")
    queued = queue.where(F.col("code").isNull()).withColumn("status", F.lit("pending"))
    applied = merge_by_hash(existing, screened.where(F.col("gate") == "apply"), cfg)
    versions = applied.select(*COLUMNS).unionByName(queued.select(*COLUMNS))
    done = screened.where(F.col("gate") == "apply").select("input_id", "hash").join(applied.select("hash", F.col("id").alias("rid"), "created"), "hash")
    first = F.row_number().over(Window.partitionBy("hash").orderBy("input_id"))
    done = done.select("input_id", F.lit(True).alias("ok"), F.when(F.col("created") & (first == 1), "created").otherwise("merged").alias("outcome"), F.col("rid").alias("id"), "hash")
    waits = queue.select("input_id", F.col("code").isNull().alias("ok"), F.coalesce("code", F.lit("pending")).alias("outcome"), F.when(F.col("code").isNull(), F.col("id")).alias("id"), "hash")
    refused = screened.where(F.col("gate") == "refuse").select("input_id", F.lit(False).alias("ok"), F.col("code").alias("outcome"), F.lit(None).cast("string").alias("id"), "hash")
    return versions, done.unionByName(waits).unionByName(refused)


def pending(records: DataFrame) -> DataFrame:
    """What waits for approval, the newest first."""
    return records.where(F.col("status") == "pending").orderBy(F.col("observedAt").desc(), "id")


def approve(records: DataFrame, ids: DataFrame, now: int, cfg: Config = DEFAULTS) -> DataFrame:
    """Versions after approval: active, unless an active twin has the fingerprint, which then takes the mention.

    A portrait entry that would change what a user owns stays pending.
    """
    chosen = records.where(F.col("status") == "pending").join(ids.select("id").distinct(), "id", "left_semi")
    owned = records.where((F.col("status") == "active") & (F.col("kind") == "agent_self") & (F.col("origin").isin("user_explicit", "user_correction") | F.col("pinned"))).select("subject", F.lit(True).alias("owned")).distinct()
    chosen = chosen.join(owned, "subject", "left")
    blocked = (F.col("kind") == "agent_self") & F.coalesce("owned", F.lit(False)) & ~F.col("origin").isin("user_explicit", "user_correction")
    chosen = chosen.where(~blocked).select(*COLUMNS)
    merged = merge_by_hash(records, chosen.withColumn("arrival", F.col("observedAt")).withColumn("sessionId", F.col("source.sessionId")).withColumn("status", F.lit("active")), cfg)
    twins = chosen.join(merged.where(~F.col("created")).select("hash"), "hash", "left_semi").withColumn("status", F.lit("archived"))
    return merged.select(*COLUMNS).unionByName(twins.select(*COLUMNS))


def reject(records: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(versions, fingerprints): rejected entries become invalid and their fingerprints are refused from then on."""
    chosen = records.where(F.col("status") == "pending").join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.withColumn("status", F.lit("invalid")).withColumn("invalidAt", F.lit(now).cast("long")).select(*COLUMNS), chosen.select("hash").distinct()


def restore(records: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Versions after bringing records back: active again, and what superseded them is invalid."""
    back = records.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status").isin("archived", "invalid"))
    over = records.where((F.col("status") == "active") & (F.size("supersedes") > 0)).select(*COLUMNS, F.explode("supersedes").alias("old"))
    over = over.join(back.select(F.col("id").alias("old")), "old", "left_semi").drop("old").dropDuplicates(["id"])
    active = back.withColumn("status", F.lit("active")).withColumn("invalidAt", F.lit(None).cast("long")).withColumn("supersededBy", F.lit(None).cast("string"))
    return active.select(*COLUMNS).unionByName(over.withColumn("status", F.lit("invalid")).withColumn("invalidAt", F.lit(now).cast("long")).select(*COLUMNS))


def set_status(records: DataFrame, ids: DataFrame, status: str, now: int) -> DataFrame:
    """Versions with another status; what waits for approval is left alone."""
    rows = records.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status") != "pending")
    return rows.withColumn("status", F.lit(status)).withColumn("invalidAt", F.lit(now).cast("long") if status == "invalid" else F.lit(None).cast("long")).select(*COLUMNS)


def confirm(records: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Versions that the user vouches for: explicit origin, fresh time; pending ones are left alone."""
    rows = records.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status") != "pending")
    return rows.withColumn("origin", F.lit("user_explicit")).withColumn("confidence", F.greatest("confidence", F.lit(0.9))).withColumn("observedAt", F.lit(now).cast("long")).select(*COLUMNS)


def pin(records: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    rows = records.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status") != "pending")
    return rows.withColumn("pinned", F.lit(on)).select(*COLUMNS)
