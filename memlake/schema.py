"""Schemas of records, session events and session headers, and the values that columns may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KINDS = ("user_profile", "agent_self", "project_gist", "episodic", "semantic", "procedural")
#: From the weakest origin to the strongest.
ORIGINS = ("observed", "model_proposed", "user_correction", "user_explicit")
STATUSES = ("active", "pending", "invalid", "archived")
PRECISIONS = ("exact", "gist")
SCOPES = ("profile", "workspace", "session")
FACETS = ("persona", "work")
VIAS = ("live", "sleep", "tool", "command", "solidify", "import")

SCOPE = "struct<level:string,key:string>"
REFS = "array<struct<sessionId:string,from:bigint,to:bigint,via:string>>"
RECORD_DDL = (
    f"id string, kind string, precision string, origin string, scope {SCOPE}, subject string, field string, value string, text string, "
    "tags array<string>, source struct<sessionId:string,seqStart:bigint,seqEnd:bigint>, confidence double, importance double, pinned boolean, "
    "status string, invalidAt bigint, observedAt bigint, eventTime bigint, lastUsedAt bigint, useCount bigint, supersedes array<string>, "
    f"reinforcement struct<sessions:array<string>,count:bigint>, hash string, branch string, facet string, supersededBy string, refs {REFS}"
)
EVENT_DDL = "sessionId string, type string, seq bigint, time bigint, data string"
SESSION_DDL = "sessionId string, cwd string, createdAt bigint, origin string, parentSession string, live boolean, persisted boolean"
COLUMNS = ("id", "kind", "precision", "origin", "scope", "subject", "field", "value", "text", "tags", "source", "confidence", "importance", "pinned", "status", "invalidAt", "observedAt", "eventTime", "lastUsedAt", "useCount", "supersedes", "reinforcement", "hash", "branch", "facet", "supersededBy", "refs")


def default_scope(kind: Column) -> Column:
    """The level of scope that a kind has unless one is given."""
    return F.when(kind.isin("user_profile", "agent_self"), "profile").otherwise("workspace")


def user_side(origin: Column) -> Column:
    return origin.isin("user_explicit", "user_correction")


def origin_rank(origin: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORIGINS)), origin) - 1


def ranking(prefix: str = "") -> list[Column]:
    """The total order of records: pinned, importance, confidence, id."""
    return [F.col(f"{prefix}pinned").desc(), F.col(f"{prefix}importance").desc(), F.col(f"{prefix}confidence").desc(), F.col(f"{prefix}id").asc()]


def make_records(df: DataFrame, now: int) -> DataFrame:
    """Records from whatever of their columns is there; what is missing or null gets its default, and hash is computed."""
    from memlake.functions.text import js_trim, normalize_branch, record_hash

    have = set(df.columns)
    col = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    session = col("sessionId", "string")
    out = df.select(
        col("id", "string").alias("id"),
        col("kind", "string").alias("kind"),
        F.coalesce(col("precision", "string"), F.lit("exact")).alias("precision"),
        F.coalesce(col("origin", "string"), F.lit("observed")).alias("origin"),
        F.coalesce(col("scope", SCOPE), F.struct(default_scope(F.col("kind")).alias("level"), F.lit("*").alias("key"))).alias("scope"),
        col("subject", "string").alias("subject"),
        col("field", "string").alias("field"),
        col("value", "string").alias("value"),
        js_trim(F.coalesce(col("text", "string"), F.lit(""))).alias("text"),
        F.coalesce(col("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        col("source", "struct<sessionId:string,seqStart:bigint,seqEnd:bigint>").alias("source"),
        F.coalesce(col("confidence", "double"), F.lit(0.6)).alias("confidence"),
        F.coalesce(col("importance", "double"), F.lit(0.5)).alias("importance"),
        F.coalesce(col("pinned", "boolean"), F.lit(False)).alias("pinned"),
        F.coalesce(col("status", "string"), F.lit("active")).alias("status"),
        col("invalidAt", "long").alias("invalidAt"),
        F.coalesce(col("observedAt", "long"), F.lit(now)).alias("observedAt"),
        col("eventTime", "long").alias("eventTime"),
        col("lastUsedAt", "long").alias("lastUsedAt"),
        F.coalesce(col("useCount", "long"), F.lit(0)).cast("long").alias("useCount"),
        F.coalesce(col("supersedes", "array<string>"), F.array().cast("array<string>")).alias("supersedes"),
        F.coalesce(col("reinforcement", "struct<sessions:array<string>,count:bigint>"), F.struct(F.array_compact(F.array(session)).alias("sessions"), F.lit(0).cast("long").alias("count"))).alias("reinforcement"),
        normalize_branch(col("branch", "string")).alias("branch"),
        col("facet", "string").alias("facet"),
        col("supersededBy", "string").alias("supersededBy"),
        col("refs", REFS).alias("refs"),
    )
    hashed = record_hash(F.col("kind"), F.col("scope.level"), F.col("scope.key"), F.col("subject"), F.col("text"), F.col("branch"))
    made = out.withColumn("hash", hashed)
    given = F.concat(F.lit("m_"), F.col("hash"), F.lit("_"), F.lower(F.conv(F.abs(F.col("observedAt")).cast("string"), 10, 36)))
    return made.withColumn("id", F.coalesce("id", given)).select(*COLUMNS)


def validate(df: DataFrame) -> DataFrame:
    """Adds `invalid`, the first rule that a record breaks (null: none)."""
    rules = [
        ("id", F.col("id").isNull() | (F.col("id") == "")),
        ("kind", ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))),
        ("origin", ~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False))),
        ("status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("precision", ~F.coalesce(F.col("precision").isin(*PRECISIONS), F.lit(False))),
        ("scope", ~F.coalesce(F.col("scope.level").isin(*SCOPES), F.lit(False))),
        ("facet", F.col("facet").isNotNull() & ~F.col("facet").isin(*FACETS)),
        ("text", F.col("text").isNull() | (F.col("text") == "")),
        ("confidence", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("importance", ~F.coalesce(F.col("importance").between(0, 1), F.lit(False))),
    ]
    first = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        first = F.when(broken, name).otherwise(first)
    return df.withColumn("invalid", first)
