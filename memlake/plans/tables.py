"""Records, events and sessions derived from the test tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.config import Config
from memlake.schema import KINDS, ORIGINS, REFS

NOW = 1_704_067_200_000
DAY = 86_400_000
CFG = Config()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, n, column="doc_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % n + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each document: kind, origin, status and time follow from its id, importance from its label."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
    i = F.col("doc_id")
    status = F.when(i % 17 == 0, "archived").when(i % 19 == 0, "pending").when(i % 23 == 0, "invalid").otherwise("active")
    start = (i % 5).cast("long")
    return d.select(
        i.cast("string").alias("id"), "doc_id", _pick(KINDS, 6).alias("kind"), F.lit("exact").alias("precision"), _pick(ORIGINS, 4).alias("origin"),
        F.struct(F.lit("workspace").alias("level"), F.col("source").alias("key")).alias("scope"), F.col("lang").alias("subject"),
        F.concat(F.lit("f"), (i % 3).cast("string")).alias("field"), F.concat(F.lit("v"), (i % 2).cast("string")).alias("value"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(i % 11 == 0, F.array(F.lit("summary"))).otherwise(F.array(F.lit("plain"))).alias("tags"),
        F.lit(None).cast("struct<sessionId:string,seqStart:bigint,seqEnd:bigint>").alias("source"),
        ((60 + i % 5 * 8) / F.lit(100.0)).alias("confidence"), F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.2).otherwise(0.5).alias("importance"), (i % 50 == 0).alias("pinned"), status.alias("status"),
        F.lit(None).cast("long").alias("invalidAt"), (F.lit(NOW) - (i % 400) * DAY).cast("long").alias("observedAt"), F.lit(None).cast("long").alias("eventTime"), F.lit(None).cast("long").alias("lastUsedAt"), (i % 7).cast("long").alias("useCount"),
        F.when((i % 30) != 1, F.array((i - 6).cast("string"))).otherwise(F.array().cast("array<string>")).alias("supersedes"),
        F.struct(F.array(F.col("source")).alias("sessions"), F.lit(0).cast("long").alias("count")).alias("reinforcement"), F.lit("").alias("hash"),
        F.when(i % 4 == 0, F.concat(F.lit("feature/"), (i % 3).cast("string"))).alias("branch"), F.lit("work").alias("facet"), F.lit(None).cast("string").alias("supersededBy"),
        F.when(i % 3 == 0, F.array(F.struct(F.concat(F.lit("s-"), (i % 97).cast("string")).alias("sessionId"), start.alias("from"), (start + 2).alias("to"), F.lit("live").alias("via")))).cast(REFS).alias("refs"),
    )


RECORDS_SQL = f"""records AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id,
    ['user_profile','agent_self','project_gist','episodic','semantic','procedural'][d.doc_id % 6 + 1] AS kind,
    ['observed','model_proposed','user_correction','user_explicit'][d.doc_id % 4 + 1] AS origin,
    'workspace' AS scope_level, d.source AS scope_key, d.lang AS subject, 'f' || (d.doc_id % 3) AS field, 'v' || (d.doc_id % 2) AS value, coalesce(d.text, '') AS text,
    CASE WHEN d.doc_id % 11 = 0 THEN 'summary' ELSE 'plain' END AS tag,
    CAST(60 + d.doc_id % 5 * 8 AS DOUBLE) / 100 AS confidence, CASE l.quality WHEN 1 THEN 0.8::DOUBLE WHEN 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS importance,
    d.doc_id % 50 = 0 AS pinned, CASE WHEN d.doc_id % 17 = 0 THEN 'archived' WHEN d.doc_id % 19 = 0 THEN 'pending' WHEN d.doc_id % 23 = 0 THEN 'invalid' ELSE 'active' END AS status,
    {NOW} - (d.doc_id % 400) * {DAY} AS observed, d.doc_id % 7 AS uses,
    CASE WHEN d.doc_id % 4 = 0 THEN 'feature/' || (d.doc_id % 3) END AS branch,
    CASE WHEN d.doc_id % 3 = 0 THEN 's-' || (d.doc_id % 97) END AS ref_session, d.doc_id % 5 AS ref_from, d.doc_id % 5 + 2 AS ref_to
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events from conversations; a turn closes after each assistant message."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    block = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    user = F.to_json(F.struct(F.lit("user").alias("role"), F.struct(F.lit("user").alias("kind")).alias("source"), block.alias("content")))
    other = F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), block.alias("content")).alias("message")))
    said = c.select(F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("sessionId"), F.concat("role", F.lit("/message")).alias("type"), (F.col("turn") * 2).cast("long").alias("seq"), (F.lit(NOW) + F.col("conv_id") * 100_000 + F.col("turn") * 1000).cast("long").alias("time"), F.when(F.col("role") == "user", user).otherwise(other).alias("data"))
    ends = said.where(F.col("type") == "assistant/message").select("sessionId", F.lit("turn/end").alias("type"), (F.col("seq") + 1).alias("seq"), (F.col("time") + 1).alias("time"), F.lit("{}").alias("data"))
    return said.unionByName(ends)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    none = F.lit(None).cast("string")
    return c.select(F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("sessionId"), F.concat(F.lit("/w/"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), (F.lit(NOW) + F.col("conv_id") * 100_000).cast("long").alias("createdAt"), F.when(F.col("conv_id") % 13 == 0, "subagent").alias("origin"), none.alias("parentSession"), F.lit(False).alias("live"), F.lit(True).alias("persisted"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
