"""Candidates from what users say: sentences, exclusions, an ordered table of signals, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config
from memlake.functions.safety import exclusion_reason, render_equivalent
from memlake.functions.text import js_trim, record_hash, split_sentences
from memlake.schema import REFS, default_scope

#: Fixed values: (signal, kind, origin, confidence, importance, pattern); the first that fits wins.
SIGNALS = [
    ("agent-self-directive", "agent_self", "user_explicit", 0.9, 0.9, "(以后你|你要|你必须|别再那样|不要再这样|下次先|从现在起你|你以后)"),
    ("agent-self-correction", "agent_self", "user_correction", 0.85, 0.8, "(你搞错|你弄错|你写错|你漏了|上次你)"),
    ("explicit-imperative", "user_profile", "user_explicit", 0.9, 0.85, "(?i)(记住|记一下|记下|帮我记|以后都|以后也|remember)"),
    ("correction", "user_profile", "user_correction", 0.8, 0.75, "(不对|不是这|改成|应该是|其实是)"),
    ("decision", "semantic", "observed", 0.7, 0.6, "(就定|采用|最终选|结论是|决定用|就用这个)"),
    ("environment", "user_profile", "observed", 0.8, 0.5, "(我的系统|我的版本|我的路径|我的环境|我用的是|我机器上)"),
    ("preference", "user_profile", "observed", 0.75, 0.6, "(我更喜欢|我偏好|我习惯|我一般|我喜欢|我们项目用|请不要|我不喜欢)"),
]


def sentences(messages: DataFrame) -> DataFrame:
    """A row for each sentence of message_id, text: with its place and why it is excluded (null: it isn't)."""
    rows = messages.select(*[c for c in messages.columns if c != "text"], F.posexplode(split_sentences(F.col("text"))).alias("place", "sentence"))
    return rows.withColumn("excluded", exclusion_reason(F.col("sentence"), render_equivalent(F.col("sentence"))))


def judge(messages: DataFrame, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> DataFrame:
    """Each sentence with its signal and the reason it gives no candidate (null: it gives one).

    A message's candidates are distinct by fingerprint; the surest ones of a turn, in order of the text, fill its quota.
    """
    fits = F.lit(None).cast("struct<signal:string,kind:string,origin:string,confidence:double,importance:double>")
    for name, kind, origin, confidence, importance, pattern in reversed(signals):
        value = F.struct(F.lit(name).alias("signal"), F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), F.lit(float(confidence)).alias("confidence"), F.lit(float(importance)).alias("importance"))
        fits = F.when(F.rlike("sentence", F.lit(pattern)), value).otherwise(fits)
    rows = sentences(messages).withColumn("s", F.when(F.col("excluded").isNull(), fits))
    rows = rows.select("*", "s.*").drop("s").withColumn("body", js_trim(F.regexp_replace("sentence", "[。！？!?]+$", "")))
    rows = rows.withColumn("hash", F.when(F.col("signal").isNotNull(), record_hash(F.col("kind"), default_scope(F.col("kind")), F.lit("*"), F.lit(None), F.col("body"))))
    reason = F.when(F.col("excluded").isNotNull(), F.col("excluded")).when(F.col("signal").isNull(), "no-signal").when(F.col("confidence") < cfg.capture_min_confidence, "below-confidence")
    rows = rows.withColumn("reason", reason)
    same = Window.partitionBy("message_id", "hash", F.col("reason").isNull()).orderBy("place")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate-in-turn").otherwise(F.col("reason")))
    turn = Window.partitionBy("message_id", F.col("reason").isNull()).orderBy(F.col("confidence").desc(), F.col("importance").desc(), "place")
    rows = rows.withColumn("turn_rank", F.row_number().over(turn))
    over = F.col("reason").isNull() & (F.col("turn_rank") > cfg.capture_max_per_turn)
    return rows.withColumn("reason", F.when(over, "over-turn-quota").otherwise(F.col("reason"))).drop("turn_rank", "excluded")


def candidates(messages: DataFrame, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> DataFrame:
    """message_id, place, signal, kind, origin, confidence, importance, text, hash of what is captured."""
    rows = judge(messages, cfg, signals).where(F.col("reason").isNull())
    return rows.withColumn("text", F.col("body")).drop("reason", "sentence", "body")


def skipped(messages: DataFrame, cfg: Config = DEFAULTS, signals: list[tuple] = SIGNALS) -> DataFrame:
    """How many sentences gave no candidate, by reason."""
    return judge(messages, cfg, signals).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def inherit(found: DataFrame, records: DataFrame, now: int, cfg: Config = DEFAULTS) -> DataFrame:
    """Candidates with a slot: a correction takes that of the record it is about, so that it can overrule it; others get a subject."""
    from memlake.functions.text import derive_subject
    from memlake.operators.recall import corrected

    key = F.concat_ws("#", F.col("message_id").cast("string"), F.col("place").cast("string"))
    rows = found.withColumn("query_id", key)
    slots = corrected(records, rows.where(F.col("origin") == "user_correction").select("query_id", F.col("text").alias("query")), now, cfg)
    rows = rows.join(slots.withColumnRenamed("subject", "old").withColumnRenamed("id", "corrects"), "query_id", "left")
    return rows.withColumn("subject", F.coalesce("old", derive_subject(F.col("text"), F.col("signal")))).drop("old", "query_id")


def solidify(summaries: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """What compaction summaries (message_id, sessionId, text, from, to) leave behind as episodic records, with where it came from.

    The first few sentences of each that aren't excluded.
    """
    rows = sentences(summaries).where(F.col("place") < cfg.solidification_max_per_compaction).where(F.col("excluded").isNull())
    whole = {"sessionId": "string", "from": "bigint", "to": "bigint"}
    for name, kind in whole.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    refs = F.when(F.col("sessionId").isNotNull(), F.array(F.struct("sessionId", "from", "to", F.lit("solidify").alias("via")))).cast(REFS)
    return rows.select("message_id", "place", "sessionId", F.lit("episodic").alias("kind"), F.lit("observed").alias("origin"), F.col("sentence").alias("text"), refs.alias("refs"))


def trailing_hour(writes: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """Adds `hour_count`: writes of the same key in the hour up to and including each."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    return writes.withColumn("hour_count", F.count(F.lit(1)).over(Window.partitionBy(by).orderBy(seconds).rangeBetween(-3_600_000_000 + 1, 0)))

