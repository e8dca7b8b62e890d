"""Sessions: event logs as batches and streams, compressed log files, the catalog of sessions, the branch of a work tree."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import branch_from_head, text_blocks
from memlake.schema import EVENT_DDL, SESSION_DDL

MAGIC = b"\x28\xb5\x2f\xfd"
BLOCKS = "array<struct<type:string,text:string>>"
SOURCE = "struct<kind:string>"


def events(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(EVENT_DDL).format(format).load(path)


def event_stream(spark: SparkSession, path: str, format: str = "json", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_DDL).format(format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def sessions(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(SESSION_DDL).format(format).load(path)


def newest(catalog: DataFrame, n: int, cwd: str | None = None) -> DataFrame:
    """The newest sessions of a folder, at most 20, none of sub-agents; if the folder has none, of all."""
    catalog = catalog.where(~subagent())
    if cwd is not None:
        own = catalog.where(F.col("cwd") == cwd)
        if own.take(1):
            catalog = own
    return catalog.orderBy(F.col("createdAt").desc(), "sessionId").limit(max(1, min(20, int(n))))


def log_files(spark: SparkSession, path: str, min_bytes: int = 1, pattern: str = "session.*.zstd", depth: int = 3) -> DataFrame:
    """Log files under a folder (path, length, modificationTime), newest first and then by path, no deeper than `depth`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split("://")[-1].replace("file:", "")
    below = F.size(F.split(F.element_at(F.split("path", root, 2), 2), "/")) - 1
    return rows.where((F.col("length") >= min_bytes) & (below <= depth)).orderBy(F.col("modificationTime").desc(), "path")


def frames(content: bytes) -> Iterator[str]:
    """The text of each whole frame of a file of concatenated frames; broken ones are skipped."""
    at = content.find(MAGIC)
    while at >= 0:
        engine = zstandard.ZstdDecompressor().decompressobj()
        try:
            text = engine.decompress(content[at:])
            used = len(content) - at - len(engine.unused_data)
            if engine.eof:
                yield text.decode("utf-8", "replace")
                at = content.find(MAGIC, at + max(used, 4))
                continue
        except zstandard.ZstdError:
            pass
        at = content.find(MAGIC, at + 4)


def log_lines(files: DataFrame) -> DataFrame:
    """(path, frame, line) of log files: lines that begin with a brace. A file is decompressed by one task."""
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for i, text in enumerate(frames(bytes(content))):
                    rows = [x for x in text.split("\n") if x.startswith("{")]
                    yield pd.DataFrame({"path": [path] * len(rows), "frame": [i] * len(rows), "line": rows})

    return files.select("path", "content").mapInPandas(lines, "path string, frame int, line string")


def parse_events(lines: DataFrame) -> DataFrame:
    """Events from JSON lines; lines that aren't events are skipped."""
    rows = lines.withColumn("e", F.from_json("line", "sessionId string, type string, seq bigint, time bigint"))
    data = F.get_json_object("line", "$.data")
    return rows.where(F.col("e.type").isNotNull()).select(F.coalesce("e.sessionId", F.col("path") if "path" in lines.columns else F.lit(None)).alias("sessionId"), "e.type", "e.seq", "e.time", data.alias("data"))


def message(data: Column) -> Column:
    """role, source kind and text of a message event's data, which holds the message or is it."""
    shape = f"role string, source {SOURCE}, content {BLOCKS}, message struct<role:string,source:{SOURCE},content:{BLOCKS}>"
    m = F.from_json(data, shape)
    plain = F.coalesce(F.get_json_object(data, "$.content"), F.get_json_object(data, "$.message.content"))
    text = F.coalesce(text_blocks(m["content"]), text_blocks(m["message"]["content"]), F.when(~F.startswith(plain, F.lit("[")), plain))
    return F.struct(F.coalesce(m["role"], m["message"]["role"]).alias("role"), F.coalesce(m["source"]["kind"], m["message"]["source"]["kind"]).alias("source"), text.alias("text"))


def messages(rows: DataFrame) -> DataFrame:
    """Messages of users and assistants with their text: sessionId, seq, time, role, source, text."""
    out = rows.where(F.col("type").isin("user/message", "assistant/message")).withColumn("m", message(F.col("data")))
    role = F.when(F.col("type") == "assistant/message", "assistant").otherwise(F.coalesce("m.role", F.lit("user")))
    return out.select("sessionId", "seq", "time", role.alias("role"), F.col("m.source").alias("source"), F.coalesce("m.text", F.lit("")).alias("text"))


def real_user() -> Column:
    return (F.col("role") == "user") & F.coalesce(F.col("source") == "user", F.lit(False))


def last_request(rows: DataFrame) -> DataFrame:
    """Where writes of each session come from: sessionId, origin.

    The last message of the real user decides, whatever anything else has said since: an explicit request makes what the model
    writes the user's, else it is the model's own.
    """
    from memlake.functions.safety import explicit_request

    said = messages(rows).where(real_user())
    last = said.groupBy("sessionId").agg(F.max_by("text", F.struct(F.coalesce("seq", F.lit(-1)), F.coalesce("time", F.lit(0)))).alias("text"))
    return last.select("sessionId", F.when(explicit_request(F.col("text")), "user_explicit").otherwise("model_proposed").alias("origin"))


def subagent() -> Column:
    return F.coalesce(F.lower("origin") == "subagent", F.lit(False)) | F.coalesce(F.length("parentSession") > 0, F.lit(False))


def compaction_texts(rows: DataFrame) -> DataFrame:
    """(message_id, sessionId, text, from, to) of compaction summaries and the interval that they stand for."""
    out = rows.where(F.col("type") == "compaction/summary")
    shape = F.from_json("data", f"summary {BLOCKS}, shadowedSeqs array<bigint>")
    return out.select(F.concat_ws("#", "sessionId", F.col("seq").cast("string")).alias("message_id"), "sessionId", F.trim(text_blocks(shape["summary"])).alias("text"), F.array_min(shape["shadowedSeqs"]).alias("from"), F.array_max(shape["shadowedSeqs"]).alias("to")).where(F.length("text") > 0)


#: Seconds that a work tree's branch is remembered.
BRANCH_SECONDS = 5.0
_branches: dict[str, tuple[float, str | None]] = {}


def current_branch(spark: SparkSession, git: str) -> str | None:
    """The branch of a work tree, read again after some seconds."""
    now = time.monotonic()
    if git not in _branches or now - _branches[git][0] > BRANCH_SECONDS:
        _branches[git] = now, read_branch(spark, git)
    return _branches[git][1]


def read_branch(spark: SparkSession, git: str) -> str | None:
    """The branch of a work tree, from its HEAD file; git itself never runs. A `.git` file names the folder."""
    def read(path: str) -> str | None:
        rows = spark.read.text(path, wholetext=True).take(1)
        return rows[0][0] if rows else None

    from pyspark.errors import AnalysisException

    try:
        text = read(f"{git}/HEAD")
    except AnalysisException:
        try:
            text = read(git)
        except AnalysisException:
            return None
        if text is None or not text.lower().startswith("gitdir:"):
            return None
        return read_branch(spark, text[7:].strip())
    row = spark.createDataFrame([(text,)], "t string").select(branch_from_head(F.col("t"))).first()
    return row[0]
