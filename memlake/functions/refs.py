"""References of a record to intervals of session events."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.config import Config, refs_max
from memlake.functions.text import js_trim, short_session
from memlake.schema import REFS, VIAS



def sanitize(refs: Column) -> Column:
    """References with a session; unknown ways of writing are dropped from them."""
    kept = F.filter(refs, lambda r: r.isNotNull() & (F.length(js_trim(r["sessionId"])) > 0))
    clean = F.transform(kept, lambda r: F.struct(js_trim(r["sessionId"]).alias("sessionId"), r["from"].cast("long").alias("from"), r["to"].cast("long").alias("to"), F.when(r["via"].isin(*VIAS), r["via"]).alias("via")))
    return F.coalesce(clean.cast(REFS), F.array().cast(REFS))


def normalize_refs(refs: Column, cfg: Config) -> Column:
    """The first distinct references, by session and interval, at most refs_max."""
    same = lambda a, b: (a["sessionId"] == b["sessionId"]) & a["from"].eqNullSafe(b["from"]) & a["to"].eqNullSafe(b["to"])
    distinct = F.aggregate(sanitize(refs), F.array().cast(REFS), lambda out, r: F.when(F.exists(out, lambda o: same(o, r)), out).otherwise(F.concat(out, F.array(r))))
    most = refs_max(cfg)
    return distinct if math.isinf(most) else F.slice(distinct, 1, int(most)) if most else F.array().cast(REFS)


def with_ref(refs: Column, ref: Column, cfg: Config) -> Column:
    """A new reference before the others; nothing changes where references are off."""
    if not cfg.refs_enabled:
        return F.coalesce(refs, F.array().cast(REFS))
    return normalize_refs(F.concat(F.array(ref).cast(REFS), F.coalesce(refs, F.array().cast(REFS))), cfg)


def _shown(r: Column, short: bool) -> Column:
    name = short_session(r["sessionId"]) if short else r["sessionId"]
    start, end = r["from"], r["to"]
    span = F.when(start.isNotNull() & end.isNotNull() & (start != end), F.concat(F.lit("#"), start.cast("string"), F.lit("-"), end.cast("string"))).when(start.isNotNull(), F.concat(F.lit("#"), start.cast("string"))).when(end.isNotNull(), F.concat(F.lit("#"), end.cast("string"))).otherwise("")
    return F.concat(name, span)


def format_refs(refs: Column, short: bool = False) -> Column:
    return F.array_join(F.transform(sanitize(refs), lambda r: _shown(r, short)), "; ")


def refs_string(refs: Column) -> Column:
    return F.array_join(F.transform(sanitize(refs), lambda r: _shown(r, False)), ";")


def covers(refs: Column, session: Column, seq: Column) -> Column:
    """Whether a reference holds an event: only a start is a point, only an end reaches back to the beginning, none is all."""
    def one(r: Column) -> Column:
        start, end = r["from"], r["to"]
        inside = F.when(start.isNull() & end.isNull(), True).when(end.isNull(), seq == start).when(start.isNull(), seq <= end).otherwise(seq.between(start, end))
        return (r["sessionId"] == session) & F.coalesce(inside, F.lit(False))

    return F.coalesce(F.exists(sanitize(refs), one), F.lit(False))
