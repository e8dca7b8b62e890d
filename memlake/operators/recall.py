"""Retrieval for many queries at once: token index, gates, inverse document frequencies, scores, top k, explanations, vectors.

The pool is tokenised once: what it has of the queries' tokens is written to the shared folder, and document frequencies and
scores both read that. Where queries and their tokens make a table of bounded size, records stream past it as matrix products;
otherwise their tokens are joined, with records dealt by id so that summing up needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from memlake.config import DEFAULTS, Config, blend_weight, length_penalty
from memlake.functions.text import informative, normalize_text, record_text, token_set, tokenize
from memlake.functions.vectors import blend, clamp01, cosine, finite, tiles
from memlake.plans.lineage import cut
from memlake.schema import ranking

DAY = 86_400_000.0
#: Query tokens up to which they are broadcast.
BROADCAST_TOKENS = 200_000
#: Queries times distinct tokens up to which they are one table, and records of a product.
TABLE, STRIPE = 4_000_000, 256
#: Rows that an explanation hands on at a time, but for a record with more.
ROWS = 200_000
#: Records that settle most messages, and characters of one of them at most.
WITNESSES, WITNESS_CHARS = 64, 1 << 17
#: Records of a page of results at most.
MOST = 50


def with_tokens(records: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Adds `tokens`, unless the store keeps them: the distinct tokens of text, subject and tags."""
    if "tokens" in records.columns:
        return records
    return records.withColumn("tokens", token_set(record_text(F.col("text"), F.col("subject"), F.col("tags")), cfg.search_stemming, cfg.search_bigram))


def query_tokens(queries: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """(query_id, token, times, n_query, n_times): a query's distinct tokens, their repeats and both totals."""
    words = queries.select("query_id", tokenize(F.col("query"), cfg.search_stemming, cfg.search_bigram).alias("w"))
    words = words.select("query_id", F.size("w").alias("n_times"), F.size(F.array_distinct("w")).alias("n_query"), F.explode("w").alias("token"))
    return words.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"), F.first("n_query").alias("n_query"), F.first("n_times").alias("n_times"))


def small(tokens: DataFrame) -> bool:
    return tokens.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS


def postings(records: DataFrame, tokens: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """What the pool has of the tokens asked for: id, n_tokens, held (an array), materialised; a record without any is left out."""
    asked = tokens.select("token").distinct()
    rows = with_tokens(records, cfg).select("id", "tokens")
    spark = records.sparkSession
    if small(asked):  # a list of bounded size goes to every task
        wanted = pa.array(sorted(r["token"] for r in asked.collect()), pa.string())

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("tokens")
                flat = pc.list_flatten(lists)
                own = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                good = pc.is_in(flat, value_set=wanted).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[good], minlength=batch.num_rows))])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(good)))
                out = pa.RecordBatch.from_arrays([batch.column("id"), pc.cast(pc.list_value_length(lists), pa.int32()), held], names=["id", "n_tokens", "held"])
                yield out.filter(pa.array(np.diff(ends) > 0))

        return cut(spark, rows.mapInArrow(keep, "id string, n_tokens int, held array<string>"))
    each = rows.select("id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")).join(asked, "token", "left_semi")
    return cut(spark, each.groupBy("id").agg(F.first("n_tokens").alias("n_tokens"), F.collect_list("token").alias("held")))


def idf_table(posted: DataFrame, tokens: DataFrame, n: DataFrame) -> DataFrame:
    """(token, df, idf) of the tokens that are asked for, over the pool; n has one row, the pool's size."""
    df = posted.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    all_ = tokens.select("token").distinct().join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return all_.crossJoin(F.broadcast(n)).select("token", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))  # n is one row


def recency(now: int) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - F.coalesce("lastUsedAt", "observedAt")) / DAY)
    return 1 / (1 + age / 30)


def composite(now: int) -> Column:
    """Relevance, importance and recency; rounded, so that equal records tie in whatever order sums were made."""
    return F.round(0.6 * F.col("relevance") + 0.3 * F.col("importance") + 0.1 * recency(now), 12)


def without_tokens(queries: DataFrame, cfg: Config = DEFAULTS, mode: str = "query") -> DataFrame:
    """(query_id, no_text, no_token) of the queries that have no token to look for but match everything."""
    empty = queries.select("query_id", (normalize_text(F.coalesce("query", F.lit(""))) == "").alias("no_text"), (F.size(tokenize(F.coalesce("query", F.lit("")), cfg.search_stemming, cfg.search_bigram)) == 0).alias("no_token"))
    return empty.where(F.col("no_text") | (F.col("no_token") & F.lit(mode != "memory")))


def _by_tables(posted: DataFrame, asked: list, kind: DataType, near: Callable[[np.ndarray, ...], np.ndarray] | None = None) -> DataFrame:
    """Sums over the tokens that records and queries share, by products of a stripe of records with the table of queries.

    near: of hits, times, informative hits, the records' sizes and the queries' sizes, which pairs can be of use.
    """
    names = sorted({r["query_id"] for r in asked})
    words = sorted({r["token"] for r in asked})
    of_query, of_word = {q: i for i, q in enumerate(names)}, {w: i for i, w in enumerate(words)}
    table = np.zeros((len(words), 4, len(names)))  # hits, times, idf and informative hits
    for r in asked:
        table[of_word[r["token"]], :, of_query[r["query_id"]]] = (1, r["times"], r["idf"], r["informative"])
    table = table.reshape(len(words), -1)
    n_times = np.zeros(len(names))
    for r in asked:
        n_times[of_query[r["query_id"]]] = r["n_times"]
    wanted, ids = pa.array(words, pa.string()), pa.array(names, to_arrow_type(kind))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STRIPE):
                own = batch.slice(a, STRIPE)
                lists = own.column("held")
                row = np.repeat(np.arange(own.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                has = np.zeros((own.num_rows, len(words)))
                has[row, pc.index_in(pc.list_flatten(lists), value_set=wanted).to_numpy(zero_copy_only=False).astype(np.int64)] = 1
                hits, times, raw, told = (has @ table).reshape(own.num_rows, 4, -1).transpose(1, 0, 2)
                size = own.column("n_tokens").to_numpy(zero_copy_only=False)[:, None]
                r, q = np.nonzero((hits > 0) & near(hits, times, told, size, n_times) if near is not None else hits)
                at = pa.array(r)
                columns = [own.column("id").take(at), ids.take(pa.array(q)), pa.array(hits[r, q].astype(np.int64)), pa.array(times[r, q].astype(np.int64)), pa.array(raw[r, q]), pa.array(told[r, q].astype(np.int64)), own.column("n_tokens").take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "query_id", "hits", "times", "raw", "informative", "n_tokens"])

    return posted.mapInArrow(sums, f"id string, query_id {kind.simpleString()}, hits long, times long, raw double, informative long, n_tokens int")


def _by_join(posted: DataFrame, asked: DataFrame, broadcast: bool) -> DataFrame:
    """The same sums where the queries are no table: both sides meet by token."""
    each = posted.repartition("id").select("id", "n_tokens", F.explode("held").alias("token"))
    sides = asked.select("query_id", "token", "times", "idf", "informative")
    pairs = each.join(F.broadcast(sides) if broadcast else sides, "token").groupBy("id", "query_id")
    return pairs.agg(F.count(F.lit(1)).alias("hits"), F.sum("times").alias("times"), F.sum("idf").alias("raw"), F.sum("informative").alias("informative"), F.first("n_tokens").alias("n_tokens"))


def matches(records: DataFrame, queries: DataFrame, cfg: Config = DEFAULTS, mode: str = "query", min_hits: int | None = None, gate: float | None = None) -> DataFrame:
    """Pairs that share a token: query_id, id, match (the gate's number), hits, relevance; those below a gate may be left out."""
    spark = records.sparkSession
    tokens = cut(spark, query_tokens(queries, cfg))
    posted = postings(records, tokens, cfg)
    idf = idf_table(posted, tokens, records.agg(F.count(F.lit(1)).alias("n")))
    asked = cut(spark, tokens.join(idf, "token").withColumn("informative", informative(F.col("token")).cast("long")))
    totals = asked.groupBy("query_id").agg(F.sum("idf").alias("max_idf"), F.first("n_query").alias("n_query"), F.first("n_times").alias("n_times"))
    few = small(asked)
    shape = asked.agg(F.count_distinct("query_id"), F.count_distinct("token")).first() if few else (0, 0)
    if few and shape[0] * shape[1] <= TABLE:
        wanted = cfg.recall_min_hits if min_hits is None else min_hits

        def near(hits, times, told, size, n_times):
            if gate <= 0:
                return np.ones(hits.shape, dtype=bool)
            if mode == "memory":
                return (told >= wanted) & (hits >= (gate - 1e-9) * np.clip(size, 1, 4))
            return times >= (gate - 1e-9) * n_times

        pairs = _by_tables(posted, asked.collect(), queries.schema["query_id"].dataType, None if gate is None else near) if shape[0] else _by_join(posted, asked, True)
    else:
        pairs = _by_join(posted, asked, few)
    pairs = pairs.join(F.broadcast(totals) if few else totals, "query_id")
    if mode == "memory":
        least = cfg.recall_min_hits if min_hits is None else min_hits
        match = F.when(F.col("informative") < least, 0.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.greatest(F.lit(1), F.least(F.lit(4), "n_tokens"))))
    else:
        match = F.col("times") / F.col("n_times")
    longer = 1 + length_penalty(cfg) * F.log2(1 + F.col("n_tokens") / F.col("n_query"))
    return pairs.select("query_id", "id", match.alias("match"), "hits", clamp01(F.col("raw") / (F.col("max_idf") * longer)).alias("relevance"))


def recall(records: DataFrame, queries: DataFrame, now: int, cfg: Config = DEFAULTS, mode: str = "query", limit: int = 8, min_match: float | None = None, min_hits: int | None = None, post_filter: Column | None = None) -> DataFrame:
    """The best records of a pool for each query: query_id, id, match, score, rank.

    Records that don't reach the gate are left out; a query without text gives the pool by importance, one with text but
    without tokens matches everything with relevance 0. post_filter is applied before the top k, never after.
    """
    gate = min_match if min_match is not None else cfg.recall_min_match if mode == "memory" else 0.34
    k = max(1, min(MOST, limit))
    lean = records.select("id", "importance", "confidence", "pinned", "observedAt", "lastUsedAt")
    filtered = records.where(post_filter) if post_filter is not None else records
    found = matches(records, queries, cfg, mode, min_hits, gate).where(F.col("match") >= gate)
    if post_filter is not None:
        found = found.join(filtered.select("id"), "id", "left_semi")
    scored = found.join(lean, "id").withColumn("score", composite(now))
    scored = scored.withColumn("score", F.when(F.col("match") == 0, 0.0).otherwise(F.col("score")))
    empty = without_tokens(queries, cfg, mode)
    names = ["query_id", "id", "match", "score", "pinned", "importance", "confidence"]
    both = scored.select(*names)
    if empty.take(1):
        whole = filtered.select("id", "importance", "confidence", "pinned", "observedAt", "lastUsedAt")
        # one page of the pool by importance serves every query without a token; a query without text has no other order
        first = whole.orderBy(F.col("importance").desc(), F.col("pinned").desc(), F.col("confidence").desc(), "id").limit(k)
        recent = whole.withColumn("s", 0.3 * F.col("importance") + 0.1 * recency(now)).orderBy(F.col("s").desc(), F.col("pinned").desc(), F.col("importance").desc(), F.col("confidence").desc(), "id").limit(k).drop("s")
        no_text = empty.where("no_text").crossJoin(F.broadcast(first)).select("query_id", "id", F.lit(1.0).alias("match"), F.col("importance").alias("score"), "pinned", "importance", "confidence")  # k rows
        no_token = empty.where("not no_text").crossJoin(F.broadcast(recent)).select("query_id", "id", F.lit(1.0).alias("match"), (0.3 * F.col("importance") + 0.1 * recency(now)).alias("score"), "pinned", "importance", "confidence")  # k rows
        both = both.unionByName(no_text).unionByName(no_token)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("pinned").desc(), F.col("importance").desc(), F.col("confidence").desc(), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "match", "score", "rank")


def legacy_score(records: DataFrame, queries: DataFrame, now: int, cfg: Config = DEFAULTS) -> DataFrame:
    """The older score, which callers' thresholds rely on: query_id, id, score, over the pairs that share a token.

    The plain share of the query's tokens, repeats included, takes the place of relevance.
    """
    lean = records.select("id", "importance", "observedAt", "lastUsedAt")
    found = matches(records, queries, cfg).join(lean, "id")
    return found.select("query_id", "id", F.round(0.6 * F.col("match") + 0.3 * F.col("importance") + 0.1 * recency(now), 12).alias("score"))


def _shares(posted: DataFrame, asked: list, kind: DataType) -> DataFrame:
    """A row for each token that a record and a query share, with the pair's sum of idf: records stream past the queries' tokens."""
    asked = sorted(asked, key=lambda r: (r["token"], r["query_id"]))
    names, words = sorted({r["query_id"] for r in asked}), sorted({r["token"] for r in asked})
    of_query, of_word = {q: i for i, q in enumerate(names)}, {w: i for i, w in enumerate(words)}
    query = np.array([of_query[r["query_id"]] for r in asked], dtype=np.int64)
    begin = np.searchsorted([of_word[r["token"]] for r in asked], np.arange(len(words) + 1))
    idf, n_query = np.array([r["idf"] for r in asked], dtype=np.float64), np.array([r["n_query"] for r in asked], dtype=np.int32)
    most = np.bincount(query, idf, len(names))  # added one by one in the order of rows, which is that of tokens
    wanted, ids = pa.array(words, pa.string()), pa.array(names, to_arrow_type(kind))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column("held")
            own = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = pc.index_in(pc.list_flatten(lists), value_set=wanted)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            own, at = own[known], at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((at, own))
            own, at = own[order], at[order]
            times = begin[at + 1] - begin[at]
            before = np.concatenate([[0], np.cumsum(times)])
            first = np.searchsorted(own, np.arange(n + 1))
            a = 0
            while a < n:
                b = int(np.searchsorted(before[first], before[first[a]] + ROWS, "right")) - 1
                b = max(a + 1, min(b, a + TABLE // len(names)))
                s = slice(first[a], first[b])
                place = np.repeat(begin[at[s]] - before[s] + before[first[a]], times[s]) + np.arange(before[first[b]] - before[first[a]])
                row, asks = np.repeat(own[s], times[s]), query[place]
                pair = (row - a) * len(names) + asks
                r, w = pa.array(row), pa.array(np.repeat(at[s], times[s]))
                columns = [batch.column("id").take(r), ids.take(pa.array(asks)), wanted.take(w), pa.array(idf[place]), pa.array(np.bincount(pair, idf[place])[pair]), pa.array(most[asks]), batch.column("n_tokens").take(r), pa.array(n_query[place])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "query_id", "token", "idf", "raw", "max_idf", "n_tokens", "n_query"])
                a = b

    return posted.mapInArrow(shares, f"id string, query_id {kind.simpleString()}, token string, idf double, raw double, max_idf double, n_tokens int, n_query int")


def explain(records: DataFrame, queries: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Which tokens of a query a record has and what each adds: query_id, id, token, contribution, score, passes.

    A row for each pair and token; contributions add up to the score. Sums are made in the order of tokens, so that a score at the
    gate passes or doesn't whatever the partitions are, and a record with all of a query's tokens has exactly the query's sum.
    """
    tokens = cut(records.sparkSession, query_tokens(queries, cfg))
    posted = postings(records, tokens, cfg)
    idf = idf_table(posted, tokens, records.agg(F.count(F.lit(1)).alias("n")))
    asked = cut(records.sparkSession, tokens.where(F.col("query_id").isNotNull()).join(idf, "token"))
    if small(asked):
        rows = _shares(posted, asked.select("query_id", "token", "idf", "n_query").collect(), queries.schema["query_id"].dataType)
    else:
        whole = (Window.unboundedPreceding, Window.unboundedFollowing)
        asked = asked.withColumn("max_idf", F.sum("idf").over(Window.partitionBy("query_id").orderBy("token").rowsBetween(*whole)))
        pair = Window.partitionBy("id", "query_id").orderBy("token").rowsBetween(*whole)
        each = posted.repartition("id").select("id", "n_tokens", F.explode("held").alias("token"))
        rows = each.join(asked, "token").withColumn("raw", F.sum("idf").over(pair))
    longer = 1 + length_penalty(cfg) * F.log2(1 + F.col("n_tokens") / F.col("n_query"))
    rows = rows.withColumn("score", clamp01(F.col("raw") / (F.col("max_idf") * longer)))
    return rows.select("query_id", "id", "token", (F.col("idf") * F.col("score") / F.col("raw")).alias("contribution"), "score", (F.col("score") >= cfg.recall_min_match).alias("passes"))


def semantic(pool: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, now: int, cfg: Config = DEFAULTS, mode: str = "semantic", limit: int = 8) -> DataFrame:
    """Rank a pool by cosine (semantic) or by cosine blended with the composite score (hybrid): query_id, id, score, rank, fallback.

    vectors: id, vector; query_vectors: query_id, vector. A negative or missing cosine counts as 0; equal scores are in order of
    pins, importance, confidence and id. If a query's vector and a record's differ in length, or one has components that are
    not finite, all of the query's results fall back to the lexical ones; the column `fallback` says so.

    Blocks of queries meet blocks of records, each in one task; cosines alone keep a page of a block for each query.
    """
    k = max(1, min(MOST, limit))
    own = pool.select("id", "pinned", "importance", "confidence").join(vectors.select("id", "vector"), "id")
    lengths = own.select(F.size("vector").alias("n"), finite(F.col("vector")).alias("ok")).groupBy("n", "ok").count().limit(3).collect()
    whole = [r["n"] for r in lengths if r["ok"]] if len(lengths) == 1 else []  # else no query's vector fits all records'
    asked = query_vectors.select("query_id", "vector").where(finite(F.col("vector")) & F.size("vector").isin(whole)) if whole else query_vectors.select("query_id", "vector").limit(0)
    if mode == "hybrid":
        # the lexical score of every pair, not of a page of them: what is low there can be high in the blend
        found = matches(pool, queries, cfg).join(own.select("id"), "id", "left_semi").select("query_id", "id", "match", "relevance")
        lean = pool.select("id", "importance", "observedAt", "lastUsedAt")
        good = tiles(asked, own).join(found, ["query_id", "id"], "left").join(lean, "id").join(without_tokens(queries, cfg), "query_id", "left")
        lexical = F.when(F.col("no_text"), F.col("importance")).when(F.col("no_token"), 0.3 * F.col("importance") + 0.1 * recency(now)).when(F.col("match") > 0, composite(now)).otherwise(0.0)
        good = good.withColumn("score", blend(lexical, F.greatest(F.lit(0.0), "cosine"), blend_weight(cfg))).select("query_id", "id", "score")
    else:
        good = tiles(asked, own, k).select("query_id", "id", F.greatest(F.lit(0.0), "cosine").alias("score"))
    fall = recall(pool, queries, now, cfg, "query", MOST).join(asked.select("query_id"), "query_id", "left_anti")
    good = good.select("query_id", "id", F.round("score", 12).alias("score"), F.lit(False).alias("fallback"))
    both = good.unionByName(fall.select("query_id", "id", "score", F.lit(True).alias("fallback"))).join(pool.select("id", "pinned", "importance", "confidence"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ranking()))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank", "fallback")


def diagnostics(mode: str, hits: DataFrame | None, candidates: int, vectors: int, reason: str | None = None) -> dict[str, object]:
    """What a semantic search did: mode, whether vectors were used, why not, and how many candidates and vectors there were."""
    fell = reason or (None if hits is None or not hits.where("fallback").take(1) else "embed-error")
    return {"mode": mode, "used": fell is None, "fallback": fell, "candidates": candidates, "vectors": vectors if fell is None else 0}


def rescore(hits: DataFrame, records: DataFrame, vectors: DataFrame, query_vectors: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The same hits (query_id, id, match, score) in the order of the blended score; none is added and none goes.

    One without a vector of the query's length keeps its score. Ties are in the order of records.
    """
    rows = hits.join(vectors.select("id", F.col("vector").alias("v")), "id", "left").join(query_vectors.select("query_id", F.col("vector").alias("q")), "query_id", "left")
    near = F.when(F.size("q") == F.size("v"), F.greatest(F.lit(0.0), F.coalesce(cosine(F.col("q"), F.col("v")), F.lit(0.0))))
    rows = rows.withColumn("score", F.round(F.when(near.isNull(), F.col("score")).otherwise(blend(F.col("score"), near, blend_weight(cfg))), 12))
    rows = rows.join(records.select("id", "pinned", "importance", "confidence"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ranking()))
    return rows.withColumn("rank", rank).select("query_id", "id", "match", "score", "rank")


def evaluate(records: DataFrame, queries: DataFrame, expected: DataFrame, now: int, cfg: Config = DEFAULTS) -> DataFrame:
    """How often the expected record (query_id, id) comes first or among the first three, and how often anything comes."""
    hits = recall(records, queries, now, cfg, "query", 8)
    best = hits.join(expected.withColumn("expected", F.lit(True)), ["query_id", "id"], "left").groupBy("query_id").agg(F.min(F.when(F.col("expected"), F.col("rank"))).alias("place"))
    rows = queries.select("query_id").join(best.withColumn("hit", F.lit(True)), "query_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("place") == 1, F.lit(False)).cast("double")).alias("top1"), F.avg(F.coalesce(F.col("place") <= 3, F.lit(False)).cast("double")).alias("top3"), F.avg(F.coalesce("hit", F.lit(False)).cast("double")).alias("trigger_rate"))


def witnessed(records: DataFrame, messages: DataFrame, cfg: Config = DEFAULTS, most: int = WITNESSES) -> DataFrame:
    """The query_id of messages that some of the longest records already bring up in memory mode; the others are not decided.

    The gate asks for tokens in common and nothing about the rest of the pool, so that any one record settles a message.
    """
    few = with_tokens(records.where(F.length("text") <= WITNESS_CHARS).orderBy(F.length("text").desc(), "id").limit(most), cfg).select("tokens").collect()
    held = [sorted(r["tokens"]) for r in few]
    words = sorted(set().union(*held))
    index = {w: i for i, w in enumerate(words)}
    has = np.zeros((len(words), len(held)), dtype=bool)
    for j, tokens in enumerate(held):
        has[[index[t] for t in tokens], j] = True
    told = np.array([len(w) >= 2 and not w.isdecimal() for w in words], dtype=bool)
    sizes = np.clip(np.array([len(t) for t in held], dtype=np.int64), 1, 4)
    wanted, least, gate = pa.array(words, pa.string()), cfg.recall_min_hits, cfg.recall_min_match

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            own = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = pc.index_in(pc.list_flatten(lists), value_set=wanted)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            own, at = own[known], at.drop_null().to_numpy(zero_copy_only=False)
            hit = np.zeros(batch.num_rows, dtype=bool)
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            if len(begin):
                table = has[at]
                hits, informed = np.add.reduceat(table, begin, dtype=np.int64), np.add.reduceat(table & told[at][:, None], begin, dtype=np.int64)
                hit[own[begin]] = ((hits > 0) & (informed >= least) & (np.minimum(1.0, hits / sizes) >= gate)).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").filter(pa.array(hit))], names=["query_id"])

    kind = messages.schema["query_id"].dataType.simpleString()
    return messages.select("query_id", token_set(F.coalesce("query", F.lit("")), cfg.search_stemming, cfg.search_bigram).alias("w")).mapInArrow(settle, f"query_id {kind}")


def triggers(records: DataFrame, messages: DataFrame, now: int, cfg: Config = DEFAULTS, long: int = 20) -> DataFrame:
    """How many messages (query_id, query) bring anything up, short and long ones apart: bucket, total, triggered.

    Most messages have enough in common with one of a few long records; only the others are looked for in the whole pool.
    """
    settled = cut(records.sparkSession, witnessed(records, messages, cfg).distinct())
    rest = cut(records.sparkSession, messages.join(settled, "query_id", "left_anti"))
    hits = settled
    if rest.take(1):
        hits = hits.unionByName(recall(records, rest, now, cfg, "memory", cfg.recall_top_k).select("query_id").distinct())
    bucket = F.when(F.length("query") >= long, "long").otherwise("short").alias("bucket")
    return messages.join(hits.withColumn("hit", F.lit(1)), "query_id", "left").groupBy(bucket).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("triggered"))


def latency(timings: DataFrame, column: str = "ms", shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """samples, p50, p95 and max of measured times: the values at those places of the sorted list, none in between; 0 without any."""
    rows = timings.where(F.col(column).isNotNull())
    n = rows.count()
    values = [F.expr(f"percentile_disc({(int(n * q) + 0.5) / n!r}D) within group (order by `{column}`)").alias(f"p{round(100 * q)}") if n else F.lit(0.0).alias(f"p{round(100 * q)}") for q in shares]
    return rows.agg(F.count(F.lit(1)).alias("samples"), *values, F.coalesce(F.max(column), F.lit(0.0)).alias("max"))


def turn_recall(records: DataFrame, turns: DataFrame, lines: DataFrame, last: DataFrame, now: int, cfg: Config = DEFAULTS, most: int | None = None) -> DataFrame:
    """What turns bring up: no line that is shown already, no other workspace's, nothing within its cooldown.

    turns: query_id, query (short ones bring nothing), turn, workspace; lines: query_id, line; last: query_id, id, last_turn (when
    a record was last shown). Returns query_id, rank, id, kind, text, match, score; what is left out makes room for the next, up to
    `most` (else as many as are shown).
    """
    from memlake.operators.filters import active, workspace_recall

    asked = turns.where(F.length(F.trim("query")) >= cfg.recall_min_query_chars)
    pool = records.where(active() & (F.col("kind") != "agent_self"))
    plain = lambda c: F.md5(normalize_text(c).cast("binary"))  # noqa: E731 - texts themselves join what is shown, and no pair before
    lean = pool.select("id", plain(F.col("text")).alias("plain"), "kind", "scope", "importance", "confidence", "pinned", "observedAt", "lastUsedAt")
    # the whole pool has the say in how rare a token is
    found = matches(records.where(active()), asked.select("query_id", "query"), cfg, "memory", gate=cfg.recall_min_match).where(F.col("match") >= cfg.recall_min_match)
    found = found.join(lean, "id").join(asked.select("query_id", "turn", "workspace"), "query_id")
    found = found.where(workspace_recall(F.col("workspace"))).drop("kind")
    shown = lines.select("query_id", plain(F.regexp_replace(F.regexp_replace("line", r"^[-*\s]+", ""), r"^\([a-z_]+\)\s*", "")).alias("plain")).distinct()
    found = found.join(shown, ["query_id", "plain"], "left_anti").join(last, ["query_id", "id"], "left")
    found = found.where(F.col("turn") - F.coalesce("last_turn", F.lit(-999)) >= cfg.recall_cooldown_turns).withColumn("score", composite(now))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ranking())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (cfg.recall_top_k if most is None else most))
    return best.join(pool.select("id", "kind", "text"), "id").select("query_id", "rank", "id", "kind", "text", "match", "score")


def corrected(records: DataFrame, corrections: DataFrame, now: int, cfg: Config = DEFAULTS) -> DataFrame:
    """The record that each correction (query_id, query) is about, whose slot it takes over: query_id, id, subject, field, value."""
    from memlake.operators.filters import active

    pool = records.where(active())
    best = recall(pool, corrections, now, cfg, "memory", 1, min_match=0.3, min_hits=1)
    return best.select("query_id", "id").join(pool.select("id", "subject", "field", "value"), "id").select("query_id", "id", "subject", "field", "value")
