"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its words and their beginnings (hashed); a document's is the noisy-or of its sentences'. The
weights are trained from document labels through the noisy-or, so the model finds the offending sentences by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from memlake.llm.common import RunHasher, bound_batches, held_out, lean, release, rows_where, text_chunks, word_runs

#: Labelled documents that a model is fitted on at most: those whose ids come first by hash.
FIT_ROWS = 8000
#: Buckets of words and of their beginnings.
BUCKETS = 1 << 20
#: Bytes of the beginnings of words that count as words do.
STEMS = (4, 5)
#: Documents that a word must be in to have a weight, and how many standard deviations more or less toxic than chance.
MIN_DOCS, DEVIATIONS = 4, 3.0
THRESHOLD = 0.7

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def instances(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words and their beginnings: bucket and sentence; of its sentences: document, start and end in bytes."""
    start, end = word_runs(chunk.data, _WORD)
    hasher = RunHasher(chunk.data)
    stops = np.flatnonzero(_STOP[chunk.data])  # each document ends with one
    sentence = np.searchsorted(stops, start)
    used, sentence = np.unique(sentence, return_inverse=True) if len(start) else (np.empty(0, np.int64), sentence)
    to = stops[used]
    begin = np.where(used > 0, stops[used - 1] + 1, 0) if len(used) else used
    hashes, owners = [hasher(start, end)], [sentence]
    for n in STEMS:
        longer = end - start > n
        hashes.append(hasher(start[longer], start[longer] + n) + np.uint64(n << 44))
        owners.append(sentence[longer])
    bucket = (np.concatenate(hashes) >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)
    return bucket, np.concatenate(owners), np.searchsorted(chunk.end, to), begin, to


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 200, rate: float = 0.2) -> dict:
    """Train by full-batch Adam on the noisy-or likelihood; buckets that tell too little are left out."""
    if not len(labels) or labels.min() == labels.max():
        return {"buckets": np.empty(0, np.int64), "weights": np.empty(0), "bias": 0.0 if len(labels) and labels.max() else -20.0}
    column = pa.array(texts, pa.string())
    df, df_toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for chunk in text_chunks(column):
        bucket, sentence, doc, _, _ = instances(chunk)
        pair = np.unique(bucket * len(labels) + chunk.rows[doc[sentence]])
        df += np.bincount(pair // len(labels), minlength=BUCKETS)
        df_toxic += np.bincount(pair // len(labels), weights=labels[pair % len(labels)], minlength=BUCKETS)
    base = labels.mean()
    buckets = np.flatnonzero((df >= MIN_DOCS) & (np.abs(df_toxic - df * base) > DEVIATIONS * np.sqrt(df * base * (1 - base) + 1e-9)))
    index = np.full(BUCKETS, -1)
    index[buckets] = np.arange(len(buckets))
    words, sentences, docs, n_sentences = [], [], [], 0
    for chunk in text_chunks(column):
        bucket, sentence, doc, _, _ = instances(chunk)
        own = index[bucket]
        pair = np.unique(own[own >= 0] * max(1, len(doc)) + sentence[own >= 0])  # a word counts once in a sentence
        words.append(pair // max(1, len(doc)))
        sentences.append(pair % max(1, len(doc)) + n_sentences)
        docs.append(chunk.rows[doc])
        n_sentences += len(doc)
    word, sentence, doc = np.concatenate(words), np.concatenate(sentences), np.concatenate(docs)
    y = labels.astype(float)
    share = (df_toxic[buckets] + base) / (df[buckets] + 1)
    theta = np.append(np.clip(np.log(share / (1 - share + 1e-6) / (base / (1 - base))), -1, 6), -8.0)  # the last is the bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weights=theta[word], minlength=n_sentences) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.maximum(np.bincount(doc, weights=softplus(z), minlength=len(y)), 1e-9)  # -log of the chance that no sentence is toxic
        g_doc = np.where(y > 0, -1 / np.expm1(np.minimum(none, 30)), 1.0)
        g = g_doc[doc] * p
        grad = np.append(np.bincount(word, weights=g[sentence], minlength=len(buckets)), g.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (rounds + 1))
    return {"buckets": buckets, "weights": theta[:-1], "bias": float(theta[-1])}


def scores(text: pa.Array, weight: np.ndarray, bias: float) -> tuple[np.ndarray, ...]:
    """Of each text: its score, and the score, start and end (in bytes) of its most offending sentence."""
    n = len(text)
    score, worst, begin, stop = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for chunk in text_chunks(text):
        bucket, sentence, doc, a, b = instances(chunk)
        if not len(doc):
            continue
        known = weight[bucket] != 0
        pair = np.unique(sentence[known] * BUCKETS + bucket[known])
        z = np.bincount(pair // BUCKETS, weights=weight[pair % BUCKETS], minlength=len(doc)) + bias
        none = np.bincount(doc, weights=softplus(z), minlength=len(chunk.rows))
        score[chunk.rows] = -np.expm1(-none)
        last = np.lexsort((-a, z, doc))  # a document's last: its worst sentence, the first of equal ones
        top = last[np.append(doc[last][1:] != doc[last][:-1], True)]
        rows = chunk.rows[doc[top]]
        worst[rows] = 1 / (1 + np.exp(-np.clip(z[top], -30, 30)))
        begin[rows], stop[rows] = a[top] - chunk.start[doc[top]], b[top] - chunk.start[doc[top]]
    return score, worst, begin, stop


def weights(model: dict) -> np.ndarray:
    out = np.zeros(BUCKETS)
    out[model["buckets"]] = model["weights"]
    return out


@lean
def score_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Every column as it is, and score, worst_score, worst_start and worst_end."""
    weight = weights(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores(batch.column("text"), weight, model["bias"]))], names=[*batch.schema.names, "score", "worst_score", "worst_start", "worst_end"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, limit: int) -> DataFrame:
    """At most `limit` labelled rows that aren't held out (text, label), those whose ids come first by hash.

    A document with several labels counts once, with the largest; rows with a null id or label teach nothing.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    marked = marked.where(~held_out(F.col("doc_id"), modulus, remainder)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fit_rows_of(rows: DataFrame, fit: Callable[[list[str | None], np.ndarray], dict]) -> dict:
    """A model fitted on the driver on training rows, a bounded number; their memory goes back before anything else runs."""
    table = rows.orderBy("doc_id").select("text", "label").toArrow()
    model = fit(table["text"].to_pylist(), table["label"].to_numpy().astype(np.int64))
    del table
    release(rows.sparkSession)
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on at most `fit_rows` labelled documents that aren't held out, chosen by a hash of their ids.

    Null ids and labels teach nothing, a null text is empty, and a document that repeats counts once. Without labels, or with one
    kind alone, the model has no words and gives every text that has some the same score.
    """
    return fit_rows_of(training_rows(docs, labels, "toxic", 3, 1, fit_rows), fit)


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """Add score, worst_score, worst_start and worst_end to rows with a text.

    Other columns stay, but for those of the four names, which are replaced. A null or empty text, or one without words, scores 0.
    Repeated rows score alike, each by itself; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    made = ("score", "worst_score", "worst_start", "worst_end")
    fields = [f for f in docs.schema.fields if f.name not in made]
    plain = ["text" if f.name == "text" else f"c{i}" for i, f in enumerate(fields)]
    rows = docs.select(*[F.col("`" + f.name.replace("`", "``") + "`").alias(n) for f, n in zip(fields, plain, strict=True)])
    schema = StructType([*(StructField(n, f.dataType) for f, n in zip(fields, plain, strict=True)), *(StructField(n, kind) for n, kind in zip(made, (DoubleType(), DoubleType(), LongType(), LongType()), strict=True))])
    return rows.mapInArrow(lambda b: score_batches(b, model), schema).toDF(*(f.name for f in fields), *made)


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score less than the threshold; texts without words score 0.

    Null ids make no difference, repeated rows stay or go together, an empty table gives no rows; columns may have any names.
    """
    bound_batches(docs.sparkSession)

    def make():
        weight = weights(model)
        return lambda text: scores(text, weight, model["bias"])[0] < threshold

    return rows_where(docs, make)
