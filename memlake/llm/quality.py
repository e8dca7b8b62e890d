"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and its diagonal. A document's score is the logistic of
the difference of the classes' log-densities, Mahalanobis distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bound_batches, held_out, lean, run_hashes, text_chunks, word_runs
from memlake.llm.toxicity import fit_rows_of, training_rows

#: Labelled documents that a model is fitted on at most: those whose ids come first by hash.
FIT_ROWS = 6000
THRESHOLD = 0.7

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_CLASS = np.zeros((256, 6), dtype=bool)  # lower, upper, digit, sentence mark, other ASCII mark, beyond ASCII
_CLASS[97:123, 0] = True
_CLASS[65:91, 1] = True
_CLASS[48:58, 2] = True
_CLASS[[ord(c) for c in ".,;:'\"!?-"], 3] = True
_CLASS[33:127, 4] = ~_CLASS[33:127, :4].any(axis=1)
_CLASS[128:, 5] = True
_KIND = np.where(_CLASS.any(axis=1), _CLASS.argmax(axis=1), 6).astype(np.uint8)


def statistics(chunk) -> np.ndarray:
    """Transformed statistics, a row for each of the chunk's documents; all zero without words."""
    data, n_docs = chunk.data, len(chunk.rows)
    size = np.maximum(chunk.end - chunk.start, 1).astype(float)
    doc_start = chunk.start
    kind = _KIND[data]

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (total[chunk.end] - total[doc_start]).astype(float)

    shares = [per_doc(kind == k) / size for k in range(6)]
    bang = per_doc(data == 33) / size
    start, end = word_runs(data, ~_SPACE)
    doc = np.searchsorted(doc_start, start, side="right") - 1
    n = np.bincount(doc, minlength=n_docs).astype(float)
    some = np.maximum(n, 1)
    length = (end - start).astype(float)
    mean = np.bincount(doc, weights=length, minlength=n_docs) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n_docs) / some - mean**2, 0))
    alone = np.bincount(doc, weights=(kind[start] >= 2) & (kind[start] <= 4) & (length == 1), minlength=n_docs) / some
    tail = np.bincount(doc, weights=np.isin(kind[end - 1], (2, 4)), minlength=n_docs) / some
    h = run_hashes(data, start, end)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], weights=fresh, minlength=n_docs)
    # runs of three words that are there again in the document
    tri = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else np.empty(0, np.uint64)
    same = doc[:-2] == doc[2:] if len(h) > 2 else np.empty(0, bool)
    tri, tri_doc = tri[same], doc[:-2][same] if len(h) > 2 else np.empty(0, np.int64)
    order = np.lexsort((tri, tri_doc))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (tri[order][1:] == tri[order][:-1]) & (tri_doc[order][1:] == tri_doc[order][:-1])
    repeats = np.bincount(tri_doc[order], weights=again, minlength=n_docs) / np.maximum(n - 2, 1)
    lines = per_doc(data == 10) + 1
    root = np.sqrt
    out = np.column_stack([np.log1p(n), *map(root, shares), root(bang), np.log1p(mean), np.log1p(spread), root(alone), root(tail), distinct / some**0.9, root(repeats), np.log1p(n / lines)])
    out[n == 0] = 0
    return out


def fit(texts: list[str | None], labels: np.ndarray, shrink: float = 0.1, ridge: float = 1e-3) -> dict:
    """Means, Cholesky factors and log-determinants of two classes; shrink: the share of pooled and diagonal covariance."""
    x = np.concatenate([np.empty((0, 15)), *(statistics(c) for c in text_chunks(pa.array(texts, pa.string())))])
    if len(x) < 2 or labels.min() == labels.max():
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    pooled = np.cov(z.T, bias=True)
    model = {"centre": centre, "scale": scale, "classes": []}
    for c in (0, 1):
        own = z[labels == c]
        cov = np.cov(own.T, bias=True) if len(own) > 1 else pooled
        weight = min(1.0, shrink + z.shape[1] / (len(own) + z.shape[1]))
        cov = (1 - weight) * cov + weight * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + ridge * np.eye(z.shape[1])
        factor = np.linalg.cholesky(cov)
        model["classes"].append((own.mean(axis=0), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(len(own) / len(z))))
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = (x - model["centre"]) / model["scale"]
    density = [prior - 0.5 * (log_det + (((z - mean) @ inverse.T) ** 2).sum(axis=1)) for mean, inverse, log_det, prior in model["classes"]]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


@lean
def score_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for chunk in text_chunks(batch.column("text")):
            out[chunk.rows] = score(model, statistics(chunk))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on at most `fit_rows` labelled documents that aren't held out, chosen by a hash of their ids.

    Null ids and labels teach nothing, a null text is empty, and a document that repeats counts once. Without labels, or with one
    kind alone, every document gets the same score.
    """
    return fit_rows_of(training_rows(docs, labels, "quality", 4, 2, fit_rows), fit)


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    A null or empty text has statistics of zero and is scored on them. A null doc_id stays null and is held out; repeated
    rows are scored each by itself; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(lambda b: score_batches(b, model), "doc_id long, held_out boolean, score double, predicted int")
