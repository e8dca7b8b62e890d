"""Language identification by a byte-level convolutional network trained in numpy.

Bytes are embedded, filters of several widths run over them, the largest response of each filter in a window is kept, and a
softmax layer gives the languages. Texts are cut into windows of a fixed length, all of them scored in batches; a document's
prediction is the mean of its windows' log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bound_batches, held_out, lean, release, text_chunks

#: Labelled documents that a model is fitted on at most: those whose ids come first by hash.
FIT_ROWS = 3000
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
STEPS = 500
BATCH = 96

_FOLD = np.arange(256)
_FOLD[:33] = 32
_FOLD[65:91] += 32


def window_starts(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of some byte ranges begin, and the range of each."""
    n = -(-(end - start) // WINDOW)
    doc = np.repeat(np.arange(len(start)), n)
    return np.repeat(start - (np.cumsum(n) - n) * WINDOW, n) + np.arange(len(doc)) * WINDOW, doc


def window_bytes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of some windows, padded with spaces from where their ranges end."""
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], _FOLD[data[np.minimum(at, len(data) - 1)]], 32).astype(np.uint8)


def windows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some byte ranges, and the range of each."""
    first, doc = window_starts(start, end)
    return window_bytes(data, first, end[doc]), doc


def init(n_classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
    kernel = rng.normal(0, 0.3, (wide * EMBED, total)).astype(np.float32)
    for i, width in enumerate(WIDTHS):
        kernel[width * EMBED :, i * FILTERS : (i + 1) * FILTERS] = 0
    return {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "kernel": kernel, "shift": np.zeros(total, np.float32), "out": rng.normal(0, 0.1, (total, n_classes)).astype(np.float32), "bias": np.zeros(n_classes, np.float32)}


def unfold(x: np.ndarray, embed: np.ndarray) -> np.ndarray:
    wide = max(WIDTHS)
    e = embed[x]
    n = x.shape[1] - wide + 1
    return np.concatenate([e[:, j : j + n] for j in range(wide)], axis=2)


def forward(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-probabilities of the classes for windows of bytes."""
    cols = unfold(x, model["embed"])
    n, m, k = cols.shape
    top = (cols.reshape(n * m, k) @ model["kernel"]).reshape(n, m, -1).max(axis=1)
    z = np.maximum(top + model["shift"], 0) @ model["out"] + model["bias"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 7) -> dict:
    """Adam on windows drawn from all windows of the texts, languages in equal shares."""
    classes = sorted(set(labels))
    model = init(max(1, len(classes)), np.random.default_rng(seed)) | {"classes": classes}
    if len(classes) < 2:
        return model
    rng = np.random.default_rng(seed + 1)
    chunk = next(text_chunks(pa.array(texts, pa.string()), 1 << 62))  # the rows to fit on are bounded
    first, doc = window_starts(chunk.start, chunk.end)
    y = np.searchsorted(classes, np.array(labels))[doc]
    by = [np.flatnonzero(y == c) for c in range(len(classes))]
    by = [b for b in by if len(b)]
    keys = ("embed", "kernel", "shift", "out", "bias")
    m, v = ({k: np.zeros_like(model[k]) for k in keys} for _ in range(2))
    mask = model["kernel"] != 0
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, BATCH // len(by)) for b in by])
        xb, yb = window_bytes(chunk.data, first[pick], chunk.end[doc[pick]]), y[pick]
        roll = int(rng.integers(0, WINDOW // 2))
        xb = np.roll(xb, -roll, axis=1)
        short = rng.random(len(xb)) < 0.3
        xb[np.ix_(short, np.arange(int(rng.integers(16, WINDOW)), WINDOW))] = 32
        cols = unfold(xb, model["embed"])
        n, l, k = cols.shape
        conv = (cols.reshape(n * l, k) @ model["kernel"]).reshape(n, l, -1)
        arg = conv.argmax(axis=1)
        h = np.take_along_axis(conv, arg[:, None, :], 1)[:, 0] + model["shift"]
        act = np.maximum(h, 0)
        z = act @ model["out"] + model["bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), yb] -= 1
        p /= n
        gh = (p @ model["out"].T) * (h > 0)
        picked = np.take_along_axis(cols, arg[:, :, None], 1)  # n, filters, k
        gcols = gh[:, :, None] * model["kernel"].T[None]
        gembed = np.zeros_like(model["embed"])
        for j in range(max(WIDTHS)):
            np.add.at(gembed, xb[np.arange(n)[:, None], arg + j], gcols[:, :, j * EMBED : (j + 1) * EMBED])
        grads = {"embed": gembed, "kernel": np.einsum("nf,nfk->kf", gh, picked) * mask, "shift": gh.sum(0), "out": act.T @ p, "bias": p.sum(0)}
        step = 0.02 * (1 - t / (steps + 1)) + 1e-4
        for key in keys:
            g = grads[key].astype(np.float32)
            m[key] = 0.9 * m[key] + 0.1 * g
            v[key] = 0.98 * v[key] + 0.02 * g * g
            model[key] = model[key] - step * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.98**t)) + 1e-8)
    return model


@lean
def predict_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out as they are, lang_pred and score."""
    classes = np.array([*model["classes"], "und"], dtype=object)
    for batch in batches:
        n = batch.num_rows
        text = pc.fill_null(batch.column("text"), "")
        known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
        pred, score = np.full(n, len(classes) - 1), np.zeros(n)
        for chunk in text_chunks(text, 1 << 18):
            x, doc = windows(chunk.data, chunk.start, chunk.end)
            total, count = np.zeros((len(chunk.rows), max(1, len(model["classes"])))), np.bincount(doc, minlength=len(chunk.rows))
            for a in range(0, len(x), 512):
                np.add.at(total, doc[a : a + 512], forward(model, x[a : a + 512]))
            mean = total / np.maximum(count, 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            ok = known[chunk.rows] & (len(model["classes"]) > 0)
            pred[chunk.rows] = np.where(ok, p.argmax(axis=1), len(classes) - 1)
            score[chunk.rows] = np.where(ok, p.max(axis=1), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(classes[pred], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, modulus: int = 4, remainder: int = 2) -> dict:
    """Fit on at most `fit_rows` documents with a text and a language that aren't held out, chosen by a hash of their ids."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"), modulus, remainder))
    # ids are chosen first, so that tasks send the texts of the chosen alone
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    some = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    model = fit(some["text"].to_pylist(), some["lang"].to_pylist())
    del some
    release(docs.sparkSession)
    return model


def identify_language(docs: DataFrame, model: dict, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0. A null doc_id stays null and is held out; repeated rows are
    judged each by itself; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    return rows.mapInArrow(lambda b: predict_batches(b, model), "doc_id long, held_out boolean, lang_pred string, score double")
