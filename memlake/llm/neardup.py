"""Near-duplicates by SetSketch registers.

A document's set of word shingles is hashed; for each of many linear hash functions the set's minimum becomes an exponentially
distributed value, and its logarithm to a small base, truncated to 16 bits, a register. Registers of a union are the maxima of
its parts' registers, and they agree for similar sets. Bands of registers propose pairs; a maximum-likelihood estimate of the
similarity from how many registers are greater, smaller and equal sets unlikely ones aside; the rest is confirmed on full sets.

Equal sets are one node. In a bucket of a band, documents are compared with one centre, never with each other: the centre is
the document that shares buckets with most others, whose links join most of a large group. Documents of buckets that then still
hold several components are joined exactly: by the rarest elements of their sets, as many as two linked sets must share one
of, with a bound from the elements' places. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import U64, Chunk, bound_batches, cut, lean, mix, release, run_hashes, source_bytes, text_chunks, word_runs

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
REGISTERS, BAND = 128, 4
#: Parameters of the registers: base, rate and largest value.
BASE, RATE, LARGEST = 1.001, 20.0, 65535
#: How far the estimate may lie below the threshold; about five standard deviations.
MARGIN = 0.2
#: Rounds with one centre in a bucket before the exact join of what is left.
ROUNDS = 1

_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint64) | U64(1)).astype(np.uint32)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(chunk: Chunk) -> list[np.ndarray]:
    """Of each of the chunk's documents: the sorted distinct hashes of its shingles."""
    start, end = word_runs(chunk.data, ~_SPACE)
    words = run_hashes(chunk.data, start, end)
    first, last = np.searchsorted(start, chunk.start), np.searchsorted(start, chunk.end)
    n = len(words) - SHINGLE + 1
    whole = np.zeros(max(n, 0), U64)
    for j in range(SHINGLE):
        whole += words[j : j + len(whole)] * _PLACE[j]
    whole = mix(whole)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(whole[a : b - SHINGLE + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _PLACE[: b - a]).sum() + U64(b - a)], dtype=U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (elements >> U64(32)).astype(np.uint32)
    for a in range(0, len(short), 8192):
        np.minimum(least, (_FACTORS[:, None] * short[None, a : a + 8192]).min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The SetSketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of most likelihood, for rows of registers and the sizes of the sets."""
    greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    more, less = chance(u - v * j), chance(v - u * j)
    likely = greater[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(np.clip(1 - more - less, 1e-12, 1))
    return j[np.arange(len(j)), likely.argmax(axis=1)]


@lean
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, a key of the whole set, and a key of each band."""
    for batch in batches:
        n, keys, bands = np.zeros(batch.num_rows, np.int64), [], np.zeros((batch.num_rows, REGISTERS // BAND), np.int64)
        salt = np.arange(REGISTERS // BAND, dtype=U64) * U64(0x9E3779B97F4A7C15)
        for chunk in text_chunks(batch.column("text")):
            for row, own in zip(chunk.rows.tolist(), shingle_sets(chunk), strict=True):
                n[row] = len(own)
                keys.append(np.array([own.sum(), mix(own).sum()], U64).tobytes() + len(own).to_bytes(4, "little"))
                if len(own):
                    bands[row] = mix(registers(own).view(U64) + salt).view(np.int64)
        column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(keys, pa.binary()), column], names=["doc_id", "n_shingles", "key", "bands"])


@lean
def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            sets = [own.tobytes() for own in shingle_sets(chunk)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(chunk.rows)), pa.array(sets, pa.binary())], names=["id", "elements"])


@lean
def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, x, y with full sets x and y) that are linked: a, b.

    Pairs whose sizes differ too much are out; of the others a batch's similarities are estimated at once, and those that may reach
    the threshold are compared.
    """
    sketches: dict[bytes, np.ndarray] = {}

    def sketch(raw: bytes) -> np.ndarray:
        if len(sketches) > 1024:  # pairs of one centre follow each other
            sketches.clear()
        if raw not in sketches:
            sketches[raw] = registers(np.frombuffer(raw, U64))
        return sketches[raw]

    for batch in batches:
        n_x, n_y = (pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for c in ("x", "y"))
        near = np.flatnonzero(100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y))
        good = np.zeros(batch.num_rows, dtype=bool)
        if len(near):
            x, y = batch.column("x"), batch.column("y")
            own, other = (np.stack([sketch(c[i].as_py()) for i in near.tolist()]) for c in (x, y))
            likely = estimate(own, other, n_x[near], n_y[near]) >= percent / 100 - MARGIN
            for i in near[likely].tolist():
                same = len(np.intersect1d(np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64), assume_unique=True))
                good[i] = 100 * same >= percent * (n_x[i] + n_y[i] - same)
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


@lean
def elements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(element, id, component, n): a row for each element of each set."""
    for batch in batches:
        sets = [np.frombuffer(own.as_buffer(), np.int64) for own in batch.column("elements")]
        n = np.array([len(own) for own in sets], np.int64)
        owner = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets])), batch.column("id").take(owner), batch.column("component").take(owner), pa.array(np.repeat(n, n))], names=["element", "id", "component", "n"])


def remaining_pairs(spark: SparkSession, left: DataFrame, percent: int, size: int = 0) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, of all rows of left (id, component, elements); none is missed.

    Elements are put in one order for all sets, rare ones first; those of one set alone come before all others and needn't be
    looked at. A linked pair's first common element lies so early in both that enough can follow.
    """
    rows = cut(spark, left.mapInArrow(elements_of, "element long, id long, component long, n long"), size)
    shared = rows.groupBy("element").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("p"), F.max("component").alias("q")).where("df > 1")
    met = rows.join(shared.select("element", "df", (F.col("p") < F.col("q")).alias("apart")), "element")
    order = Window.partitionBy("id").orderBy("df", "element")
    met = met.withColumn("place", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id")) + F.row_number().over(order) - 1)
    # a linked set has percent/100 * n of the elements, so one of the first that are more than the others is common
    rare = cut(spark, met.where(F.col("apart") & (100 * (F.col("n") - F.col("place")) >= percent * F.col("n"))).select("element", "id", "component", "n", "place"), size)
    release(spark)
    other = rare.select("element", *[F.col(c).alias(f"{c}2") for c in ("id", "component", "n", "place")])
    enough = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= percent * (F.col("n") + F.col("n2"))
    fits = (F.col("id") < F.col("id2")) & (F.col("component") != F.col("component2")) & enough
    return rare.alias("l").join(other.alias("r"), (F.col("l.element") == F.col("r.element")) & fits).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame, labels: DataFrame, size: int = 0) -> DataFrame:
    """(id, component): the least id that edges (a, b) reach from the components of labels (id, component), which may be empty.

    Components are nodes that the edges join; each round every node takes the least label around it, then its label's label.
    """
    def label(side: str) -> DataFrame:
        return labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))

    links = edges.join(label("a"), "a", "left").join(label("b"), "b", "left")
    links = links.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")).where("u <> v").distinct()
    both = cut(spark, links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), size)
    state = cut(spark, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), size)
    while True:
        around = both.join(state.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        near = state.join(around, "u").select("u", F.least("c", "m").alias("n"), F.col("c"))
        jumped = near.join(state.select(F.col("u").alias("n"), F.col("c").alias("j")), "n", "left")
        after = cut(spark, jumped.select("u", F.least("n", F.coalesce("j", "n")).alias("c"), (F.least("n", F.coalesce("j", "n")) < F.col("c")).alias("moved")), size)
        state = after.select("u", "c")
        if not after.where("moved").take(1):
            break
    roots = state.select(F.col("u").alias("component"), "c")
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    known = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    return cut(spark, known.join(roots, "component", "left").select("id", F.coalesce("c", "component").alias("component")), size)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document whose text is null, empty or without words has no shingles and is linked with nothing. A row with a null doc_id
    is linked with nothing, has a null component_id and is kept. Rows that repeat a doc_id are one node, linked with whatever
    one of them is linked with. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source_bytes(docs)
    signed = cut(spark, docs.mapInArrow(sign, "doc_id long, n_shingles long, key binary, bands array<long>"), size)
    ranked = F.min(F.struct("doc_id", "n_shingles", "bands"))
    classes = cut(spark, signed.where("doc_id is not null and n_shingles > 0").groupBy("key").agg(ranked.alias("r")).select("key", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")), size)
    banded = classes.select("id", "n", F.posexplode("bands").alias("band", "bucket")).select("bucket", "id", "n")
    shared = banded.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most").select("bucket", "size")
    members = cut(spark, banded.join(shared, "bucket"), size)  # of buckets with several documents
    fame = members.groupBy("id").agg(F.sum("size").alias("fame"))
    members = cut(spark, members.join(fame, "id").select("bucket", "id", "n", "fame"), size)
    release(spark)
    sets = docs.withColumnRenamed("doc_id", "id").join(members.select("id").distinct(), "id", "left_semi").mapInArrow(full_sets, "id long, elements binary")
    sets = cut(spark, sets, size)
    release(spark)
    labels = spark.createDataFrame([], "id long, component long")
    tried = spark.createDataFrame([], "a long, b long")
    for step in range(ROUNDS + 1):
        here = members.join(labels, "id", "left").select("bucket", "id", "n", "fame", F.coalesce("component", "id").alias("component"))
        best = F.max_by(F.struct("id", "n", "component"), F.struct(F.xxhash64("id") if step else F.col("fame"), -F.col("id")))
        several = here.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), best.alias("centre")).where("p < q")
        if step < ROUNDS:
            pairs = here.join(several.select("bucket", "centre"), "bucket")
            fits = (F.col("component") != F.col("centre.component")) & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
            pairs = pairs.where(fits).select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()
        else:
            open_ = here.join(several.select("bucket"), "bucket", "left_semi").select("id", "component").distinct()
            pairs = remaining_pairs(spark, cut(spark, open_.join(sets, "id"), size), percent, size)
        pairs = cut(spark, pairs.join(tried, ["a", "b"], "left_anti"), size)
        if not pairs.take(1):
            continue
        tried = tried.unionByName(pairs)
        texts = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
        edges = cut(spark, texts.select("a", "b", "x", "y").mapInArrow(lambda t: linked(t, percent), "a long, b long"), size)
        release(spark)
        labels = components(spark, edges, labels, size)
    named = classes.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
