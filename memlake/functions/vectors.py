"""Vectors as array columns: length, cosine, blending with lexical scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and rows of a tile, on average.
QUERY_ROWS, HELD_ROWS = 1_024, 16_384


def clamp01(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def finite(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; zeros if a component is not finite or all are zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(finite(v) & (norm > 0), F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Null where the vectors differ in length, have components that are not finite or are zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.least(F.greatest(dot(a, b) / norms, F.lit(-1.0)), F.lit(1.0))
    return F.when((F.size(a) == F.size(b)) & finite(a) & finite(b) & (norms > 0), value)


def blend(lexical: Column, semantic: Column, weight: float) -> Column:
    both = clamp01((1 - weight) * clamp01(lexical) + weight * clamp01(semantic))
    return F.when(semantic.isNull(), clamp01(lexical)).otherwise(both)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length with unit length; a zero vector has no direction, so all its components are NaN."""
    x = pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _tile(asked: pa.Table, held: pa.Table, k: int | None, order: list[tuple[str, str]], floor: float | None, digits: int) -> pa.Table:
    names = ["query_id", "id", "cosine"]
    if not asked.num_rows or not held.num_rows:
        return pa.Table.from_arrays([asked["query_id"].slice(0, 0), held["id"].slice(0, 0), pa.array([], pa.float64())], names=names)
    if k is not None:
        held = held.take(pc.sort_indices(held, sort_keys=order))
    cosines = np.clip(_unit(asked["vector"]) @ _unit(held["vector"]).T, -1, 1).round(digits)
    if k is None:
        q, r = np.divmod(np.arange(cosines.size), held.num_rows)
    else:
        value = np.nan_to_num(cosines, nan=0.0 if floor is None else floor)
        value = value if floor is None else np.maximum(value, floor)
        r = np.argsort(-value, axis=1, kind="stable")[:, :k]  # ties stay in order
        q, r = np.repeat(np.arange(len(r)), r.shape[1]), r.reshape(-1)
    found = cosines[q, r]
    return pa.Table.from_arrays([asked["query_id"].take(pa.array(q)).combine_chunks(), held["id"].take(pa.array(r)).combine_chunks(), pa.array(found, pa.float64(), mask=np.isnan(found))], names=names)


def tiles(queries: DataFrame, rows: DataFrame, k: int | None = None, order: list[tuple[str, bool]] | None = None, floor: float | None = 0.0, digits: int = 12) -> DataFrame:
    """query_id, id, cosine of queries (query_id, vector) and rows (id, vector), all finite and of one length; null for zero vectors.

    Blocks of queries meet blocks of rows, each pair of blocks in one task as a product of matrices. k: keep so many rows of a block
    for each query, which the k best of all are among; equal ones (those not above the floor too) in order of some columns, given as
    (name, descending).
    """
    order = order or [("pinned", True), ("importance", True), ("confidence", True), ("id", False)]
    # aliases tell the sides apart where both come from one table
    keys = [(name, "descending" if down else "ascending") for name, down in order]
    a, b = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERY_ROWS), (rows, HELD_ROWS)))
    ranks = sorted({name for name, _ in order} - {"id"}) if k is not None else []
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(a)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("shard"), F.col("query_id").alias("query_id"), F.col("vector").alias("vector"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("shard"), F.col("id").alias("id"), F.col("vector").alias("vector"), *ranks)
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(lambda x, y: _tile(x, y, k, keys, floor, digits), f"query_id {kinds[0]}, id {kinds[1]}, cosine double")
