"""Nearest neighbours by largest inner product: a vantage-point tree in each shard.

Vectors are dealt to shards by a hash of their ids, so that copies of one vector spread evenly; within a shard, equal vectors
are one point of the tree. An extra coordinate puts all points of a shard on one sphere, where the largest inner product is the
smallest angle to the query, and angles keep the triangle inequality. A node's vantage point is the one, of some, that sees its
points under the most different angles; each part of them has the interval of its angles. A part is left out when the
inequality puts all of it beyond `factor` times the angle of the k-th neighbour found so far; factor 1 makes the search exact,
smaller factors prune more. Where more points than the list holds tie with its end (within rounding), all of them are taken, as
only exact scores and ids tell which come first.

A shard's vectors and all queries meet in one task, vectors first: the tree is built once, and the queries stream through it. Each
query gets k candidates of a shard at most; the k best of them are the result, with scores computed from the original vectors in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import bound_batches, lean, shuffle_partitions

K = 20
FACTOR = 1.0
#: Vectors of a shard: the least, and the most that a task holds.
SHARD_ROWS, MOST_ROWS = 8_192, 65_536
LEAF = 128
#: Points that are tried as a node's vantage point, and points that they are tried on.
TRIED, SEEN = 8, 256
#: Part of a product within which products tie, and of angles that no pruning relies on.
TIE, SLACK = 1e-9, 1e-7


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Tree:
    """A vantage-point tree over unit vectors; `nodes`: (vantage row, [(least angle, largest angle, node), ...]) or a leaf's rows."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) > LEAF:
            tried, seen = rows[:: -(-len(rows) // TRIED)], rows[:: -(-len(rows) // SEEN)]
            vantage = tried[angles(self.points[tried] @ self.points[seen].T).std(axis=1).argmax()]
            angle = angles(self.points[rows] @ self.points[vantage])
            near = angle <= np.median(angle)
            if not near.all():  # else all are as far away: a leaf
                parts = [(angle[part].min(), angle[part].max(), self._build(rows[part])) for part in (near, ~near)]
                self.nodes[at] = (vantage, parts)
        return at


class Search:
    """The best k points for each of a block of queries (unit vectors)."""

    def __init__(self, tree: Tree, queries: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.factor = tree, queries, factor
        self.best = np.full((len(queries), k), -np.inf)  # cosines, in order
        self.rows = np.full((len(queries), k), -1)
        self.lost = np.full(len(queries), -np.inf)  # the best cosine that a list has dropped
        self.visited = 0

    def run(self) -> Search:
        self.visit(self.tree.root, np.arange(len(self.queries)), np.zeros(len(self.queries)))
        return self

    def tied(self, q: int) -> np.ndarray:
        """The rows of a query's list, or all rows that reach its end within rounding where some were dropped."""
        least = self.best[q, -1] - TIE
        if self.lost[q] < least:
            return self.rows[q][self.rows[q] >= 0]
        return np.flatnonzero(self.tree.points @ self.queries[q] >= least)

    def visit(self, at: int, q: np.ndarray, bound: np.ndarray) -> None:
        """A node for some queries, none of whose points is at a smaller angle than the bound."""
        q = q[bound <= self.factor * (angles(np.maximum(self.best[q, -1] - TIE, -1)) + SLACK)]
        if not len(q):
            return
        node = self.tree.nodes[at]
        if len(node) == 1:
            self._leaf(node[0], q)
            return
        vantage, parts = node
        angle = angles(self.queries[q] @ self.tree.points[vantage])
        bounds = [np.maximum(np.maximum(low - angle, angle - high), 0) for low, high, _ in parts]
        first = bounds[0] <= bounds[1]  # each query goes where it may be nearer, then to the other part
        for turn in (0, 1):
            for (_, _, child), bound, mine in zip(parts, bounds, (first, ~first), strict=True):
                mine = mine if turn == 0 else ~mine
                self.visit(child, q[mine], bound[mine])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        self.visited += len(rows) * len(q)
        product = self.queries[q] @ self.tree.points[rows].T
        k = self.best.shape[1]
        most = product.max(axis=1)
        better = most > self.best[q, -1]
        self.lost[q[~better]] = np.maximum(self.lost[q[~better]], most[~better])
        hope = np.flatnonzero(better)
        if len(hope):
            values = np.concatenate([self.best[q[hope]], product[hope]], axis=1)
            names = np.concatenate([self.rows[q[hope]], np.broadcast_to(rows, (len(hope), len(rows)))], axis=1)
            parted = np.argpartition(-values, (k - 1, k), axis=1)
            self.lost[q[hope]] = np.maximum(self.lost[q[hope]], np.take_along_axis(values, parted[:, k : k + 1], 1)[:, 0])
            top = parted[:, :k]
            values, names = np.take_along_axis(values, top, 1), np.take_along_axis(names, top, 1)
            order = np.argsort(-values, axis=1, kind="stable")
            self.best[q[hope]], self.rows[q[hope]] = np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Shard:
    """The vectors of a shard, all of one length, and their tree; of rows that repeat an id the least vector counts."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        fresh = np.append(True, ids[1:] != ids[:-1])
        self.x, self.ids, self.k = x[fresh], ids[fresh], k
        distinct, owner = np.unique(self.x, axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        # the smallest ids of each distinct vector: one more than can be asked for, as a query leaves itself out
        by = np.argsort(owner, kind="stable")
        place = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
        self.by = by[place <= k]
        self.first, self.last = (np.searchsorted(owner[self.by], np.arange(len(distinct)), side=s) for s in ("left", "right"))
        norm2 = (distinct**2).sum(axis=1)
        length2 = float(norm2.max())
        self.tree = Tree(np.column_stack([distinct, np.sqrt(np.maximum(length2 - norm2, 0))]) / np.sqrt(length2))

    def search(self, q_ids: np.ndarray, q: np.ndarray, factor: float) -> list[np.ndarray]:
        """query_id, vec_id and score of the k best vectors for each query."""
        out: tuple[list, list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
        for a in range(0, len(q), 512):
            own, names = q[a : a + 512], q_ids[a : a + 512]
            units = np.column_stack([own / np.sqrt((own**2).sum(axis=1))[:, None], np.zeros(len(own))])
            found = Search(self.tree, units, min(self.k + 1, len(self.tree.points)), factor).run()
            for i in range(len(own)):
                rows = found.tied(i)
                member = np.concatenate([np.empty(0, np.int64), *(self.by[self.first[r] : self.last[r]] for r in rows.tolist())])
                member = member[self.ids[member] != names[i]]
                score = np.zeros(len(member))
                for j in range(q.shape[1]):  # in order of the components, so that the sum is the same everywhere
                    score += self.x[member, j] * own[i, j]
                top = np.lexsort((self.ids[member], -score))[: self.k]
                for column, x in zip(out, (np.full(len(top), names[i]), self.ids[member][top], score[top]), strict=True):
                    column.append(x)
        return [np.concatenate(c) for c in out]


@lean
def search_shards(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Rows (size, shard, query, id, vector) in that order, a shard's vectors before its queries: query_id, vec_id, score."""
    key, held, shard = None, [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("size", "shard", "query")])
        edges = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if key != (now := (names[0, a], names[1, a])):
                key, held, shard = now, [], None
            ids, x = batch.column("id").slice(a, b - a).to_numpy(), matrix(batch.column("vector").slice(a, b - a))
            if not names[2, a]:
                held.append((ids, x))
                continue
            if held:
                shard, held = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k), []
            if shard is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in shard.search(ids, x, factor)], names=["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and all its components are finite numbers."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int | None = None) -> DataFrame:
    """The k vectors of the largest inner product with each query: query_id, rank, vec_id, score.

    queries: query_id, vector; vectors: vec_id, vector. Null ids and vectors that are null, zero or hold a null, NaN or infinite
    component take no part, and a query meets vectors of its own length alone. A query's own id is no candidate of it; ties go to
    the smaller vec_id. Rows that repeat an id count once, with the least of its vectors (of one length). Empty tables give no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    queries = queries.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    n = vectors.count()
    if shard_rows is None:  # a shard for each task while that leaves enough to build a tree on, and no more than a task holds
        shard_rows = min(MOST_ROWS, max(SHARD_ROWS, -(-n // shuffle_partitions(spark))))
    shards = max(1, -(-n // shard_rows))
    left = vectors.select(F.size("vector").alias("size"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("query"), "id", "vector")
    right = queries.select(F.size("vector").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("query"), "id", "vector")
    met = left.unionByName(right).repartition(max(shards, 1), "size", "shard").sortWithinPartitions("size", "shard", "query")
    found = met.mapInArrow(lambda b: search_shards(b, k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
