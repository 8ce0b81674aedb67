"""Exact top-k inner products by best-first search of an M-tree.

Vectors become integers, floor(256 x) by component.  Adding a component that
brings every vector to the largest norm among the candidates, zero for queries,
turns the largest inner product into the smallest Euclidean distance, a metric.

The tree has routing objects, vectors drawn by hash of their id, and pages of up
to ``PAGE_ROWS`` entries.  Every vector hangs under its nearest routing object
and keeps its distance to it; a page holds entries of one routing object with
neighbouring parent distances, so it is a ring with an inner and an outer
covering radius.  With the distance from the query to the routing object, the
triangle inequality bounds the distance to every entry of the ring from below
without computing any.

Pages are spread over the cluster.  Each task searches its pages for a block of
queries at once, nearest bound first, and gives up a page for a query once its
bound cannot reach the query's k-th best.  Queries travel in blocks of
``QUERY_ROWS``; each block is a job over all pages.  A first job searches a
sample of the pages to start all tasks with a good k-th best.

Vectors that are null, or hold null or non-finite components, take no part.
Vectors of another length than the query's have no score with it.  Rows with the
query's id are its own, so repeated ids never meet; queries with the same id and
vector are one.  Ties go to the smaller id; fewer candidates than ``k`` give as
many rows as there are.  A null id takes no part.
Vectors whose squares add up to 2^52 or more have no exact score in double precision.
They are no part of the tree: pairs with one of them are bounded in doubles, and those
that can be among the best ``k`` of their task are scored in whole numbers of any size.
A score beyond a long is shown as the nearest long; ranks go by the true one.
An empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import heapq
import math
import operator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import forget, parts, stored

SCALE = 256
PAGE_ROWS = 256
QUERY_ROWS = 4096
#: Entries per routing object, and routing objects at most.
ROUTED_ROWS, MOST_ROUTING = 2048, 1024
#: One entry in so many is searched first.
SAMPLE = 32

_EXACT = float(1 << 52)
_ENTRY = "vec_id bigint, dims int, norm2 double, vec binary, wide boolean"
_FOUND = "query_id bigint, vec_id bigint, score bigint, place binary"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``dims``, squared norm and little-endian int64 components.

    Where these are no exact doubles the vector is ``wide`` and keeps its own components.
    """

    def run(batches):
        for batch in batches:
            ids, dims, norms, vecs, wide = [], [], [], [], []
            column = batch.column(1)
            for number, values in zip(batch.column(0).to_pylist(), column):
                if number is None or not values.is_valid or values.values.null_count:
                    continue
                own = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(own).all():
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * own)
                    norm = float(scaled @ scaled)
                wide.append(not norm < _EXACT)
                ids.append(number)
                dims.append(len(scaled))
                norms.append(norm)
                vecs.append((own if wide[-1] else scaled.astype("<i8")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(dims, pa.int32()),
                    pa.array(norms, pa.float64()),
                    pa.array(vecs, pa.binary()),
                    pa.array(wide, pa.bool_()),
                ],
                names=["vec_id", "dims", "norm2", "vec", "wide"],
            )

    return vectors.mapInArrow(run, _ENTRY)


def _matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(blobs), "<i8").astype(np.float64)
    return flat.reshape(len(blobs), dims)


class Routing:
    """Routing objects of one vector length, in the space with the added component."""

    def __init__(self, vectors: np.ndarray, most: float):
        self.vectors, self.most = vectors, most
        self.added = np.sqrt(np.maximum(most - (vectors**2).sum(axis=1), 0))

    def distances(self, rows: np.ndarray, added: np.ndarray) -> np.ndarray:
        square = (rows**2).sum(axis=1)[:, None] + (added**2)[:, None] + self.most
        square = square - 2 * (rows @ self.vectors.T + added[:, None] * self.added)
        return np.sqrt(np.maximum(square, 0))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        added = np.sqrt(np.maximum(self.most - (rows**2).sum(axis=1), 0))
        far = self.distances(rows, added)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(rows)), best]


def tree_entries(vectors: DataFrame, routing: dict[int, Routing]) -> DataFrame:
    """Entries with their routing object and parent distance, in order of both."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast({n: (r.vectors, r.most) for n, r in routing.items()})

    def run(batches):
        nodes = {size: Routing(*plain) for size, plain in shared.value.items()}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            node = np.zeros(len(dims), np.int32)
            parent = np.zeros(len(dims))
            for size in np.unique(dims):
                at = np.flatnonzero(dims == size)
                rows = _matrix(batch.column("vec").take(pa.array(at)).to_pylist(), size)
                node[at], parent[at] = nodes[size].nearest(rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(node), pa.array(parent)],
                names=[*batch.schema.names, "node", "parent"],
            )

    placed = vectors.mapInArrow(run, _ENTRY + ", node int, parent double").drop("wide")
    tasks = parts(spark)
    # entries of a crowded routing object are dealt to several partitions: rings
    # are formed from what a partition has, so any cut will do
    dealt = placed.withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.lit(tasks)))
    dealt = dealt.repartition(tasks, "cut")
    return dealt.sortWithinPartitions("dims", "node", "parent").drop("cut")


class Search:
    """The best of a block of queries so far, over whatever pages are shown."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, routing: Routing, k: int, least: np.ndarray):
        self.ids, self.vectors, self.routing, self.k = ids, vectors, routing, k
        self.norm2 = (vectors**2).sum(axis=1)
        self.far = routing.distances(vectors, np.zeros(len(vectors)))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = least
        self.computed = 0

    def bound(self, node: int, inner: float, outer: float) -> np.ndarray:
        """The largest inner product each query can have in a ring, and a little more."""
        near = np.maximum(np.maximum(self.far[:, node] - outer, inner - self.far[:, node]), 0)
        most = (self.norm2 + self.routing.most - near**2) / 2
        return most + 1e-7 * (self.norm2 + self.routing.most) + 1e-6

    def pages(self, pages: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Show pages: routing object, parent distances, ids, vectors."""
        queue = []
        for number, (node, parent, _, _) in enumerate(pages):
            bound = self.bound(node, parent[0], parent[-1])
            heapq.heappush(queue, (-(bound - self.norm2).max(), number, bound))
        while queue:
            _, number, bound = heapq.heappop(queue)
            open_ = np.flatnonzero(bound >= np.maximum(self.least, self.scores[:, -1]))
            if len(open_):
                self._compare(open_, *pages[number][2:])

    def _compare(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.computed += len(queries) * len(ids)
        mine = self.vectors[queries]
        score = mine @ vectors.T
        score[self.ids[queries][:, None] == ids[None, :]] = -np.inf
        # only those that reach the k-th best so far need a place
        worst = np.maximum(self.scores[queries, -1], self.least[queries])
        hit = (score >= worst[:, None]).any(axis=1)
        for at in np.flatnonzero(hit & (score.max(axis=1) > -np.inf)):
            query = queries[at]
            some = np.flatnonzero(score[at] >= max(worst[at], np.finfo(np.float64).min))
            scores = np.concatenate([self.scores[query], score[at, some]])
            found = np.concatenate([self.found[query], ids[some]])
            order = np.lexsort((found, -scores))[: self.k]
            self.scores[query], self.found[query] = scores[order], found[order]


def _rings(batch: pa.RecordBatch, dims: int):
    sizes = batch.column("dims").to_numpy()
    at = np.flatnonzero(sizes == dims)
    if not len(at):
        return []
    part = batch.take(pa.array(at))
    node, parent = part.column("node").to_numpy(), part.column("parent").to_numpy()
    ids = part.column("vec_id").to_numpy()
    vectors = _matrix(part.column("vec").to_pylist(), dims)
    order = np.lexsort((parent, node))
    edges = np.flatnonzero(np.diff(node[order])) + 1
    out = []
    for run in np.split(order, edges):
        for start in range(0, len(run), PAGE_ROWS):
            page = run[start : start + PAGE_ROWS]
            out.append((int(node[page[0]]), parent[page], ids[page], vectors[page]))
    return out


def _candidates(entries: DataFrame, block, k: int) -> DataFrame:
    """The best ``k`` of every task for each query of a broadcast block."""

    def run(batches):
        ids, vectors, plain, least, dims = block.value
        search = Search(ids, vectors, Routing(*plain), k, least)
        for batch in batches:
            search.pages(_rings(batch, dims))
        query, place = np.nonzero(search.found != np.iinfo(np.int64).max)
        scores = np.rint(search.scores[query, place]).astype(np.int64)
        yield _found_batch(search.ids[query].tolist(), search.found[query, place].tolist(), scores.tolist())

    return entries.mapInArrow(run, _FOUND)


# --- vectors beyond exact doubles ---------------------------------------------------


def _place(score: int) -> bytes:
    """Bytes that sort as scores do: length and digits, both turned round below zero."""
    size = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(size, "big")
    if score >= 0:
        return (32_768 + size).to_bytes(2, "big") + digits
    return (32_768 - size).to_bytes(2, "big") + bytes(255 - d for d in digits)


def _found_batch(queries: list[int], ids: list[int], scores: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(queries, pa.int64()),
            pa.array(ids, pa.int64()),
            pa.array([min(max(score, _LEAST), _MOST) for score in scores], pa.int64()),
            pa.array([_place(score) for score in scores], pa.binary()),
        ],
        names=["query_id", "vec_id", "score", "place"],
    )


def _whole(blob: bytes, wide: bool, scale: int = SCALE) -> list[int]:
    """Components as whole numbers."""
    if not wide:
        return np.frombuffer(blob, "<i8").tolist()
    # from 2^44 on a double is whole, and so is its multiple
    return [math.floor(scale * x) if abs(x) < 2**44 else int(x) * scale for x in np.frombuffer(blob, "<f8").tolist()]


def _unit(rows: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Vectors over their largest component, as doubles, and that component."""
    most = [max(map(abs, row), default=0) or 1 for row in rows]
    return np.array([[x / m for x in row] for row, m in zip(rows, most)]).reshape(len(rows), -1), most


def _exact_candidates(entries: DataFrame, block, k: int) -> DataFrame:
    """The best ``k`` of every task for each query of a broadcast block, in whole numbers."""

    def run(batches):
        ids, asked = block.value
        unit, _ = _unit(asked)
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            rows = [_whole(v, w) for v, w in zip(batch.column("vec").to_pylist(), batch.column("wide").to_pylist())]
            if not rows:
                continue
            numbers = batch.column("vec_id").to_pylist()
            other, most = _unit(rows)
            # scores over the query's largest component, as shares of the largest of the batch
            share = np.array([m / max(most) for m in most])
            near = (unit @ other.T) * share
            # each product is off by a few units in the last place of one at most
            off = share * (unit.shape[1] + 4) * 2.0**-49 + 1e-300
            for at, query in enumerate(ids):
                mine = np.array([number != query for number in numbers])
                low = np.where(mine, near[at] - off, -np.inf)
                least = np.sort(low)[-k] if len(low) >= k else -np.inf
                for n in np.flatnonzero(mine & (near[at] + off >= least)):
                    best[at].append((-sum(map(operator.mul, asked[at], rows[n])), numbers[n]))
                best[at] = sorted(best[at])[:k]
        made = [(query, vec, -score) for query, found in zip(ids, best) for score, vec in found]
        yield _found_batch(*(map(list, zip(*made)) if made else ([], [], [])))

    return entries.select("vec_id", "vec", "wide").mapInArrow(run, _FOUND)


def _of_wide(known: DataFrame, asked: DataFrame, k: int, query_rows: int) -> DataFrame | None:
    """What pairs with a wide vector give: wide queries with all, others with wide candidates."""
    results = None
    for row in known.where("wide").select("dims").distinct().collect():
        rows, queries = (df.where(F.col("dims") == row["dims"]) for df in (known, asked))
        for some, candidates in ((queries.where("wide"), rows), (queries.where("NOT wide"), rows.where("wide"))):
            for ids, vectors in _blocks(some, query_rows, lambda held: [_whole(bytes(r.vec), r.wide) for r in held]):
                shared = known.sparkSession.sparkContext.broadcast((ids.tolist(), vectors))
                found = stored(_exact_candidates(candidates, shared, k), "found")
                shared.unpersist()
                results = found if results is None else results.union(found)
    return results


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec: str = "vec_id",
    embedding: str = "embedding",
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best per query.

    ``is_query`` chooses the queries among ``vectors``; all rows are candidates.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    chosen = vectors.withColumn("__llm_query", F.coalesce(is_query, F.lit(False)))
    known = stored(
        quantised(chosen.select(F.col(vec).cast("bigint"), embedding)), "vectors"
    )
    asked = quantised(chosen.where("__llm_query").select(F.col(vec).cast("bigint"), embedding))
    asked = stored(asked.distinct().orderBy("dims", "vec_id"), "queries")
    results = _of_wide(known, asked, k, query_rows)
    known, asked = known.where("NOT wide"), asked.where("NOT wide")
    lengths = known.groupBy("dims").agg(F.max("norm2").alias("most"), F.count("*").alias("n")).collect()
    routing = {}
    for row in lengths:
        count = min(MOST_ROUTING, 1 + row["n"] // ROUTED_ROWS)
        drawn = known.where(F.col("dims") == row["dims"]).orderBy(F.xxhash64("vec_id"), "vec").limit(count)
        picked = _matrix([bytes(r.vec) for r in drawn.select("vec").collect()], row["dims"])
        routing[row["dims"]] = Routing(picked, row["most"])
    entries = stored(tree_entries(known, routing), "pages")
    forget(known)
    sample = F.pmod(F.xxhash64("vec_id", F.lit("first")), F.lit(SAMPLE)) == 0
    for dims in sorted(routing):
        plain_rows = lambda held, size=dims: _matrix([bytes(r.vec) for r in held], size)
        for ids, rows in _blocks(asked.where(F.col("dims") == dims), query_rows, plain_rows):
            mine = entries.where(F.col("dims") == dims)
            plain = (routing[dims].vectors, routing[dims].most)
            block = (ids, rows, plain, np.full(len(ids), -np.inf), dims)
            first = sc.broadcast(block)
            least = _least(_candidates(mine.where(sample), first, k), ids, k)
            first.unpersist()
            shared = sc.broadcast((*block[:3], least, dims))
            found = stored(_candidates(mine, shared, k), "found")
            shared.unpersist()
            results = found if results is None else results.union(found)
    if results is None:
        results = spark.range(0).selectExpr("id AS query_id", "id AS vec_id", "id AS score", "X'' AS place")
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return (
        results.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _least(found: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each query among some candidates: its k-th best is no worse."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    rows = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).collect()
    known = {row.query_id: row.score for row in rows}
    return np.array([known.get(int(number), -np.inf) for number in ids], np.float64)


def _blocks(queries: DataFrame, size: int, read):
    """Query ids and what ``read`` makes of their rows, at most ``size`` on the driver at a time."""
    rows = queries.toLocalIterator()
    while held := list(islice(rows, size)):
        yield np.array([row.vec_id for row in held], np.int64), read(held)
