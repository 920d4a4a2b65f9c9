"""Approximate nearest neighbours by a forest of random-projection trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the
smallest angle. Trees are fitted on a bounded sample (``sample_rows``) and are at most as deep as it can fill: a node
splits at the median of the projection on the difference of two centres of its sample points (two-means from two random
ones). So the broadcast forest is bounded, whatever the table. Every row is put into its leaf of each tree. A query walks
all trees through one priority queue, ordered by the smallest margin on the way, until it has ``leaves`` leaves; the rows
of those leaves are ranked by their exact inner products.

How many leaves is settled by measurement: for a bounded set of queries (``probe_queries``) the true neighbours are found
among all rows, and the least number is taken by which ``target`` of them are reached.

A tree's leaves make ``GROUPS`` runs, whatever the table, so a query goes to at most ``trees * GROUPS`` of them and brings
its ``k`` best back from each: rows moved and made grow with the table, not with its square. Queries of a run are split
into tiles of ``query_rows``, its rows into tiles of ``vector_rows``; a task holds a query tile and streams the rows past
it, leaf by leaf, so that neither a common vector nor a large run fills a task's memory.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those of
another length than the most frequent (the longer, if two are), since no inner product is defined for them; ties go to the
smaller id, by exact scores (of equal vectors a task keeps the ``k + 1`` smallest ids); repeated ids are one row each in
the index and give each neighbour once; no vectors give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, written

GROUPS = 4


class Forest:
    """Heap-ordered perfect trees: node i has children 2i+1 and 2i+2; leaves are numbered 0 .. 2^depth - 1."""

    def __init__(self, sample: np.ndarray, top_norm: float, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.top, self.trees, self.depth, self.inner = top_norm, trees, depth, (1 << depth) - 1
        points = self.lift(sample)
        dim = points.shape[1]
        self.planes = np.zeros((trees, self.inner, dim), dtype=np.float32)
        self.cuts = np.zeros((trees, self.inner), dtype=np.float32)
        for t in range(trees):
            members = {0: np.arange(len(points))}
            for node in range(self.inner):
                own = members.pop(node, np.empty(0, dtype=int))
                plane = self._plane(points[own], rng) if len(own) >= 2 else rng.normal(size=dim)
                plane = plane / np.linalg.norm(plane)
                at = points[own] @ plane
                cut = float(np.median(at)) if len(own) >= 2 else 0.0
                self.planes[t, node], self.cuts[t, node] = plane, cut
                right = at > self.cuts[t, node]
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    @staticmethod
    def _plane(points: np.ndarray, rng) -> np.ndarray:
        """The difference of two centres; a random direction if the points are equal."""
        a, b = points[rng.choice(len(points), 2, replace=False)]
        if not np.any(a != b):
            return rng.normal(size=points.shape[1])
        some = points[rng.choice(len(points), min(len(points), 1024), replace=False)]
        for _ in range(6):
            nearer = some @ (a - b) > 0.5 * (a @ a - b @ b)
            if nearer.all() or not nearer.any():
                break
            c, d = some[nearer].mean(axis=0), some[~nearer].mean(axis=0)
            if not np.any(c != d):
                break
            a, b = c, d
        return a - b

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top**2 - np.einsum("ij,ij->i", x, x)))
        return np.hstack([x, rest[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each row of (lifted) ``x`` its leaf in each tree."""
        out = np.empty((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", x, self.planes[t][node]) - self.cuts[t][node]
                node = 2 * node + 1 + (margin > 0)
            out[:, t] = node - self.inner
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """For each row of (lifted) ``x`` its side of every node, as trees times nodes in one row."""
        return x @ self.planes.reshape(-1, x.shape[1]).T.astype(np.float64) - self.cuts.reshape(-1)

    def walk(self, margins: np.ndarray, count: int) -> list[int]:
        """The first ``count`` leaves, as tree * 2^depth + leaf, of a query with these margins, nearest first."""
        at, inner = margins.tolist(), self.inner
        queue = [(-math.inf, t, 0) for t in range(self.trees)]
        found: list[int] = []
        while queue and len(found) < count:
            priority, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append(t * (inner + 1) + node - inner)
                continue
            margin = at[t * inner + node]
            heapq.heappush(queue, (max(priority, -margin), t, 2 * node + 2))
            heapq.heappush(queue, (max(priority, margin), t, 2 * node + 1))
        return found


class Best:
    """The ``k`` best rows so far of each query of a tile: the largest exact scores, ties to the smaller id, an id once."""

    PAIRS, PART, CHUNK = 400_000, 512, 2048

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, top: float):
        self.ids, self.x, self.k = ids, x, k
        self.slack = 1e-12 * top * np.sqrt(np.einsum("ij,ij->i", x, x))  # what a matrix product may be off
        self.floor = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, own: np.ndarray, v_ids: np.ndarray, vectors: np.ndarray) -> None:
        """Rows that the queries ``own`` (their numbers) are to see."""
        for lo in range(0, len(v_ids), self.CHUNK):
            ids, v = v_ids[lo : lo + self.CHUNK], vectors[lo : lo + self.CHUNK]
            once = len(np.unique(ids)) == len(ids)
            for first in range(0, len(own), self.PART):
                q = own[first : first + self.PART]
                scores = self.x[q] @ v.T
                scores[self.ids[q][:, None] == ids[None, :]] = -np.inf
                least = self.floor[q]
                if once and len(ids) > self.k:
                    least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
                at, row = np.nonzero((scores >= (least - self.slack[q])[:, None]) & (scores > -np.inf))
                exact = (v[row] * self.x[q[at]]).sum(axis=1)  # equal for equal vectors
                self.held.append((q[at], ids[row], exact))
                self.size += len(at)
                if self.size > self.PAIRS + 4 * self.k * len(self.ids):
                    self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        q, v, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-s, v, q))
        q, v, s = q[order], v[order], s[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])))[: len(q)]
        q, v, s = q[new], v[new], s[new]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        starts = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - starts[q]
        last = rank == self.k - 1
        self.floor[q[last]] = s[last]
        kept = rank < self.k
        self.held, self.size = [(q[kept], v[kept], s[kept])], int(kept.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, row ids, scores)."""
        self.settle()
        if not self.held:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        q, v, s = self.held[0]
        return self.ids[q], v, s


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


_OUT = "query_id long, vec_id long, score double"


def _batch(best: Best):
    import pyarrow as pa

    q, v, s = best.rows()
    return pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) with the vectors that take part, as doubles."""
    x = col(vector_col).cast("array<double>")
    rows = df.select(col(id_col).cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND size(x) > 0 AND NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity')) AND exists(x, c -> c <> 0)")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _top(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all tasks: one shuffle, by the query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = df.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Tile:
    """One task's share: a query tile, then the rows of its run, sorted by leaf, hash of the vector and id."""

    def __init__(self, k: int, top: float):
        self.k, self.top, self.queries, self.best = k, top, [], None
        self.seen = (None, None, None, 0)  # leaf, hash and id of the last row, and how many ids its vector has shown

    def take_queries(self, batch) -> None:
        self.queries.append(batch)

    def _start(self) -> None:
        import pyarrow as pa

        table = pa.Table.from_batches(self.queries)
        one = lambda name: table.column(name).combine_chunks()
        self.best = Best(one("id").to_numpy(), _matrix(one("x")), self.k, self.top)
        walked = one("leaves")
        flat, many = walked.flatten().to_numpy(), np.diff(walked.offsets.to_numpy())
        query = np.repeat(np.arange(len(many)), many)
        order = np.argsort(flat, kind="stable")
        leaves, starts = np.unique(flat[order], return_index=True)
        self.by_leaf = dict(zip(leaves.tolist(), np.split(query[order], starts[1:]), strict=True))
        self.queries = []

    def _kept(self, leaf: int, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The rows that can be among a query's best: of equal vectors the ``k + 1`` smallest ids, each once."""
        last_leaf, last_h, last_id, shown = self.seen
        goes_on = last_leaf == leaf and last_h == h[0]
        vector = np.concatenate(([not goes_on], h[1:] != h[:-1]))
        fresh = vector | np.concatenate(([not goes_on or ids[0] != last_id], ids[1:] != ids[:-1]))
        count = np.cumsum(fresh) + (shown if goes_on else 0)
        starts = np.flatnonzero(vector)
        before = np.zeros(len(h), dtype=np.int64)
        if len(starts):
            base = count[starts] - 1
            before[starts[0] :] = np.repeat(base, np.diff(np.append(starts, len(h))))
        number = count - before
        self.seen = (leaf, h[-1], ids[-1], int(number[-1]))
        return fresh & (number <= self.k + 1)

    def take_rows(self, leaf: int, batch) -> None:
        if self.best is None:
            if not self.queries:
                return
            self._start()
        own = self.by_leaf.get(leaf)
        if own is None:
            return
        ids = batch.column("id").to_numpy()
        kept = self._kept(leaf, batch.column("h").to_numpy(), ids)
        self.best.add(own, ids[kept], _matrix(batch.column("x"))[kept])


def _ranked(batches, k: int, top: float):
    """Of each part (column ``part``) the best rows of its queries; rows with leaf -1 are the queries and come first."""
    part, tile = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, leaves = batch.column("part").to_numpy(), batch.column("leaf").to_numpy()
        cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (leaves[1:] != leaves[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
            if parts[lo] != part:
                if tile and tile.best:
                    yield _batch(tile.best)
                part, tile = parts[lo], _Tile(k, top)
            run = batch.slice(lo, hi - lo)
            if leaves[lo] < 0:
                tile.take_queries(run)
            else:
                tile.take_rows(int(leaves[lo]), run)
    if tile and tile.best:
        yield _batch(tile.best)


def nearest_neighbors(df: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", query: str = "id % 20 = 0", trees: int = 4, leaf_rows: int = 128, sample_rows: int = 16384, probe_queries: int = 96, target: float = 0.95, query_rows: int = 16384, vector_rows: int = 1 << 20, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row that satisfies ``query``, itself excluded."""
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vector_col)
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)
    n, top2, n_queries = rows.agg(F.count(F.lit(1)), F.max(norm2), F.count(F.when(F.expr(query), 1))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = math.sqrt(top2)
    pick = lambda frame, share: frame.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = pick(rows, min(1.0, sample_rows / n)).limit(2 * sample_rows).toArrow()
    points = _matrix(sample.column("x").combine_chunks()) if sample.num_rows else np.ones((1, len(rows.select("x").first()["x"])))
    deepest = max(0, int(math.log2(max(1, len(points) / 8))))  # a leaf has eight points of the sample
    depth = min(deepest, max(0, math.ceil(math.log2(max(1, n / leaf_rows)))))
    shape = spark.sparkContext.broadcast(Forest(points, top, trees, depth, seed))

    # The probe: true neighbours of a bounded number of queries among all rows, then how far each walk has to go.
    probes = pick(rows.where(query), min(1.0, probe_queries / n_queries)).limit(2 * probe_queries).toArrow()
    p_ids, p_x = probes.column("id").combine_chunks().to_numpy(), _matrix(probes.column("x").combine_chunks())
    shared = spark.sparkContext.broadcast((p_ids, p_x))

    def truth(batches):
        import pyarrow as pa

        ids, x = shared.value
        best, every, forest, where = Best(ids, x, k, top), np.arange(len(ids)), shape.value, {}
        for b in batches:
            if b.num_rows:
                v, m = b.column(0).to_numpy(), _matrix(b.column(1))
                best.add(every, v, m)
                best.settle()
                near = {int(i) for i in best.held[0][1]}
                own = np.flatnonzero(np.isin(v, list(near)))
                leaves = forest.leaves(forest.lift(m[own]))
                for i, leaf in zip(v[own].tolist(), leaves.tolist(), strict=True):
                    where.setdefault(i, leaf)
                where = {i: leaf for i, leaf in where.items() if i in near}
        q, v, s = best.rows()
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64()), "leaves": pa.array([where[i] for i in v.tolist()], pa.list_(pa.int64()))})

    leaves = every = trees << depth
    if len(p_ids):
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        true = rows.select("id", "x").mapInArrow(truth, _OUT + ", leaves array<long>").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "leaves").collect()  # probe_queries * k rows
        forest, walks, steps = shape.value, {}, []
        margins = dict(zip(p_ids.tolist(), forest.margins(forest.lift(p_x)), strict=True))
        for row in true:
            if row["query_id"] not in walks:
                walks[row["query_id"]] = {leaf: i for i, leaf in enumerate(forest.walk(margins[row["query_id"]], every))}
            steps.append(1 + min(walks[row["query_id"]][(t << depth) + leaf] for t, leaf in enumerate(row["leaves"])))
        leaves = sorted(steps)[min(len(steps) - 1, math.ceil(target * len(steps)))] if steps else every

    span = max(1, (1 << depth) // GROUPS)  # leaves next to one another make a run

    def place(batches):
        import pyarrow as pa

        forest = shape.value
        for b in batches:
            if b.num_rows:
                at = forest.leaves(forest.lift(_matrix(b.column(1)))) + (np.arange(trees) << depth)
                take = pa.array(np.repeat(np.arange(b.num_rows), trees))
                at = at.reshape(-1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(at // span), pa.array(at)], names=["id", "x", "h", "grp", "leaf"])

    def route(batches):
        import pyarrow as pa

        forest = shape.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                take, grp, sets = [], [], []
                for i, margins in enumerate(forest.margins(forest.lift(_matrix(part.column(1))))):
                    by: dict[int, list[int]] = {}
                    for leaf in forest.walk(margins, leaves):
                        by.setdefault(leaf // span, []).append(leaf)
                    take += [i] * len(by)
                    grp += by.keys()
                    sets += by.values()
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(grp, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "x", "grp", "leaves"])

    index = written(rows.select("id", "x", F.xxhash64("x").alias("h")).mapInArrow(place, "id long, x array<double>, h long, grp long, leaf long"), "ann-index")
    walks = written(rows.where(query).mapInArrow(route, "id long, x array<double>, grp long, leaves array<long>"), "ann-walks")
    tiles = lambda frame, size, name: frame.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = tiles(index, vector_rows, "vb").join(tiles(walks, query_rows, "qb"), "grp")  # a row a run: trees * GROUPS at most
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.withColumn("first", F.coalesce(F.sum(F.col("qb") * F.col("vb")).over(before), F.lit(0)).cast("int")), "ann-tiles")
    parts = sizes.agg(F.sum(F.col("qb") * F.col("vb"))).first()[0] or 1
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    others = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    part = (F.col("first") + F.col("q") * F.col("vb") + F.col("v")).cast("int").alias("part")
    none = F.lit(None).cast("array<long>").alias("leaves")
    left = walks.join(F.broadcast(sizes), "grp").withColumn("q", own("qb")).withColumn("v", others("vb")).select(part, F.lit(-1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("h"), "id", "x", "leaves")
    right = index.join(F.broadcast(sizes), "grp").withColumn("v", own("vb")).withColumn("q", others("qb")).select(part, "leaf", "h", "id", "x", none)
    dealt = left.unionAll(right).repartitionById(int(parts), F.col("part")).sortWithinPartitions("part", "leaf", "h", "id")
    found = dealt.mapInArrow(lambda batches: _ranked(batches, k, top), _OUT)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all vectors."""
    return nearest_neighbors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 20)
