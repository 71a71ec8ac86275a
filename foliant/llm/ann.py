"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ranges

TREES = 8
#: Vectors that the trees are grown on, at most; all vectors are put into their leaves.
SAMPLE_ROWS = 65_536
#: Vectors of the sample in a leaf, about.
LEAF_ROWS = 64
#: Rows of a leaf that one task scores at once; larger leaves are dealt out in as many blocks.
BLOCK_ROWS = 20_000
#: Candidates of each query that are reranked exactly, as a multiple of k: leaves hold vectors in 16 bits a component.
RERANK = 2
#: Queries whose exact answer says how many leaves a search must open, and the share of their
#: neighbours that must be found.
CALIBRATION_QUERIES, CALIBRATION_RECALL = 64, 0.96
#: Groups that the leaves of a tree are dealt to: so many at least, and more where a group would hold more rows.
GROUPS, GROUP_ROWS = 4, 200_000


@dataclass
class Tree:
    """Inner nodes in arrays; a child below zero is the leaf ~child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]).astype(np.int64)
            at[inner] = self.children[node, side]
        return ~at


@dataclass
class Forest:
    trees: list[Tree]
    #: Bound of the squared norms: a further coordinate makes all vectors as long, so that the largest
    #: inner product is the nearest.
    bound: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0, self.bound - (x * x).sum(axis=1)))
        return np.column_stack([x, more]).astype(np.float32)

    def search(self, q: np.ndarray, most: int, sizes: list[np.ndarray] | None = None, rows: int = 0) -> list[tuple[int, int]]:
        """The first (tree, leaf) that one queue over all trees opens: most of them, and until they hold rows rows.

        A leaf's place in the queue is the sum of the squared distances to the splits on whose other side it lies.
        """
        heap, found, held = [], [], 0
        margins = [tree.normals @ q - tree.offsets for tree in self.trees]
        for t, tree in enumerate(self.trees):
            heapq.heappush(heap, (0.0, t, 0 if len(tree.normals) else -1))
        while heap and (len(found) < most or held < rows):
            far, t, node = heapq.heappop(heap)
            while node >= 0:
                margin = float(margins[t][node])
                side = int(margin > 0)
                near, other = self.trees[t].children[node, side], self.trees[t].children[node, 1 - side]
                heapq.heappush(heap, (far + margin * margin, t, int(other)))
                node = int(near)
            found.append((t, ~node))
            held += int(sizes[t][~node]) if sizes else 0
        return found


def grow(x: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    """Split at the median along the line between two distant points of each node; equal points share a leaf."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        name = None
        if len(rows) > leaf_rows:
            for _ in range(3):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
                if (length := np.linalg.norm(normal)) > 0:
                    normal = normal / length
                    along = x[rows] @ normal
                    cut = float(np.median(along))
                    right = along > cut
                    if 0 < right.sum() < len(rows):
                        name = len(normals)
                        normals.append(normal)
                        offsets.append(cut)
                        children.append([0, 0])
                        todo += [(rows[~right], name, 0), (rows[right], name, 1)]
                        break
        if name is None:
            name, leaves = ~leaves, leaves + 1
        if parent >= 0:
            children[parent][side] = name
    d = x.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, d), np.array(offsets, np.float32), np.array(children, np.int64).reshape(-1, 2), leaves)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, zero or empty vectors, no null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, the products summed in order of the dimensions, so that equal vectors have equal scores."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers from -32767 to 32767, the factor that makes them x again, nearly) of each row."""
    scale = np.abs(x).max(axis=1, initial=0) / 32767
    return np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int16), scale


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k largest products of each query with other vectors, ties to smaller ids."""
    out = [[], [], []]
    step = max(1, (1 << 22) // max(1, len(x)))
    for lo in range(0, len(q), step):
        part, ids = q[lo : lo + step], q_ids[lo : lo + step]
        near = part @ x.T
        near[ids[:, None] == x_ids[None, :]] = -np.inf
        if near.shape[1] > k:
            floor = np.partition(near, -k, axis=1)[:, -k]
            slack = 1e-9 * np.maximum(1, np.abs(floor))
            i, j = np.nonzero(near >= (floor - slack)[:, None])
        else:
            i, j = np.nonzero(near > -np.inf)
        i, j = (z[near[i, j] > -np.inf] for z in (i, j))
        score = exact_products(part[i], x[j])
        order = np.lexsort((x_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        for o, z in zip(out, (ids[i[keep]], x_ids[j[keep]], score[keep]), strict=True):
            o.append(z)
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors found of largest inner product for each query.

    Queries are rows whose id is divisible by every; candidates are all rows but those of the query's id.
    Scores are exact, of the original vectors in double precision; ties go to the smaller id. Rows with
    null ids, vectors that are null, empty or zero and vectors with null or non-finite components take no
    part. Vectors of different lengths have no product: each length is a search of its own. Of repeated
    ids all vectors are candidates, each (query, vec_id) once with its largest score. Too few candidates:
    all of them. Other columns are not looked at.
    """
    rows = valid_vectors(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("bound")).orderBy("d").collect()
    found = [_nearest(rows.where(F.size("v") == r["d"]), r["d"], r["n"], r["bound"], k, every, **options) for r in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    both = found[0]
    for one in found[1:]:
        both = both.unionByName(one)
    # A repeated id may have vectors of several lengths.
    return _ranked(both, k) if len(found) > 1 else both


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, d: int, count: int, bound: float, k: int, every: int, *, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, recall: float = CALIBRATION_RECALL) -> DataFrame:
    """The neighbours of the queries among rows (vec_id, v) of one length d.

    Trees are grown on at most sample_rows rows chosen by a hash of their id, and every row is put into its
    leaf of each tree. One queue over all trees says in which order leaves are opened; how many is set
    by the exact neighbours of a bounded number of queries, so that the share recall of them is found.
    Leaves and queries meet by a shuffle in groups of bounded size, with two bytes for each component; a
    large leaf is dealt out in blocks. What a query opens in a group is scored at once, and RERANK * k
    candidates of it go on; the best of all groups meet the original vectors for their exact score.
    """
    spark = rows.sparkSession
    dice = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    share = min(1.0, 1.1 * sample_rows / count)
    sample = rows.where(dice < int(share * (1 << 30))).orderBy(dice, "vec_id").limit(sample_rows)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.zeros((0, d)), *(_matrix(batch.column(0)).reshape(-1, d) for batch in batches)])
        lifted = Forest([], float(bound)).lift(x)
        for t in range(trees):
            tree = grow(lifted, leaf_rows, t)
            yield pa.RecordBatch.from_arrays([pa.array([tree.leaves]), *(pa.array([z.tobytes()]) for z in (tree.normals, tree.offsets, tree.children))], ["leaves", "normals", "offsets", "children"])

    grown = sample.select("v").repartition(1).mapInArrow(plant, "leaves long, normals binary, offsets binary, children binary").collect()
    forest = Forest([Tree(np.frombuffer(r["normals"], np.float32).reshape(-1, d + 1), np.frombuffer(r["offsets"], np.float32), np.frombuffer(r["children"], np.int64).reshape(-1, 2), r["leaves"]) for r in grown], float(bound))
    planted = spark.sparkContext.broadcast(forest)
    queries = rows.where(F.col("vec_id") % every == 0)
    most = _calibrate(queries, rows, planted, k, recall)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = planted.value
        totals = [np.zeros(tree.leaves, np.int64) for tree in f.trees]
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                lifted = f.lift(x)
                for tree, total in zip(f.trees, totals, strict=True):
                    total += np.bincount(tree.leaf_of(lifted), minlength=tree.leaves)
        for t, total in enumerate(totals):
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(own.astype(np.int32)), pa.array(total[own])], ["tree", "leaf", "n"])

    # The number of leaves is bounded by the sample.
    sizes = [np.zeros(tree.leaves, np.int64) for tree in forest.trees]
    for r in rows.select("v").mapInArrow(measure, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["tree"]][r["leaf"]] = r["n"]
    blocks = [np.maximum(1, -(-n // BLOCK_ROWS)) for n in sizes]
    groups = max(GROUPS, math.ceil(count / GROUP_ROWS))
    layout = spark.sparkContext.broadcast((sizes, blocks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (_, blocks) = planted.value, layout.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            lifted, ids = f.lift(x), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            small, scale = quantized(x)
            with np.errstate(over="ignore"):
                salt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            data, scale = pa.array([v.tobytes() for v in small]), pa.array(scale.astype(np.float32))
            for t, tree in enumerate(f.trees):
                leaf = tree.leaf_of(lifted)
                grove = t * groups + leaf % groups
                yield pa.RecordBatch.from_arrays([pa.array(grove.astype(np.int32)), pa.array((salt % blocks[t][leaf]).astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(ids), data, scale], ["grove", "block", "leaf", "vec_id", "v", "scale"])

    held = rows.mapInArrow(place, "grove int, block int, leaf int, vec_id long, v binary, scale float")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (sizes, blocks) = planted.value, layout.value
        for batch in batches:
            x = _matrix(batch.column(1))
            out = []
            small, scale = quantized(x)
            for row, factor, lifted, query_id in zip(small, scale.tolist(), f.lift(x) if len(x) else x, batch.column(0).to_pylist(), strict=True):
                lifted[-1] = 0  # a query is not lifted: only its product with the vector counts
                groves: dict[tuple[int, int], list[int]] = {}
                # Trees may all hold the same rows, so that many are opened that k and the query itself are among them.
                for t, leaf in f.search(lifted, most, sizes, trees * (k + 1)):
                    for b in range(blocks[t][leaf]):
                        groves.setdefault((t * groups + leaf % groups, b), []).append(leaf)
                data = row.tobytes()
                out += [(g, b, np.array(sorted(leaves), np.int32).tobytes(), query_id, data, factor) for (g, b), leaves in groves.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.float32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["grove", "block", "leaves", "query_id", "v", "scale"])

    asked = queries.mapInArrow(ask, "grove int, block int, leaves binary, query_id long, v binary, scale float")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        leaf, x_ids = right.column("leaf").to_numpy(), right.column("vec_id").to_numpy()
        order = np.lexsort((x_ids, leaf))
        leaf, x_ids, scale = leaf[order], x_ids[order], right.column("scale").to_numpy().astype(float)[order]
        x = np.frombuffer(b"".join(right.column("v").to_pylist()), np.int16).reshape(-1, d)[order].astype(float)
        q = np.frombuffer(b"".join(left.column("v").to_pylist()), np.int16).reshape(-1, d).astype(float)
        factor = left.column("scale").to_numpy().astype(float)
        for i, (query_id, opened) in enumerate(zip(left.column("query_id").to_pylist(), left.column("leaves").to_pylist(), strict=True)):
            opened = np.frombuffer(opened, np.int32)
            lo = np.searchsorted(leaf, opened)
            at = ranges(lo, np.searchsorted(leaf, opened, "right") - lo)
            at = at[x_ids[at] != query_id]
            near = (x[at] @ q[i]) * scale[at]  # products of whole numbers are exact, so equal vectors tie
            if len(at) > RERANK * k:
                floor = np.partition(near, -RERANK * k)[-RERANK * k]
                best = np.flatnonzero(near >= floor)
                at, near = at[best], near[best]
                if len(at) > RERANK * k:
                    best = np.lexsort((x_ids[at], -near))[: RERANK * k]
                    at, near = at[best], near[best]
            for o, z in zip(got, (np.full(len(at), query_id), x_ids[at], near * factor[i]), strict=True):
                o.append(z)
        a, b, s = (np.concatenate(o) for o in got)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    keys = ["grove", "block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
    close = _ranked(found, RERANK * k).select("query_id", "vec_id")
    pairs = close.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(rows, "vec_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return _ranked(pairs.select("query_id", "vec_id", product.alias("score")), k)


def _calibrate(queries: DataFrame, rows: DataFrame, planted, k: int, recall: float) -> int:
    """How many leaves must be opened so that the share recall of some queries' neighbours is found.

    A bounded number of queries is answered exactly by one pass over all rows; how early the queue
    opens a leaf of each neighbour says how many leaves it needs.
    """
    dice = F.xxhash64("vec_id", F.lit(9))
    chosen = queries.orderBy(dice, "vec_id").limit(CALIBRATION_QUERIES).collect()
    if not chosen:
        return 1
    q_ids, q = np.array([r["vec_id"] for r in chosen]), np.array([r["v"] for r in chosen])
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((q, q_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids = sent.value
        f = planted.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            x_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, b, s = best_of(q, q_ids, x, x_ids, k)
            row = np.array([np.flatnonzero(x_ids == i)[0] for i in b], np.int64) if len(b) else np.zeros(0, np.int64)
            lifted = f.lift(x[row]) if len(row) else np.zeros((0, x.shape[1] + 1), np.float32)
            leaves = np.stack([tree.leaf_of(lifted) for tree in f.trees], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(float)), pa.array([z.tobytes() for z in leaves], pa.binary())], ["query_id", "vec_id", "score", "leaves"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = rows.mapInArrow(run, "query_id long, vec_id long, score double, leaves binary").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).collect()
    forest = planted.value
    total = sum(tree.leaves for tree in forest.trees)
    opened = {}
    for i, v in zip(q_ids.tolist(), q, strict=True):
        lifted = np.append(v, 0).astype(np.float32)
        opened[i] = {leaf: n for n, leaf in enumerate(forest.search(lifted, total), 1)}
    needs = sorted(min(opened[r["query_id"]][t, leaf] for t, leaf in enumerate(np.frombuffer(r["leaves"], np.int32).tolist())) for r in true)
    return needs[min(len(needs) - 1, math.ceil(recall * len(needs)))] if needs else 1
