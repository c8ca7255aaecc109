"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees, one priority queue a query.

Trees split by random directions at the median of a bounded sample (SAMPLE distinct vectors, those with the smallest hashed
ids); every row is indexed. A query walks all trees through one queue ordered by its summed squared distance to the splits it
crossed, until the leaves it has opened hold a share of the vectors (counted once a tree). Their rows are then ranked by the
exact inner product in double precision. The share is the least that finds TARGET of the true nearest on the sample, measured
there with ASKED of its vectors as queries: small where vectors form groups, large where they are spread evenly. The sample is
thinner than the table, so its neighbours are farther and its share errs to the safe side.

Vectors get one more component, the root of the largest squared norm less their own, so that nearness in the trees follows
the inner product. Equal vectors are indexed once, with their k + 1 smallest ids; more can't be among anyone's k nearest. Equal queries
are asked once, for the k + 1 nearest, of which each leaves out itself.
Rows meet queries leaf by leaf, one copy of a row for each tree: the leaves that follow each other in a tree make a tile of CHUNK
numbers or so, and a leaf of more is cut into several. The rows and queries of a tile are sorted together, rows first; a task holds
one tile at a time, and queries stream past it. A query comes to a tile once, with the leaves it opens there and the score that its
k + 1 nearest have at least: that of the k + 1 nearest rows of the sample that it opens. Only rows that reach it leave the tile.

Defined cases: vectors that are null or zero, have null or non-finite components or another length than most take no part,
neither as queries nor as candidates. Ties go to the smaller id. With fewer candidates than k, all are returned. An empty
table gives no rows. Extra columns are not read. A repeated id counts as one vector for each of its different values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrid.llm.common import Workspace, let

TREES, LEAF, TARGET, SAMPLE, ASKED, SEED = 12, 256, 0.94, 16_384, 200, 5
#: Numbers (rows x components) of a tile, and of a block of scores.
CHUNK, BLOCK = 2_097_152, 2_097_152
#: Candidates that a task gathers before it keeps the k best of each query.
HELD = 1_000_000


@dataclass
class Forest:
    """Node i of tree t splits by directions[t][i] at cuts[t][i]; a child below zero is leaf -child - 1."""

    directions: list[np.ndarray]
    cuts: list[np.ndarray]
    children: list[np.ndarray]
    leaves: list[int]
    top: float
    #: rows in each leaf, by tree; set once all rows are indexed
    sizes: list[np.ndarray] | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))])

    def leaf_of(self, t: int, lifted: np.ndarray) -> np.ndarray:
        at = np.zeros(len(lifted), dtype=np.int64)
        if not len(self.cuts[t]):
            return at
        inner = np.arange(len(lifted))
        while len(inner):
            node = at[inner]
            side = np.einsum("ij,ij->i", lifted[inner], self.directions[t][node]) >= self.cuts[t][node]
            at[inner] = self.children[t][node, side.astype(np.int64)]
            inner = inner[at[inner] >= 0]
        return -at - 1

    def leaves_of(self, lifted: np.ndarray) -> np.ndarray:
        """A row a tree, with the leaves numbered through all trees."""
        base = np.cumsum([0, *self.leaves])
        return np.array([base[t] + self.leaf_of(t, lifted) for t in range(len(self.cuts))])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """(leaves of all trees, queries): what the queue is ordered by. Queries are not lifted: their last component is 0."""
        out, base = np.zeros((sum(self.leaves), len(queries))), np.cumsum([0, *self.leaves])
        for t, children in enumerate(self.children):
            gaps = self.directions[t][:, :-1] @ queries.T - self.cuts[t][:, None]
            far, leaf = np.zeros_like(gaps), out[base[t] : base[t + 1]]
            at = np.arange(min(1, len(children)))
            while len(at):  # a level of the tree
                gap = gaps[at]
                for side in (0, 1):
                    to, way = children[at, side], far[at] + np.where((gap >= 0) == side, 0.0, gap * gap)
                    far[to[to >= 0]], leaf[-to[to < 0] - 1] = way[to >= 0], way[to < 0]
                at = children[at].ravel()
                at = at[at >= 0]
        return out

    def probe(self, queries: np.ndarray, enough: float) -> list[np.ndarray]:
        """For each query the leaves, numbered through all trees, in the order of one queue over them until they hold enough rows."""
        sizes, found = np.concatenate(self.sizes), []
        guess = int(min(len(sizes), 1.3 * enough / max(1.0, sizes.mean()) + len(self.cuts)))
        for far in np.ascontiguousarray(self.distances(queries).T):
            n = guess
            while True:
                first = np.sort(np.argpartition(far, n - 1)[:n]) if n < len(far) else np.arange(len(far))
                first = first[np.argsort(far[first], kind="stable")]
                held = np.cumsum(sizes[first])
                if n == len(far) or held[-1] >= enough:
                    break
                n = min(len(far), 2 * n)
            found.append(first[: np.searchsorted(held, enough) + 1])
        return found


def grow(sample: np.ndarray, top: float, trees: int, smallest: float) -> Forest:
    """Split the sample at medians until a node has at most `smallest` of it."""
    rng = np.random.default_rng(SEED)
    forest = Forest([], [], [], [], top)
    lifted = forest.lift(sample)
    for _ in range(trees):
        directions, cuts, children, leaves = [], [], [], 0
        waiting = [(np.arange(len(lifted)), -1, 0)]  # (rows, parent, side)
        while waiting:
            rows, parent, side = waiting.pop()
            split = None
            if len(rows) > smallest and len(rows) > 1:
                for _ in range(3):
                    d = rng.standard_normal(lifted.shape[1])
                    d /= np.linalg.norm(d)
                    p = lifted[rows] @ d
                    cut = float(np.median(p))
                    if 0 < (p >= cut).sum() < len(rows):
                        split = d, cut, p >= cut
                        break
            if split is None:
                me = -leaves - 1
                leaves += 1
            else:
                me = len(cuts)
                directions.append(split[0])
                cuts.append(split[1])
                children.append([0, 0])
                waiting += [(rows[split[2]], me, 1), (rows[~split[2]], me, 0)]
            if parent >= 0:
                children[parent][side] = me
        forest.directions.append(np.array(directions).reshape(len(cuts), lifted.shape[1]))
        forest.cuts.append(np.array(cuts))
        forest.children.append(np.array(children, dtype=np.int64).reshape(-1, 2))
        forest.leaves.append(leaves)
    return forest


def share_for(forest: Forest, sample: np.ndarray, k: int, target: float) -> float:
    """The least share of the vectors with which the sample's queries find `target` of their k nearest in the sample."""
    n = len(sample)
    leaves = forest.leaves_of(forest.lift(sample))
    sizes = np.bincount(leaves.ravel(), minlength=sum(forest.leaves))
    forest.sizes = np.split(sizes, np.cumsum(forest.leaves)[:-1])
    costs = []
    for i in np.random.default_rng(SEED).permutation(n)[:ASKED]:
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score)[: min(k, n - 1)]
        (order,) = forest.probe(sample[i : i + 1], np.inf)
        cost = np.zeros(len(sizes))
        cost[order] = np.cumsum(sizes[order]) - sizes[order]
        costs.append(cost[leaves[:, near]].min(0))
    flat = np.concatenate(costs) if costs else np.zeros(0)
    return float(np.quantile(flat, target, method="higher") + 1) / n if len(flat) else float(len(forest.cuts))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """(first, found) with the k nearest different candidates of each query among the three arrays."""
    order = np.lexsort((ids, -score, query))
    q, ids, score = query[order], ids[order], score[order]
    fresh = np.ones(len(q), dtype=bool)
    fresh[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])  # the same row may come from several trees
    q, ids, score = q[fresh], ids[fresh], score[fresh]
    heads = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q)))) < k
    q, ids, score = q[keep], ids[keep], score[keep]
    heads = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], names=["s", "id"])
    return pa.RecordBatch.from_arrays([pa.array(q[heads]), pa.ListArray.from_arrays(np.append(heads, len(q)).astype(np.int32), pairs)], names=["first", "found"])


def below(score: np.ndarray) -> np.ndarray:
    """A little less, as products of matrices are rounded in another way than the score that is returned."""
    return score - 1e-9 * np.maximum(1, np.abs(score))


class Tile:
    """The rows of a tile in the order of their leaves."""

    def __init__(self, parts: list[pa.RecordBatch], size: int):
        leaf = np.concatenate([np.asarray(p.column("leaves").flatten()) for p in parts])
        order = np.argsort(leaf, kind="stable")
        self.rows = np.concatenate([matrix(p.column("v"), size) for p in parts])[order]
        ids = pa.concat_arrays([p.column("ids") for p in parts])
        offsets, self.flat = np.asarray(ids.offsets), np.asarray(ids.values)
        self.first, self.each = offsets[:-1][order], np.diff(offsets)[order]
        leaves, at = np.unique(leaf[order], return_index=True)
        self.ranges = dict(zip(leaves.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(leaf)])))

    def near(self, queries: pa.RecordBatch, size: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, score) of the rows that may be among the k nearest of a query, some at a time."""
        x, asks = matrix(queries.column("v"), size), np.asarray(queries.column("ids").flatten())
        least, opened = np.array(queries.column("least")), queries.column("leaves")
        leaf, who = np.asarray(opened.flatten()), np.repeat(np.arange(len(x)), np.asarray(opened.value_lengths()))
        order = np.argsort(leaf, kind="stable")
        leaf, who = leaf[order], who[order]
        edges = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        for a, b in zip(edges, [*edges[1:], len(leaf)]):
            start, end = self.ranges.get(int(leaf[a]), (0, 0))
            n = end - start
            if not n:
                continue
            step = max(1, BLOCK // n)
            for s in range(a, b, step):
                q = who[s : min(s + step, b)]
                score = x[q] @ self.rows[start:end].T
                free = np.isneginf(least[q])
                if n > k and free.any():
                    least[q[free]] = below(np.partition(score[free], n - k, axis=1)[:, n - k])
                i, what = np.divmod(np.flatnonzero(score >= least[q, None]), n)
                i, what = q[i], what + start
                if not len(i):
                    continue
                exact = np.concatenate([(x[i[u : u + 4096]] * self.rows[what[u : u + 4096]]).sum(1) for u in range(0, len(i), 4096)])
                each = self.each[what]
                at = np.repeat(self.first[what], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield np.repeat(asks[i], each), self.flat[at], np.repeat(exact, each)


def rank_tiles(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Nearest candidates of (tile, kind, ids, leaves, least, v), sorted by tile and kind: rows (kind 0) with their ids, then queries (kind 1)."""
    now, held, tile = None, [], None
    gathered, n = [], 0
    for batch in batches:
        tiles, kind = np.asarray(batch.column("tile")), np.asarray(batch.column("kind"))
        edges = np.flatnonzero(np.concatenate([[True], (tiles[1:] != tiles[:-1]) | (kind[1:] != kind[:-1])])) if len(tiles) else []
        for a, b in zip(edges, [*edges[1:], len(tiles)]):
            part = batch.slice(a, b - a)
            if tiles[a] != now:
                now, held, tile = tiles[a], [], None
            if kind[a] == 0:
                held.append(part)
                continue
            if held:
                held, tile = [], Tile(held, size)
            for found in tile.near(part, size, k) if tile else ():
                gathered.append(found)
                n += len(found[0])
                if n > HELD:
                    yield best_of(*map(np.concatenate, zip(*gathered)), k)
                    gathered, n = [], 0
    if gathered:
        yield best_of(*map(np.concatenate, zip(*gathered)), k)


def tiles_of(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first tile, number of tiles) of each leaf: leaves share a tile while they hold at most so many rows; one of more has tiles of its own."""
    chunks = np.maximum(1, -(-held // most))
    starts, tile, full = np.zeros(len(held), dtype=np.int64), 0, 0
    for i, (n, c) in enumerate(zip(held.tolist(), chunks.tolist())):
        if full and full + n > most:
            tile, full = tile + 1, 0
        starts[i] = tile
        tile, full = (tile + c, 0) if c > 1 else (tile, full + n)
    return starts, chunks


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds, without itself.

    share: of the vectors, to be opened by each query; None measures it for the target.
    """
    spark = df.sparkSession
    given = df.schema[vector].dataType
    kind = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.max(norm).alias("top")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, _, top = sizes[0]
    rows = rows.where(F.size("v") == size)
    space = Workspace(spark)
    few = rows.select("id", "v").distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = space.keep(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    kinds = classes.count()
    sample = matrix(classes.orderBy(F.xxhash64(F.get("ids", F.lit(0)))).limit(SAMPLE).select("v").toArrow().column("v"), size)
    forest = grow(sample, top, trees, max(1.0, leaf * len(sample) / kinds))
    if share is None:
        share = share_for(forest, sample, k, target)
    first = spark.sparkContext.broadcast(forest)  # at most trees * SAMPLE nodes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(sum(first.value.leaves), dtype=np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                x = first.value.lift(matrix(b.column("v").slice(s, 1024), size))
                n += np.bincount(first.value.leaves_of(x).ravel(), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["leaf", "n"])

    held = np.zeros(sum(forest.leaves), dtype=np.int64)
    for r in classes.select("v").mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one row a leaf
        held[r["leaf"]] = r["n"]
    forest.sizes = np.split(held, np.cumsum(forest.leaves)[:-1])
    enough = max(share * kinds, 4.0 * leaf)
    starts, chunks = tiles_of(held, max(1, CHUNK // size))
    sent = spark.sparkContext.broadcast((forest, sample, forest.leaves_of(forest.lift(sample))))

    def rows_of(tile: np.ndarray, kind: int, ids: pa.Array, leaves: pa.Array, least: np.ndarray, v: pa.Array) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(tile), kind, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(tile), kinds, ids, leaves, pa.array(least), v], names=["tile", "kind", "ids", "leaves", "least", "v"])

    def lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                ids, n = part.column("ids"), part.num_rows
                spread = np.asarray(pa.compute.list_element(ids, 0))
                for leaves in sent.value[0].leaves_of(sent.value[0].lift(matrix(part.column("v"), size))):
                    tile = starts[leaves] + (spread * 0x9E3779B1 >> 7) % chunks[leaves]
                    yield rows_of(tile, 0, ids, lists(np.arange(n + 1), leaves.astype(np.int32)), np.zeros(n), part.column("v"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sample, placed = sent.value
        for b in batches:
            for s in range(0, b.num_rows, 32):
                ids, v = np.asarray(b.column("id").slice(s, 32)), matrix(b.column("v").slice(s, 32), size)
                found, least = forest.probe(v, enough), np.full(len(ids), -np.inf)
                score = v @ sample.T
                for i, leaves in enumerate(found):
                    opened = np.zeros(sum(forest.leaves), dtype=bool)
                    opened[leaves] = True
                    seen = score[i, opened[placed].any(0)]
                    if len(seen) > k:
                        least[i] = below(np.partition(seen, len(seen) - k - 1)[len(seen) - k - 1])
                leaf, who = np.concatenate(found), np.repeat(np.arange(len(ids)), [len(x) for x in found])
                each = chunks[leaf]
                tile = np.repeat(starts[leaf] - np.cumsum(each) + each, each) + np.arange(each.sum())
                leaf, who = np.repeat(leaf, each), np.repeat(who, each)
                order = np.lexsort((tile, who))
                leaf, who, tile = leaf[order], who[order], tile[order]
                at = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (who[1:] != who[:-1])))
                i = who[at]
                yield rows_of(tile[at], 1, lists(np.arange(len(i) + 1), ids[i]), lists(np.append(at, len(leaf)), leaf.astype(np.int32)), least[i], b.column("v").take(pa.array(i + s)))

    form = f"tile long, kind int, ids array<long>, leaves array<int>, least double, v array<{kind}>"
    tiles = classes.select("ids", "v").mapInArrow(place, form)
    asked = rows.where("q").select("id", "v")
    firsts = space.keep(asked.groupBy("v").agg(F.min("id").alias("id")))
    probes = firsts.mapInArrow(ask, form)
    met = tiles.unionByName(probes).repartition("tile").sortWithinPartitions("tile", "kind")
    found = met.mapInArrow(lambda batches: rank_tiles(batches, size, k + 1), "first long, found array<struct<s:double,id:long>>")
    several = found.groupBy("first").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    fresh = let(F.col("found"), lambda x: F.filter(x, lambda y, i: (i == 0) | (y != F.get(x, i - 1))))  # array_distinct() compares all pairs of structs
    best = several.select("first", F.slice(fresh, 1, k + 1).alias("best"))
    each = asked.join(firsts.withColumnRenamed("id", "first"), "v").select(F.col("id").alias("query_id"), "first").join(best, "first")
    out = each.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
