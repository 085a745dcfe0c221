"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` vectors, chosen by a hash of the id): a node
splits at the median of the projection onto the difference of two random vectors of its sample. The
number of leaves follows the number of all vectors, up to ``MOST_LEAVES`` a tree, so a forest is at
most ``TREES`` * ``MOST_LEAVES`` planes. Every vector is filed in one leaf of each tree. A query
searches all trees through one priority queue: the unexplored branch with the largest margin,
whichever tree it is in, comes next, until the leaves taken hold enough vectors (counted once per
tree). How many are enough is measured: up to ``PROBES`` queries, chosen by a hash, are compared with
all vectors, and as much is looked at as brings ``RECALL`` of their true neighbours into the leaves
taken, but ``LOOK`` vectors at least. Leaves and queries meet by a join on the leaf; in each leaf the
candidates are ranked by their exact inner product in double precision, and the queries' lists are
merged.

The largest inner product of unit vectors is the smallest distance. Vectors of other lengths are
compared after one more component is added that makes all as long as the longest, which keeps the
order of inner products.

Equal vectors are filed once: as their ``nearest + 1`` smallest ids, since no other copy can be
among the nearest. Equal queries are searched once, and each of their ids takes the common list
without itself. Leaves beyond ``LEAF_ROWS`` vectors or ``LEAF_QUERIES`` queries are cut into several
parts.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with a null id or another number of components than most. Repeated rows count
once. With fewer candidates than asked for, all that were found are returned. Empty tables give
empty results. Only vec_id and embedding are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.sources.work import stored

NEAREST, TREES, LEAF, LOOK = 20, 16, 400, 48_000
SAMPLE, MOST_LEAVES, LEAF_ROWS, LEAF_QUERIES = 32_768, 4096, 4096, 16_384
PROBES, RECALL, SALTS = 256, 0.95, 4096


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    return vectors.select("vec_id", F.col("embedding").alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))


class Tree:
    """Planes of a complete binary tree, heap order: node k has the children 2k+1 and 2k+2."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, inner = depth, (1 << depth) - 1
        self.normals = np.zeros((inner, sample.shape[1]), np.float32)
        self.cuts = np.zeros(inner, np.float32)
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node)
            # too few vectors left to split: any direction will do
            pick = sample[rng.choice(own, 2, replace=False)] if len(own) > 1 else \
                rng.standard_normal((2, sample.shape[1]))
            normal = pick[0] - pick[1]
            normal /= np.linalg.norm(normal) or 1.0
            self.normals[node] = normal
            side = sample[own] @ self.normals[node]
            self.cuts[node] = np.median(side) if len(own) else 0.0
            right = side > self.cuts[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", rows, self.normals[node]) > self.cuts[node]
            node = 2 * node + 1 + right
        return node - len(self.cuts)


class Forest:
    def __init__(self, sample: np.ndarray, longest: float, depth: int, trees: int, seed: int = 11):
        self.longest = longest
        rng = np.random.default_rng(seed)
        self.trees = [Tree(self.lifted(sample), depth, rng) for _ in range(trees)]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """One more component, so that all are as long as the longest."""
        rest = np.maximum(0.0, self.longest ** 2 - (rows * rows).sum(1))
        return np.concatenate((rows, np.sqrt(rest)[:, None]), 1).astype(np.float32)

    def order(self, query: np.ndarray) -> np.ndarray:
        """All leaves (tree * number of leaves + leaf) in order of their margins: the largest
        margin crossed on the way to a leaf."""
        row = np.append(query, 0.0).astype(np.float32)
        margins = np.stack([t.normals @ row - t.cuts for t in self.trees])
        worst = np.full((len(self.trees), 1), -np.inf)
        for level in range(self.trees[0].depth):
            m = margins[:, (1 << level) - 1:(2 << level) - 1]
            far, right = np.maximum(worst, np.abs(m)), m > 0
            worst = np.stack((np.where(right, far, worst), np.where(right, worst, far)), 2)
            worst = worst.reshape(len(self.trees), -1)
        return np.argsort(worst, axis=None, kind="stable")

    def search(self, query: np.ndarray, held: np.ndarray, look: int) -> np.ndarray:
        """Leaves in their order until they hold ``look`` vectors; ``held``: how many each leaf
        holds."""
        order = self.order(query)
        n = held.ravel()[order]
        return order[(n > 0) & (np.cumsum(n) - n < look)]

    def reach(self, query: np.ndarray, held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The least ``look`` that brings each of the rows into a leaf taken."""
        order = self.order(query)
        n = held.ravel()[order]
        least = np.empty(held.size, np.int64)
        least[order] = np.cumsum(n) - n + 1
        rows = self.lifted(rows)
        return np.min([least[t * held.shape[1] + tree.leaf(rows)]
                       for t, tree in enumerate(self.trees)], axis=0)


def _file(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, v) to (leaf, key, v), one row per tree."""
        for b in batches:
            rows = forest.lifted(_matrix(b.column(1)))
            n, some = len(rows), len(forest.trees[0].cuts) + 1
            for t, tree in enumerate(forest.trees):
                leaf = pa.array(t * some + tree.leaf(rows)) if n else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([leaf, b.column(0), b.column(1)],
                                                 ["leaf", "key", "v"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length in double precision."""
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _search(forest: Forest, held: np.ndarray, look: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, v) to (key, v, leaves)."""
        for b in batches:
            rows = _matrix(b.column(1))
            for at in range(0, len(rows), 64):
                found = [forest.search(r, held, look) for r in rows[at:at + 64]]
                ends = np.cumsum([0, *map(len, found)])
                leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(
                    np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 64), b.column(1).slice(at, 64), leaves],
                    ["key", "v", "leaves"])
    return run


def _compare(keys: np.ndarray, probes: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, v) to (probe, key, score): of each probe the best of the task's other vectors."""
        score, key = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int64)
        for b in batches:
            for at in range(0, len(b), 4096):
                own = b.column(0).slice(at, 4096).to_numpy()
                s = probes @ _matrix(b.column(1).slice(at, 4096)).T
                s[own == keys[:, None]] = -np.inf
                score = np.concatenate((score, s), 1)
                key = np.concatenate((key, np.broadcast_to(own, s.shape)), 1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
                score, key = np.take_along_axis(score, top, 1), np.take_along_axis(key, top, 1)
        probe, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(probe), pa.array(key[probe, at]), pa.array(score[probe, at])],
            ["probe", "key", "score"])
    return run


def enough(forest: Forest, single: DataFrame, queries: DataFrame, held: np.ndarray, nearest: int,
           recall: float) -> int:
    """The ``look`` with which hash-chosen queries find ``recall`` of their true neighbours."""
    probes = queries.orderBy(F.xxhash64(F.lit("probe"), "key"), "key").limit(PROBES).collect()
    if not probes:
        return 0
    keys, rows = np.array([r.key for r in probes]), np.array([r.v for r in probes], np.float64)
    best = single.select("key", "v").mapInArrow(
        _compare(keys, rows, nearest), "probe bigint, key bigint, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "key")
    true = (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
            .join(single.select("key", "v"), "key").select("probe", "v").collect())
    near: dict[int, list] = {}
    for r in true:  # at most PROBES * nearest vectors
        near.setdefault(r.probe, []).append(r.v)
    least = [forest.reach(rows[i], held, np.array(v, np.float64)) for i, v in near.items()]
    if not least:
        return 0
    least = np.sort(np.concatenate(least))
    return int(least[math.ceil(recall * len(least)) - 1])


def _parts(counts: np.ndarray, most: int) -> Column:
    """Into how many parts of about ``most`` rows the leaf of a row is cut."""
    parts = np.maximum(1, -(-counts.ravel() // most))
    if parts.max() == 1:
        return F.lit(1)
    return F.get(F.from_json(F.lit(json.dumps(parts.tolist())), "array<int>"),
                 F.col("leaf").cast("int"))


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order for every pair."""
    out = np.zeros(np.broadcast_shapes(queries.shape[:-1], rows.shape[:-1]))
    for k in range(rows.shape[-1]):
        out += queries[..., k] * rows[..., k]
    return out


RANKED = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])


def _rank(nearest: int):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        """Of each query the best of one leaf's vectors, and all that tie with the last of them."""
        if not len(members) or not len(queries):
            return RANKED.empty_table()
        m = _matrix(members.column("v"))
        ids, keys = queries.column("query_id").to_numpy(), members.column("key").to_numpy()
        out, k = [], min(nearest + 1, len(m))
        for at in range(0, len(ids), 512):
            q = _matrix(queries.column("q").slice(at, 512))
            rough = q @ m.T
            least = np.partition(rough, len(m) - k, axis=1)[:, len(m) - k]
            who, what = np.nonzero(rough >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None])))
            out.append(pa.Table.from_arrays(
                [pa.array(ids[at + who]), pa.array(keys[what]), pa.array(exact(q[who], m[what]))],
                schema=RANKED))
        return pa.concat_tables(out)
    return run


def neighbours(vectors: DataFrame, every: int, nearest: int = NEAREST, trees: int = TREES,
               leaf: int = LEAF, look: int = LOOK, sample: int = SAMPLE,
               recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` of each vector whose id is divisible by
    ``every``. ``look`` is the least that is looked at; it grows until the measured recall is
    ``recall``."""
    rows = stored(valid(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return rows.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == size.n)
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= nearest + 1)
    single = stored(kept.groupBy("v").agg(F.min("vec_id").alias("key"),
                                          F.array_sort(F.collect_set("vec_id")).alias("ids")), "single")
    some = single.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(sample)
    fitted = np.array([r.v for r in some.select("v").collect()])  # at most ``sample`` vectors
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = single.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    depth = max(0, math.ceil(math.log2(max(1, min(facts.n / leaf, MOST_LEAVES, len(fitted) / 2)))))
    forest = Forest(fitted, math.sqrt(facts.longest), depth, trees)
    kind = rows.schema["v"].dataType.simpleString()
    filed = stored(single.select("key", "v").mapInArrow(
        _file(forest), f"leaf bigint, key bigint, v {kind}"), "filed")
    held = np.zeros((trees, 1 << depth), np.int64)
    for r in filed.groupBy("leaf").count().collect():  # a row per leaf
        held[divmod(r.leaf, 1 << depth)] = r["count"]
    # a frequent vector's queries come as lists of some of them
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(
        "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).agg(F.collect_list("vec_id").alias("asking"))
    asked = stored(asked.join(single.select("v", "key"), "v").select("key", "asking"), "asked")
    queries = single.select("key", "v").join(asked.select("key").distinct(), "key", "left_semi")
    if look < trees * facts.n:  # else all is looked at
        look = max(look, enough(forest, single, queries, held, nearest, recall))
    queries = stored(queries.select("key", "v").mapInArrow(
        _search(forest, held, look), f"key bigint, v {kind}, leaves array<int>"), "searched")
    queries = queries.select(F.explode(F.col("leaves").cast("array<bigint>")).alias("leaf"),
                             F.col("key").alias("query_id"), F.col("v").alias("q"))
    asking = np.zeros(held.size, np.int64)
    for r in queries.groupBy("leaf").count().collect():  # a row per leaf
        asking[r.leaf] = r["count"]
    rows_in, queries_in = _parts(held, LEAF_ROWS), _parts(asking, LEAF_QUERIES)

    def own(key: str, parts: Column, name: str) -> Column:
        return F.pmod(F.xxhash64(key), parts).cast("int").alias(name)

    def each(parts: Column, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1)).alias(name)
    meet = ["leaf", "part", "query_part"]
    ranked = (filed.select("*", own("key", rows_in, "part"), each(queries_in, "query_part"))
              .groupBy(*meet)
              .cogroup(queries.select("*", each(rows_in, "part"),
                                      own("query_id", queries_in, "query_part")).groupBy(*meet))
              .applyInArrow(_rank(nearest), "query_id bigint, key bigint, score double"))
    best = ranked.groupBy("query_id", "key").agg(F.max("score").alias("score"))

    def first_of(found: DataFrame, name: str, most: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), name)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    copies = (first_of(best, "key", nearest + 1).join(single.select("key", "ids"), "key")
              .select("query_id", "score", F.explode("ids").alias("vec_id")))
    lists = first_of(copies, "vec_id", nearest + 1).groupBy("query_id").agg(F.array_sort(
        F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list"))
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return (asked.join(lists.withColumnRenamed("query_id", "key"), "key")
            .select(F.explode("asking").alias("query_id"), "list")
            .select("query_id", F.posexplode(others).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"))
