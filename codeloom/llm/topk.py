"""Exact top-k search by inner product with a KD-tree in each shard.

Components x become floor(1024 * x), x as double. Rows are cut into cells by median
splits fitted on a bounded sample (every row is indexed), cells into shards of a
bounded number of rows by a hash of the row, so copies of one vector spread. In each
shard a KD-tree is built by median splits; each node keeps the tight box of its
vectors. The inner product of a query with any vector of a box is at most the sum
over components of the larger of q*lo and q*hi.

A query first searches a shard of its own cell, best bound first; the kth score found
goes with it to all other shards, where boxes below it are not opened. Queries travel
in blocks, a block a row; a pair of block and shard is one unit of work.

Rows whose vector is null or has null, NaN or infinite components take no part.
Vectors of different lengths are never compared. Ties go to the smaller id, null ids
last. Queries are the rows whose id is divisible by ``step``; a query meets every row
but its own, rows that repeat it included. Scores beyond a long are cut to its range.
Empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import written

K = 10
SCALE = 1024
#: Rows of the sample that the cells are fitted on, at most; cells at most; rows of a shard, about; rows of a leaf; queries of a block.
SAMPLE, CELLS, SHARD_ROWS, LEAF, BLOCK = 8192, 256, 8192, 128, 512
_NO_ID = 2**63 - 1
_EXACT = 2.0**52


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in column], dtype=np.int64).reshape(len(column), -1)


def split_cells(sample: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """Median splits as (dimension, value, left, right); a child below 0 is cell -1 - child."""
    nodes: list[list[int]] = []
    made = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal made
        wide = (rows.max(axis=0) - rows.min(axis=0)) if len(rows) else np.zeros(0)
        if want <= 1 or not wide.size or wide.max() == 0:
            made += 1
            return -made
        d = int(wide.argmax())
        cut = int(np.median(rows[:, d]))
        left = rows[:, d] <= cut
        if left.all():
            left = rows[:, d] < (cut := int(rows[:, d].max()))
            cut -= 1
        me = len(nodes)
        nodes.append([d, cut, 0, 0])
        nodes[me][2] = grow(rows[left], want - want // 2)
        nodes[me][3] = grow(rows[~left], want // 2)
        return me

    grow(sample, cells)
    return [tuple(n) for n in nodes]


def cell_of(rows: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.int64)
    todo = [(0, np.arange(len(rows)))] if nodes else []
    while todo:
        at, some = todo.pop()
        d, cut, left, right = nodes[at]
        low = rows[some, d] <= cut
        for child, part in ((left, some[low]), (right, some[~low])):
            if child < 0:
                out[part] = -1 - child
            elif len(part):
                todo.append((child, part))
    return out


class Tree:
    """A KD-tree over integer vectors; nodes in arrays, a leaf's rows side by side."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        order, lo, hi, kids, spans = np.arange(len(rows)), [], [], [], []

        def grow(a: int, z: int) -> int:
            part = rows[order[a:z]]
            me, low, high = len(lo), part.min(axis=0), part.max(axis=0)
            lo.append(low)
            hi.append(high)
            kids.append((-1, -1))
            spans.append((a, z))
            if z - a > LEAF and part.shape[1] and (high > low).any():
                d = int((high.astype(np.float64) - low).argmax())
                mid = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(part[:, d], mid)]
                kids[me] = (grow(a, a + mid), grow(a + mid, z))
            return me

        grow(0, len(rows))
        self.lo, self.hi, self.kids, self.spans = np.array(lo), np.array(hi), kids, spans
        self.rows, self.ids, self.uids = rows[order], ids[order], uids[order]

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, and the scores and places of at most k rows that reach its kth score."""
        most = max([np.abs(x.astype(np.float64)).max(initial=0) for x in (self.lo, self.hi)])
        exact = most * np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0) < _EXACT
        kind = np.float64 if exact else object
        q, lo, hi, rows = (x.astype(kind) for x in (queries, self.lo, self.hi, self.rows))
        bounds = np.where(q > 0, q, 0) @ hi.T + np.where(q < 0, q, 0) @ lo.T
        for n in range(len(q)):
            limit, best = kth[n], []
            scores, places = np.empty(0, dtype=kind), np.empty(0, dtype=np.int64)
            queue = [(-bounds[n, 0], 0)]
            while queue and -queue[0][0] >= limit:
                _, at = heapq.heappop(queue)
                left, right = self.kids[at]
                if left >= 0:
                    for child in (left, right):
                        if bounds[n, child] >= limit:
                            heapq.heappush(queue, (-bounds[n, child], child))
                    continue
                a, z = self.spans[at]
                got = rows[a:z] @ q[n]
                good = np.flatnonzero((got >= limit) & (self.uids[a:z] != own[n]))
                if len(good):
                    scores, places = np.concatenate([scores, got[good]]), np.concatenate([places, good + a])
                    best = np.lexsort((self.uids[places], self.ids[places], -scores))[:k]
                    scores, places = scores[best], places[best]
                    if len(best) == k:
                        limit = max(limit, scores[-1])
            yield n, scores, places


def _packed(rows: DataFrame, *by: str) -> DataFrame:
    """Queries of each group as one row: by, count, queries (their numbers, vectors, homes and kth scores)."""

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps((part["uid"].to_numpy(), part["vec_id"].to_numpy(), _matrix(part["vec"]), part["home"].to_numpy(), part["kth"].to_numpy()))
        return pd.DataFrame([[*key, blob]], columns=[*by, "queries"])

    return rows.groupBy(*by).applyInPandas(pack, ", ".join(f"{c} long" for c in by) + ", queries binary")


def _searched(pairs: DataFrame, k: int, elsewhere: bool) -> DataFrame:
    """Searches the tree of each row for its block of queries; elsewhere: queries at home in this shard are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, tree, blob in zip(b["shard"], b["tree"], b["queries"], strict=True):
                uid, qid, vec, home, kth = pickle.loads(blob)
                take = np.flatnonzero(home != shard) if elsewhere else np.arange(len(uid))
                if not len(take):
                    continue
                tree_ = pickle.loads(tree)
                out = [(uid[take[n]], qid[take[n]], home[take[n]], int(tree_.ids[p]), int(tree_.uids[p]), min(max(int(s), -(2**63)), 2**63 - 1)) for n, scores, places in tree_.search(vec[take], uid[take], kth[take], k) for s, p in zip(scores, places, strict=True)]
                if out:
                    yield pd.DataFrame(out, columns=["uid", "query_id", "home", "id", "row", "score"])

    return pairs.mapInPandas(run, "uid long, query_id long, home long, id long, row long, score long")


def _of_length(vectors: DataFrame, k: int, step: int, rows: int) -> DataFrame:
    """The search among vectors of one length."""
    cells = max(1, min(CELLS, -(-rows // SHARD_ROWS)))
    sample = vectors.select("vec").orderBy(F.xxhash64("uid")).limit(SAMPLE).collect() if cells > 1 else []
    nodes = split_cells(_matrix([r["vec"] for r in sample]), cells) if sample else []

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=cell_of(_matrix(b["vec"]), nodes))

    located = written(vectors.mapInPandas(locate, "vec_id long, uid long, vec array<long>, cell long"))
    counts = {r["cell"]: r["count"] for r in located.groupBy("cell").count().collect()}
    first, parts, shards = {}, {}, 0
    for cell in sorted(counts):
        first[cell], parts[cell] = shards, -(-counts[cell] // SHARD_ROWS)
        shards += parts[cell]
    of = lambda values: F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in values.items() for x in kv]), F.col("cell"))
    sharded = located.withColumn("shard", of(first) + F.pmod(F.xxhash64("uid"), of(parts)))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        ids = part["vec_id"].fillna(_NO_ID).to_numpy(dtype=np.int64)
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(Tree(_matrix(part["vec"]), ids, part["uid"].to_numpy()))]})

    trees = written(sharded.select("shard", F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "uid", "vec").groupBy("shard").applyInPandas(build, "shard long, tree binary"))
    asked = sharded.filter(F.col("vec_id") % step == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    queries = asked.select("uid", "vec_id", "vec", F.col("shard").alias("home"), F.lit(float("-inf")).alias("kth"), F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).alias("block"))
    near = written(_searched(_packed(queries, "home", "block").withColumnRenamed("home", "shard").join(trees, "shard"), k, False))
    bound = near.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("low")).select("uid", F.when((F.col("n") >= k) & (F.abs(F.col("low").cast("double")) < _EXACT), F.col("low").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    told = _packed(queries.drop("kth").join(bound, "uid", "left").fillna(float("-inf"), "kth"), "block")
    pairs = told.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).join(trees, "shard") if shards > 1 else None
    return near if pairs is None else near.unionByName(_searched(pairs, k, True))


def top_k(df: DataFrame, k: int = K, step: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k rows of highest score, or all if fewer."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    vectors = written(df.filter(x.isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), scaled.alias("vec")))
    found = None
    for r in vectors.groupBy(F.size("vec").alias("d")).count().collect():
        part = _of_length(vectors.filter(F.size("vec") == r["d"]), k, step, r["count"])
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("id") != _NO_ID, F.col("id")).alias("vec_id"), "score")
