"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into shards. In a shard every tree is a sorted array of long hash strings, one bit per
random hyperplane. A query descends in all trees at once to its longest prefix match, then ascends
all trees together, a bit at a time, which widens the prefix ranges. It stops when a vector as near
as the k-th best found so far would have stood in none of the ranges with a probability of at most
``miss``; so how far it ascends follows from the data, and no number of candidates is fixed. Should
that never hold, it ends at the root, which is every row of the shard.

Largest inner products become largest cosines by one more coordinate, sqrt(M^2 - |x|^2), M being the
largest norm of the shard. The forest looks at vectors divided by powers of two, which keeps norms and
products in the range of a double; scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm.common import cut

BITS = 24


def exponent(vectors: np.ndarray) -> int:
    """Of the least power of two above every component."""
    return int(np.frexp(np.abs(vectors).max())[1])


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, seed: int):
        self.ids, self.original, self.scale = ids, vectors, exponent(vectors)
        self.vectors = vectors = np.ldexp(vectors, -self.scale)
        norms = np.sqrt((vectors**2).sum(1))
        self.largest = norms.max()
        extra = np.sqrt(np.maximum(self.largest**2 - norms**2, 0))
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * BITS))
        codes = self.codes(vectors, extra)
        order = np.argsort(codes, axis=1, kind="stable")
        self.tree = np.arange(trees, dtype="i8") << BITS + 1
        self.sorted = (np.take_along_axis(codes, order, 1) + self.tree[:, None]).ravel()
        self.rows = order.ravel()

    def codes(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """One string of BITS bits for each tree and vector."""
        trees = self.planes.shape[1] // BITS
        out = np.empty((trees, len(vectors)), "i8")
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype="i8")
        for lo in range(0, len(vectors), 2048):
            some = slice(lo, lo + 2048)
            side = np.hstack([vectors[some], extra[some, None]]) @ self.planes > 0
            out[:, some] = (side.reshape(-1, trees, BITS) @ weight).T
        return out

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows stand that share ``depth`` bits with each query's string, in every tree. The
        queries' strings are looked up in their own order, which keeps to one part of the array."""
        order = np.argsort(codes, axis=1)
        low = self.tree[:, None] + (np.take_along_axis(codes, order, 1) >> BITS - depth << BITS - depth)
        lo, hi = np.empty_like(low), np.empty_like(low)
        np.put_along_axis(lo, order, np.searchsorted(self.sorted, low), 1)
        np.put_along_axis(hi, order, np.searchsorted(self.sorted, low + (1 << BITS - depth)), 1)
        return lo, hi

    def search_all(self, own: np.ndarray, vectors: np.ndarray, k: int, miss: float):
        """(ids, scores) for each query in turn."""
        scales = [exponent(v) for v in vectors]
        scaled = np.ldexp(vectors, -np.asarray(scales)[:, None])
        codes = self.codes(scaled, np.zeros(len(vectors)))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at(depth: int, i: int) -> tuple[np.ndarray, np.ndarray]:
            if depth not in known:
                known[depth] = self.ranges(codes, depth)
            return known[depth][0][:, i], known[depth][1][:, i]

        for i in range(len(vectors)):
            found = self.search(own[i], scaled[i], lambda depth, i=i: at(depth, i), k, miss)
            scores = self.products(found, vectors[i], scaled[i], self.scale + scales[i])
            first = np.lexsort((self.ids[found], -scores))[:k]
            yield self.ids[found[first]], scores[first]

    def products(self, found: np.ndarray, vector: np.ndarray, scaled: np.ndarray, power: int) -> np.ndarray:
        """Batches sum in orders of their own; the finalists are scored again, all in one order. A sum
        that leaves the range of a double is infinite, with the sign of the sum of scaled products."""
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.original[found] * vector).sum(axis=1)
            return np.where(np.isfinite(scores), scores, np.ldexp((self.vectors[found] * scaled).sum(axis=1), power))

    def search(self, own: int, vector: np.ndarray, at, k: int, miss: float) -> np.ndarray:
        """Where the rows stand that may be among the ``k`` nearest of those looked at."""
        seen = np.zeros(len(self.ids), bool)
        seen[self.ids == own] = True
        found, scores = np.empty(0, "i8"), np.empty(0)
        left = len(seen) - int(seen.sum())
        reach = np.sqrt((vector**2).sum()) * self.largest
        slack = 1e-12 * len(vector) * reach  # what another order of summation may change
        trees = len(self.tree)
        # Down to the longest prefix that some tree holds, by halving; then up, a bit at a time.
        short, long = 0, BITS
        while short < long:
            depth = (short + long + 1) // 2
            lo, hi = at(depth)
            short, long = (depth, long) if (hi > lo).any() else (short, depth - 1)
        for depth in range(short, -1, -1):
            lo, hi = at(depth)
            if (hi > lo).any():
                rows = np.concatenate([self.rows[a:b] for a, b in zip(lo, hi) if b > a])
                fresh = np.zeros(len(seen), bool)
                fresh[rows] = True
                rows = np.flatnonzero(fresh & ~seen)
                if len(rows):
                    seen |= fresh
                    left -= len(rows)
                    found, scores = np.concatenate([found, rows]), np.concatenate([scores, self.vectors[rows] @ vector])
                    if len(found) > k:
                        least = np.partition(scores, -k)[-k]
                        near = scores >= least - slack
                        found, scores = found[near], scores[near]
            if not left:
                break
            if len(found) >= k:
                same = 1 - np.arccos(np.clip(np.partition(scores, -k)[-k] / reach, -1, 1)) / np.pi
                if (1 - same**depth) ** trees <= miss:
                    break
        return found


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (array of double), of rows with an id and a vector that is neither null, zero nor
    has null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    held = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    return held.where(~F.exists("vector", bad)).where(F.exists("vector", lambda x: x != 0))


def nearest(
    rows: DataFrame, every: int = 20, k: int = 20, trees: int = 48, miss: float = 0.05, shard_rows: int = 16_384, queries_each: int = 1024, seed: int = 7,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id is divisible by
    ``every``, best first, ties to the smaller id.

    Rows with the query's id are its own and not candidates. Repeated ids are one row where their
    vectors are equal; a repeated id with several vectors is a candidate with each, and as a query is
    ranked over all of its vectors' candidates. Vectors meet those of their own length only. Rows with a
    null id, and vectors that are null, zero or hold a null or non-finite component, take no part. Products
    beyond the range of a double are infinite and tie with each other. An empty
    table gives no rows; other columns are not carried. Queries are blocks of ``queries_each``, and each
    block meets each shard once, so a task holds a shard and a block: work grows with queries times rows."""
    held = cut(usable(rows, vec_id, embedding).distinct(), "vectors")
    n = held.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * queries_each)))
    here = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")
    size = F.size("vector").alias("dims")
    data = held.select("*", size, here, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = held.where(F.col("vec_id") % every == 0)
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = asked.select("*", size, block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        forest = Forest(left["vec_id"].to_numpy(), np.stack(left["vector"].to_numpy()), trees, seed)
        asking = np.stack(right["vector"].to_numpy())
        own = right["vec_id"].to_numpy()
        out = [pd.DataFrame({"query_id": q, "vec_id": i, "score": s}) for q, (i, s) in zip(own, forest.search_all(own, asking, k, miss))]
        return pd.concat(out)[names]

    keys = ["dims", "shard", "block"]
    tasks = shards * blocks
    met = data.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
