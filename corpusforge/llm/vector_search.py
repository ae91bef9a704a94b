"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Distinct vectors are dealt into shards by hash. A shard's graph is built by greedy searches that propose neighbours and
relaxed distance pruning that keeps diverse edges; queries run a beam search on every shard, scores are computed in
double precision on the original vectors, and each query's best are merged. Inner products become distances by one
more coordinate, the square root of what a vector's squared norm lacks to the shard's largest.

Every query goes to every shard, so the work of a search grows with queries times shards; shards are as large as a task's
memory allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import save

#: Bytes of a shard's vectors (131,072 of 64 numbers). While there are fewer shards than cores, a shard may have fewer
#: vectors, but not fewer than LEAST_ROWS.
SHARD_BYTES = 64 << 20
LEAST_ROWS = 8192
#: Edges of a vector, beam width while building and searching, relaxation of the second pass.
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
ALPHA = 1.2
#: Vectors searched or pruned together, and queries sent to a shard together.
BATCH = 1024
QUERY_BLOCK = 16384


class Graph:
    """A shard's vectors (with the extra coordinate), neighbours (padded with the vector itself) and entry points."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None):
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(squares.max() - squares, 0))
        scale = max(float(np.sqrt(squares.max())), 1e-300)
        self.points = (np.concatenate([vectors, extra[:, None]], axis=1) / scale).astype(np.float32)
        n = len(vectors)
        random = np.random.default_rng(5)
        centre = int((self.points @ self.points.mean(axis=0)).argmax())
        self.entries = np.unique(np.concatenate([[centre], random.integers(0, n, min(n, 16))]))
        self.neighbours = random.integers(0, n, (n, min(DEGREE, max(n - 1, 1)))) if neighbours is None else neighbours

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: vectors found and their half squared distances less a constant, nearest first;
        a beam with free places holds -1."""
        n = len(queries)
        beam = max(beam, len(self.entries))
        ids = np.full((n, beam), -1, dtype=np.int64)
        far = np.full((n, beam), np.inf, dtype=np.float32)
        seen = np.ones((n, beam), dtype=bool)
        halves = (self.points**2).sum(axis=1) / 2
        e = len(self.entries)
        ids[:, :e], seen[:, :e] = self.entries, False
        far[:, :e] = halves[self.entries] - queries @ self.points[self.entries].T
        order = far.argsort(axis=1, kind="stable")
        ids, far, seen = (np.take_along_axis(x, order, axis=1) for x in (ids, far, seen))
        while len(open_ := np.flatnonzero(~seen.all(axis=1))):
            at = (~seen[open_]).argmax(axis=1)
            seen[open_, at] = True
            near = self.neighbours[ids[open_, at]]
            distance = halves[near] - np.matmul(self.points[near], queries[open_][:, :, None])[:, :, 0]
            ranked = np.sort(near, axis=1)
            if (ranked[:, 1:] == ranked[:, :-1]).any():
                by_id = near.argsort(axis=1, kind="stable")
                twice = np.zeros_like(near, dtype=bool)
                np.put_along_axis(twice, by_id[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
                distance[twice] = np.inf
            distance[distance >= far[open_, -1:]] = np.inf
            rows, columns = np.nonzero(distance < np.inf)
            known = (ids[open_[rows]] == near[rows, columns][:, None]).any(axis=1)
            distance[rows[known], columns[known]] = np.inf
            changed = (distance < np.inf).any(axis=1)
            open_, near, distance = open_[changed], near[changed], distance[changed]
            if not len(open_):
                continue
            all_far = np.concatenate([far[open_], distance], axis=1)
            best = all_far.argsort(axis=1, kind="stable")[:, :beam]
            ids[open_] = np.take_along_axis(np.concatenate([ids[open_], near], axis=1), best, axis=1)
            far[open_] = np.take_along_axis(all_far, best, axis=1)
            unseen = np.concatenate([seen[open_], np.zeros_like(near, dtype=bool)], axis=1)
            seen[open_] = np.take_along_axis(unseen, best, axis=1) | np.isinf(far[open_])
        ids[np.isinf(far)] = -1
        return ids, far

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of candidates (n, c; -1: none): take the nearest, drop all that are alpha times nearer to it
        than to the node, and so on. Free places hold the node itself."""
        degree = self.neighbours.shape[1]
        points = self.points[nodes]
        others = self.points[np.maximum(candidates, 0)]
        away = ((others - points[:, None, :]) ** 2).sum(axis=2)
        away[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
        kept = np.repeat(nodes[:, None], degree, axis=1)
        rows = np.arange(len(nodes))
        for k in range(degree):
            pick = away.argmin(axis=1)
            alive = np.isfinite(away[rows, pick])
            if not alive.any():
                break
            kept[alive, k] = candidates[rows, pick][alive]
            from_pick = ((others - others[rows, pick][:, None, :]) ** 2).sum(axis=2)
            away[(alpha * alpha * from_pick <= away) & alive[:, None]] = np.inf
            away[rows, pick] = np.inf
        return kept

    def build(self) -> None:
        n = len(self.points)
        random = np.random.default_rng(6)
        for alpha in (1.0, ALPHA):
            order = random.permutation(n)
            for start in range(0, n, BATCH):
                nodes = order[start : start + BATCH]
                found, _ = self.search(self.points[nodes], BUILD_BEAM)
                self.neighbours[nodes] = self.prune(nodes, np.concatenate([found, self.neighbours[nodes]], axis=1), alpha)
                self._link_back(nodes, alpha)

    def _link_back(self, nodes: np.ndarray, alpha: float) -> None:
        """Add the reverse of the nodes' edges; a neighbour that would have too many is pruned again."""
        to = self.neighbours[nodes].ravel()
        back = np.repeat(nodes, self.neighbours.shape[1])
        keep = to != back
        to, back = to[keep], back[keep]
        order = to.argsort(kind="stable")
        to, back = to[order], back[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        for low in range(0, len(targets), BATCH):
            some, at, many = (x[low : low + BATCH] for x in (targets, first, counts))
            arrivals = np.full((len(some), many.max()), -1, dtype=np.int64)
            inside = np.arange(many.max()) < many[:, None]
            arrivals[inside] = back[at[0] : at[-1] + many[-1]]
            arrivals[(arrivals[:, :, None] == self.neighbours[some][:, None, :]).any(axis=2)] = -1
            for part in range(0, arrivals.shape[1], 64):
                candidates = np.concatenate([self.neighbours[some], arrivals[:, part : part + 64]], axis=1)
                self.neighbours[some] = self.prune(some, candidates, alpha)


def usable(embedding) -> Column:
    """Not null, of finite components, not all of them zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """rep, vector, ids: each usable vector once, with its smallest vec_id and its k + 1 smallest ones in order: of
    equal vectors no answer needs more."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    return few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def build_index(distinct: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """dims, shard, place, rep, vector, neighbours: the graph of every shard, as a written table; neighbours are places
    in the shard. Vectors of different length never meet. shard_rows: vectors of a shard, SHARD_BYTES of them if None."""
    cores = distinct.sparkSession.sparkContext.defaultParallelism
    most = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(1), F.floor(SHARD_BYTES / (8 * F.col("dims"))))
    shards = F.ceil(F.col("n") / most)
    if not shard_rows:
        shards = F.greatest(shards, F.least(F.lit(cores), F.ceil(F.col("n") / LEAST_ROWS)))
    # A row for each length of vectors.
    layout = distinct.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).select("dims", shards.cast("int").alias("shards"))
    total = layout.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        graph = Graph(np.stack(rows["vector"].to_numpy()))
        graph.build()
        return rows.assign(place=np.arange(len(rows)), neighbours=list(graph.neighbours))[["dims", "shard", "place", "rep", "vector", "neighbours"]]

    dealt = distinct.withColumn("dims", F.size("vector")).join(layout, "dims")
    dealt = dealt.select("dims", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"), "rep", "vector")
    schema = "dims int, shard int, place long, rep long, vector array<double>, neighbours array<long>"
    # A given number of partitions isn't coalesced: shards are small, but a task for each takes its time.
    dealt = dealt.repartition(4 * max(int(total), cores), "dims", "shard")
    return save(dealt.groupBy("dims", "shard").applyInPandas(build, schema), "graph")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query, rep, score: the k + 1 best distinct vectors of each of queries (query: long, vector), of all shards.

    Queries go to every shard of their length, in blocks of bounded size."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = index.select(F.col("dims").alias("to_dims"), F.col("shard").alias("to_shard")).distinct()

    def search(graph_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(graph_rows) or not len(query_rows):
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        graph_rows = graph_rows.sort_values("place", ignore_index=True)
        vectors = np.stack(graph_rows["vector"].to_numpy())
        graph = Graph(vectors, np.stack(graph_rows["neighbours"].to_numpy()))
        reps, found = graph_rows["rep"].to_numpy(), []
        asked = np.stack(query_rows["vector"].to_numpy())
        for start in range(0, len(asked), BATCH):
            exact = asked[start : start + BATCH]
            norms = np.sqrt((exact**2).sum(axis=1, keepdims=True))
            scaled = np.concatenate([exact / norms, np.zeros((len(exact), 1))], axis=1).astype(np.float32)
            ids, _ = graph.search(scaled, beam)
            scores = np.einsum("nbd,nd->nb", vectors[np.maximum(ids, 0)], exact)
            scores[ids < 0] = -np.inf
            best = np.lexsort((reps[np.maximum(ids, 0)], -scores))[:, : k + 1]
            rows, columns = np.nonzero(np.isfinite(np.take_along_axis(scores, best, axis=1)))
            taken = best[rows, columns]
            found.append(pd.DataFrame({"query": query_rows["query"].to_numpy()[start + rows], "rep": reps[ids[rows, taken]], "score": scores[rows, taken]}))
        return pd.concat(found)

    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    asked = queries.select("query", "vector", block.alias("to_block")).join(shards, F.size("vector") == F.col("to_dims"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dims", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*[f"to_{k}" for k in keys])).applyInPandas(search, "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query its k nearest others, by inner product in
    double precision, ties to the smaller vec_id; all others, if there are fewer.

    Rows with a null vec_id, and null, zero or not finite vectors, take no part; fully repeated rows count once. Only
    vectors of a query's own length are its candidates. An empty table gives no rows. Other columns are ignored.
    """
    distinct = save(distinct_vectors(vectors, k, vec_id, embedding), "vectors")
    index = build_index(distinct, shard_rows)
    asked = vectors.filter(is_query).select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("vector"))
    asked = asked.filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    asked = save(asked.join(distinct.select("vector", "rep"), "vector").select("query_id", "rep"), "queries")
    queries = distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("query"), "vector")
    found = search_index(index, queries, k, beam)
    members = found.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    answers = members.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("answers"))
    others = F.filter("answers", lambda a: a["vec_id"] != F.col("query_id"))
    joined = asked.join(answers, F.col("rep") == F.col("query")).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "answer"))
    return joined.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "answer.vec_id", "answer.score")
