"""Operator 4: approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors; every vector is then indexed in the leaf
that it falls into from the root. A query walks the tree best bin first: a priority queue holds the
nodes seen so far by their distance to the query, the nearest is opened next, and leaves are visited
until ``visits`` of them are. How many that takes is calibrated: some queries are also answered by
brute force over all vectors, and visits widen until their recall reaches the target.

Equal vectors are one vector of the index with their smallest ids: no answer needs more than
k + 1 of them. Small leaves that lie side by side are read as one block and a crowded leaf as many, and the
queries that visit a block in parts, so no task holds more than a block, a part and a bounded batch of routes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, table

CELLS = 1 << 20  # numbers that a task holds at once in one table of distances, or of vectors on their way

class Tree:
    """Nodes in arrays: ``centres[n]``, ``children[n]`` (empty at a leaf), ``leaf[n]`` (-1 inside)."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, branching: int, seed: int):
        self.centres, self.children, self.leaf = [np.zeros(sample.shape[1])], [[]], [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            parts = self._split(rows, branching, rng) if len(rows) > max(leaf_rows, branching) else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in parts:
                self.children[node].append(len(self.leaf))
                todo.append((len(self.leaf), own))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)
        self.squares = (self.centres**2).sum(axis=1)
        #: The nodes of each level below the root with their parents, and of each leaf its path below the root; short paths repeat their end.
        self.levels, paths = [], {0: []}
        level = [0]
        while pairs := [(kid, node) for node in level for kid in self.children[node]]:
            self.levels.append(tuple(np.array(p) for p in zip(*pairs, strict=True)))
            paths |= {kid: [*paths[node], kid] for kid, node in pairs}
            level = [kid for kid, _ in pairs]
        ends = {leaf: node for node, leaf in enumerate(self.leaf) if leaf >= 0}
        depth = max(1, len(self.levels))
        self.paths = np.array([(paths[n] or [n]) + [n] * (depth - max(1, len(paths[n]))) for _, n in sorted(ends.items())])

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(8):
            near = np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            used = np.unique(near)
            centres = np.array([rows[near == c].mean(axis=0) for c in used])
        near = np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        return [(centres[c], rows[near == c]) for c in np.unique(near)]

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.empty(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centres[kids]
            near = np.argmax(rows[at] @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
            todo.extend((int(kid), at[near == j]) for j, kid in enumerate(kids))
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, the best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            for far, kid in zip(((self.centres[kids] - query) ** 2).sum(axis=1), kids, strict=True):
                heapq.heappush(queue, (float(far), kid))

    def first(self, queries: np.ndarray, visits: int) -> np.ndarray:
        """For each query the leaves that ``walk`` gives first: ``visits`` of them as columns, the very first in front.

        A queue opens a leaf when the farthest node of its path has come up; of leaves behind the same farthest
        node those come first whose paths go on nearer.
        """
        far = (queries**2).sum(axis=1)[:, None] - 2 * (queries @ self.centres.T) + self.squares
        worst = far.copy()
        worst[:, 0] = -np.inf
        for nodes, parents in self.levels:
            worst[:, nodes] = np.maximum(worst[:, parents], worst[:, nodes])
        worst = worst[:, self.paths[:, -1]]
        visits = min(visits, self.leaves)
        bound = np.partition(worst, visits - 1, axis=1)[:, visits - 1]
        out = np.empty((len(queries), visits), np.int64)
        for k, (row, last) in enumerate(zip(worst, bound, strict=True)):
            sure, level = np.flatnonzero(row < last), np.flatnonzero(row == last)
            if len(level) > visits - len(sure):
                level = self._turns(far[k], level)[: visits - len(sure)]
            out[k] = np.append(sure, level)
            least = out[k][row[out[k]] == row[out[k]].min()]
            start = int(np.flatnonzero(out[k] == self._turns(far[k], least)[0])[0])
            out[k, [0, start]] = out[k, [start, 0]]
        return out

    def _turns(self, far: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """leaves in the order in which a queue opens them, by the distances of all nodes."""
        ahead = np.maximum.accumulate(far[self.paths[leaves]][:, ::-1], axis=1)[:, ::-1]
        return leaves[np.lexsort(ahead.T[::-1])]


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), dtype=float)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision by exactly rounded sums; the same in any order of the terms."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of vectors with only finite components, not all 0, of the most common length."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.where(finite)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length.n if length else 0))


def _tops(vectors: pd.DataFrame, queries: pd.DataFrame, keep: int, met=None) -> list[tuple]:
    """(q, id, score) of the ``keep`` best vectors (id, v) for each query (q, v), of those not below its ``floor``.

    met gives, for a range of queries, pairs of arrays: queries and the vectors that they meet, by position; all by default.
    Products within rounding of the last of the best are all scored exactly; ties go to the smaller id.
    """
    out = []
    vs, qs = _unit(vectors["v"]), _unit(queries["v"])
    floor = queries["floor"].to_numpy(copy=True) if "floor" in queries else np.full(len(queries), -2.0)
    raw_v, raw_q = vectors["v"].to_numpy(), queries["v"].to_numpy()
    ids, names = vectors["id"].to_numpy(), queries["q"].to_numpy()
    known: dict[int, tuple] = {}

    def scaled(v: np.ndarray) -> tuple[np.ndarray, float]:
        v = np.asarray(v, dtype=float)
        v = v / np.abs(v).max()
        return v, math.fsum((v * v).tolist())

    step = max(1, min(256, CELLS // max(1, len(vs))))
    for start in range(0, len(qs), step):
        stop = min(start + step, len(qs))
        hits = []
        for asks, rows in met(start, stop) if met else [(np.arange(start, stop), np.arange(len(vs)))]:
            near = qs[asks] @ vs[rows].T
            hit = near >= (floor[asks] - 1e-9)[:, None]
            for j in np.flatnonzero(np.count_nonzero(hit, axis=1) > keep):
                # its own best push the floor up: what lies under keep of them is no answer
                floor[asks[j]] = max(floor[asks[j]], np.partition(near[j][hit[j]], -keep)[-keep])
                hit[j] = near[j] >= floor[asks[j]] - 1e-9
            a, b = np.nonzero(hit)
            hits.append((asks[a], rows[b], near[a, b]))
        if not hits:
            continue
        ask, row, near = (np.concatenate(h) for h in zip(*hits, strict=True))
        order = np.lexsort((-near, ask))
        ask, row, near = ask[order], row[order], near[order]
        edges = np.flatnonzero(np.append(True, ask[1:] != ask[:-1])) if len(ask) else []
        for low, high in zip(edges, np.append(edges[1:], len(ask)).astype(int), strict=True):
            least = near[min(low + keep, high) - 1] - 1e-9
            a, aa = scaled(raw_q[ask[low]])
            scored = []
            for k, close in zip(row[low:high].tolist(), near[low:high].tolist(), strict=True):
                if close < least:
                    break
                if k not in known:
                    known[k] = scaled(raw_v[k])
                b, bb = known[k]
                scored.append((-math.fsum((a * b).tolist()) / math.sqrt(aa * bb), int(ids[k])))
            out.extend((int(names[ask[low]]), k, -score) for score, k in sorted(scored)[:keep])
    return out


def _met(leaf: np.ndarray, leaves: list[np.ndarray]):
    """For ``_tops``: queries meet the vectors of the leaves that they visit."""
    order = np.argsort(leaf, kind="stable")
    here, edges = np.unique(leaf[order], return_index=True)
    parts = dict(zip(here.tolist(), np.split(order, edges[1:]), strict=True))

    def met(start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = [np.asarray(v, dtype=np.int64) for v in leaves[start:stop]]
        ask, at = np.repeat(np.arange(start, stop), [len(v) for v in own]), np.concatenate(own)
        by = np.argsort(at, kind="stable")
        seen, cuts = np.unique(at[by], return_index=True)
        for k, asks in zip(seen.tolist(), np.split(ask[by], cuts[1:]), strict=True):
            if k in parts:
                yield asks, parts[k]

    return met


def _blocks(counts: dict[int, int], leaves: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first block and its number of blocks, of about ``rows`` vectors each."""
    first, many = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    block, held = 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if held and held + n > rows:
            block, held = block + 1, 0
        first[leaf] = block
        many[leaf] = max(1, -(-n // rows))
        held += n
        if many[leaf] > 1:
            block, held = block + int(many[leaf]), 0
    return first, many


def _brute(unique: DataFrame, queries: list, keep: int) -> DataFrame:
    """The best vectors of each of a few queries, over all: (q, id, score)."""
    shared = unique.sparkSession.sparkContext.broadcast(pd.DataFrame(queries, columns=["q", "v"]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(_tops(pdf, shared.value, keep), columns=["q", "id", "score"])

    every = unique.select("id", "v").mapInPandas(scan, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    target_recall: float = 0.97,
    sample_rows: int = 40_000,
    calibration_queries: int = 100,
    leaf_rows: int = 400,
    block_rows: int = 16_000,
    query_rows: int = 8_000,
    branching: int = 8,
    seed: int = 20240817,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, ties to the smaller vec_id.

    queries is one column (query_id) of ids in vectors; a query is not its own neighbour. Null ids
    and unusable vectors (see ``usable``) take no part. Ids should be unique; of rows that repeat an id
    the least vector counts. The sample of the tree and the calibration are bounded by
    ``sample_rows`` and ``calibration_queries``; all vectors are indexed.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    # equal vectors: the least id stands for them, and k + 1 ids are kept
    keyed = usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("key", F.xxhash64("v")).withColumn("key2", F.hash("v"))
    order = Window.partitionBy("key", "key2").orderBy("vec_id")
    kept = staged(keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1), "kept-vectors")
    unique = kept.where("n = 1").select(F.col("vec_id").alias("id"), "key", "key2", "v")
    size = unique.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], out)
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    rate = min(1.0, sample_rows / size)
    sample = unique.where(draw < int(1_000_000 * rate)).select("v").toPandas() if rate < 1 else unique.select("v").toPandas()
    sample = sample if len(sample) else unique.select("v").limit(1).toPandas()
    sample_vectors = _unit(sample["v"])
    tree = sc.broadcast(Tree(sample_vectors, leaf_rows * len(sample) / size, branching, seed))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=tree.value.place(_unit(pdf["v"])))

    indexed = staged(unique.mapInPandas(index, "id long, key long, key2 int, v array<double>, leaf long"), "leaves")
    counts = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row a leaf of the bounded tree
    # queries that are equal vectors are one query
    asked = queries.select(F.col("query_id").cast("long").alias("query_id")).where("query_id is not null").distinct()
    asked = staged(asked.join(keyed.select(F.col("vec_id").alias("query_id"), "key", "key2"), "query_id"), "queries")
    wanted = asked.select("key", "key2").distinct().join(indexed, ["key", "key2"]).select(F.col("id").alias("q"), "v")
    wanted = staged(wanted, "query-vectors")
    # calibration: widen the visits until the sampled queries find what brute force finds
    probe = [(r.q, list(r.v)) for r in wanted.orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(calibration_queries).collect()]
    visits = 1
    if probe:
        truth = _brute(indexed, probe, k + 1).join(indexed.select("id", "leaf"), "id").where("q <> id").select("q", "leaf").collect()
        ways = {q: {leaf: n for n, leaf in enumerate(tree.value.walk(u), 1)} for (q, _), u in zip(probe, _unit(pd.Series([v for _, v in probe])), strict=True)}
        turns = sorted(ways[r.q][r.leaf] for r in truth)
        visits = turns[math.ceil(target_recall * len(turns)) - 1] if turns else 1

    # a task compares at most about block_rows vectors with query_rows queries that visit them, and less where that leaves tasks idle
    dim = max(1, sample_vectors.shape[1])
    block_rows = min(block_rows, max(1000, min(CELLS // dim, size // (2 * sc.defaultParallelism))))
    query_rows = min(query_rows, max(1000, CELLS // dim))
    first_block, n_blocks = _blocks(counts, tree.value.leaves, block_rows)
    sizes = np.array([counts.get(leaf, 0) for leaf in range(tree.value.leaves)])
    per_batch = max(1, min(256, CELLS // max(len(tree.value.leaf), int(n_blocks.sum()) * dim)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), per_batch):
                part = pdf.iloc[start : start + per_batch]
                units = _unit(part["v"])
                rows = []
                for q, v, u, seen in zip(part["q"], part["v"], units, tree.value.first(units, visits), strict=True):
                    if sizes[seen].sum() <= k:  # too few vectors, so the walk goes on
                        way = np.fromiter(tree.value.walk(u), np.int64)
                        seen = way[: max(visits, int(np.searchsorted(np.cumsum(sizes[way]), k, "right")) + 1)]
                    for now, leaves in (("first", seen[:1]), ("later", seen[1:])):
                        leaves = leaves[sizes[leaves] > 0]
                        leaves = leaves[np.argsort(first_block[leaves], kind="stable")]
                        blocks, cuts = np.unique(first_block[leaves], return_index=True)
                        for block, own in zip(blocks.tolist(), np.split(leaves, cuts[1:]) if len(leaves) else [], strict=True):
                            rows.extend((q, v, now, block + j, own) for j in range(int(n_blocks[own].max())))
                yield pd.DataFrame(rows, columns=["q", "v", "turn", "block", "leaves"])

    visited = wanted.select("q", "v").mapInPandas(route, "q long, v array<double>, turn string, block long, leaves array<int>")
    asks = [(r.block, -(-r["count"] // query_rows)) for r in visited.groupBy("block").count().collect()]  # one row a block
    asks = F.broadcast(spark.createDataFrame(asks, "block long, parts long"))
    plan = [(leaf, int(first_block[leaf]), int(n_blocks[leaf])) for leaf in counts]
    plan = F.broadcast(spark.createDataFrame(plan, "leaf long, first_block long, n_blocks long"))  # one row a leaf of the bounded tree
    routed = visited.join(asks, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).drop("parts")
    dealt = indexed.join(plan, "leaf").withColumn("block", F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("n_blocks"))).join(asks, "block")
    dealt = dealt.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select("block", "part", "leaf", "id", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = _tops(left, right, k + 1, _met(left["leaf"].to_numpy(), right["leaves"].tolist())) if len(left) and len(right) else []
        return pd.DataFrame(rows, columns=["q", "id", "score"])

    def searched(asks: DataFrame) -> DataFrame:
        groups = dealt.groupBy("block", "part").cogroup(asks.groupBy("block", "part"))
        return groups.applyInPandas(compare, "q long, id long, score double")

    # the leaf opened first sets a floor: what lies under its k + 1 best is no answer and is not handed on
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    first = staged(searched(routed.where("turn = 'first'").drop("turn")), "first-leaf")
    ranked = first.withColumn("n", F.row_number().over(best))
    floors = ranked.where(F.col("n") == k + 1).select("q", F.col("score").alias("floor"))
    later = routed.where("turn = 'later'").drop("turn").join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    found = first.unionByName(searched(later))
    found = staged(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "found")
    # back to ids: of the queries that share a vector, and of the vectors that are equal
    named = indexed.select("id", "key", "key2")
    answers = found.join(named.select(F.col("id").alias("q"), F.col("key").alias("qk"), F.col("key2").alias("qk2")), "q").join(named, "id")
    answers = answers.join(kept.select("key", "key2", "vec_id"), ["key", "key2"]).select("qk", "qk2", "vec_id", "score")
    each = asked.join(answers, (asked.key == answers.qk) & (asked.key2 == answers.qk2)).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))
