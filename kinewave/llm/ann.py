"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard, results merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .vectors import best_of, distinct, flat_ids, paired, query_blocks, valid

DEGREE, EF_BUILD, EF_SEARCH, SHARD_SIZE, MAX_LEVEL = 16, 64, 256, 32_768, 5
#: Nodes that are linked at a time.
ROWS = 512
#: Vectors of a shard have largest components within this power of two of each other.
BAND = 8
RESULT = "query_id long, vec_id long, score double"


def search_layer(vectors: np.ndarray, links: np.ndarray, query: np.ndarray, entries: list[int], ef: int) -> list[tuple[float, int]]:
    """The ef most similar nodes found from the entries along links, most similar first."""
    seen = np.zeros(len(vectors), bool)
    seen[entries] = True
    sims = (vectors[entries] @ query).tolist()
    open_ = [(-s, e) for s, e in zip(sims, entries, strict=True)]
    best = list(zip(sims, entries, strict=True))
    heapq.heapify(open_)
    heapq.heapify(best)
    while open_:
        s, node = heapq.heappop(open_)
        if len(best) >= ef and -s < best[0][0]:
            break
        near = links[node]
        near = near[near >= 0]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        sims = vectors[near] @ query
        if len(best) >= ef:
            better = sims > best[0][0]
            sims, near = sims[better], near[better]
        for s, e in zip(sims.tolist(), near.tolist(), strict=True):
            if len(best) < ef:
                heapq.heappush(best, (s, e))
            elif s > best[0][0]:
                heapq.heapreplace(best, (s, e))
            else:
                continue
            heapq.heappush(open_, (-s, e))
    return sorted(best, reverse=True)


def select(vectors: np.ndarray, ranked: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (most similar first, -1 for none) up to m that no chosen one is closer to than the row's node
    is; then the closest of the rest; -1 where there are no more."""
    own = vectors[ranked]
    among = own @ own.transpose(0, 2, 1)
    there, count = ranked >= 0, np.zeros(len(ranked), np.int64)
    chosen, covered = np.zeros(ranked.shape, bool), np.full(ranked.shape, -np.inf)
    for i in range(ranked.shape[1]):
        now = np.flatnonzero((covered[:, i] < sims[:, i]) & there[:, i] & (count < m))
        chosen[now, i] = True
        count[now] += 1
        covered[now] = np.maximum(covered[now], among[now, i])
    order = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ranked, order, axis=1)


def nearest(vectors: np.ndarray, a: int, b: int, end: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar of the first `end` nodes to each of the nodes a to b, without itself, most similar first; sims."""
    sims = vectors[a:b] @ vectors[:end].T
    sims[np.arange(b - a), np.arange(a, b)] = -np.inf
    k = min(k, end - 1)
    ranked = np.argpartition(sims, end - k, axis=1)[:, end - k :]
    near = np.take_along_axis(sims, ranked, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ranked, order, axis=1), np.take_along_axis(near, order, axis=1)


def link_back(vectors: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Targets get links to their sources: all while there is room, else select() decides among old and the closest new ones."""
    sims = np.concatenate([(vectors[source[x : x + 65_536]] * vectors[target[x : x + 65_536]]).sum(axis=1) for x in range(0, len(source), 65_536)])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    every, first, counts = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, counts)
    row = np.repeat(np.arange(len(every)), counts)
    width = links.shape[1]
    for s in range(0, len(every), ROWS):
        some = every[s : s + ROWS]
        at = np.arange(*np.searchsorted(row, [s, s + len(some)]))
        at = at[rank[at] < EF_BUILD]
        new = np.full((len(some), EF_BUILD), -1, np.int64)
        new[row[at] - s, rank[at]] = source[at]
        both = np.sort(np.concatenate([links[some], new], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        near = np.where(both >= 0, (vectors[both] @ vectors[some][:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")[:, : max(width, int((both >= 0).sum(axis=1).max()))]
        ranked, near = np.take_along_axis(both, order, axis=1), np.take_along_axis(near, order, axis=1)
        full = (ranked >= 0).sum(axis=1) > width
        links[some[~full]] = ranked[~full, :width]
        if full.any():
            links[some[full]] = select(vectors, ranked[full], near[full], width)


def linked(vectors: np.ndarray, width: int) -> np.ndarray:
    """Neighbour array (n, width) of one level. Nodes come in rounds, each as many as came before: a node is linked with some
    of the most similar of its round and those before, so early nodes keep links that reach far."""
    n = len(vectors)
    links = np.full((n, width), -1, np.int32)
    a = 0
    while a < n > 1:
        end = min(n, max(2 * a, EF_BUILD))
        source, target = [], []
        for s in range(a, end, ROWS):
            stop = min(s + ROWS, end)
            chosen = select(vectors, *nearest(vectors, s, stop, end, EF_BUILD), DEGREE)
            links[s:stop, : chosen.shape[1]] = chosen
            row, column = np.nonzero(chosen >= 0)
            source.append(s + row)
            target.append(chosen[row, column])
        link_back(vectors, links, np.concatenate(source), np.concatenate(target))
        a = end
    return links


class Graph:
    """Levels of flat neighbour arrays: links[level] is (n, degree), -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int) -> None:
        self.vectors, self.links, self.entry = vectors, links, entry

    @classmethod
    def built(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        draws = np.random.default_rng(3).random(n)
        levels = np.minimum((-np.log(1 - draws) / np.log(DEGREE)).astype(int), MAX_LEVEL)
        links = []
        for lv in range(levels.max() + 1 if n else 0):
            own = np.flatnonzero(levels >= lv).astype(np.int32)
            among = linked(vectors[own], DEGREE * (2 if lv == 0 else 1))
            links.append(np.full((n, among.shape[1]), -1, np.int32))
            links[lv][own] = np.where(among >= 0, own[among], -1)
        return cls(vectors, links, int(np.argmax(levels)) if n else 0)

    def search(self, query: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        start = [self.entry]
        for lv in range(len(self.links) - 1, 0, -1):
            start = [e for _, e in search_layer(self.vectors, self.links[lv], query, start, 1)]
        return [e for _, e in search_layer(self.vectors, self.links[0], query, start, max(ef, k))[:k]]


def lifted(v: np.ndarray) -> np.ndarray:
    """One component more, so that all have one length: the nearest by inner product are then the nearest by distance.

    The largest component is scaled to 1 first, so that no finite vector overflows. Lengths of a shard are within one band,
    so in double precision the added component does not swamp the others.
    """
    v = v / (np.abs(v).max(initial=0.0) or 1.0)
    squares = (v * v).sum(axis=1)
    return np.concatenate([v, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))[:, None]], axis=1)


def banded(classes: DataFrame, size: int) -> DataFrame:
    """classes with a shard: shards of about `size` vectors, each of vectors whose largest components are within 2**BAND of
    each other. Counts of bands come to the driver: double precision has 2,100 powers of two, so some 260 bands at most."""
    rows = classes.withColumn("band", F.floor(F.log2(F.array_max(F.transform("v", F.abs))) / BAND).cast("int"))
    first, count, parts = [], 0, {}
    for r in rows.groupBy("band").count().orderBy("band").collect():
        parts[r.band] = r["count"] // size + 1
        first.append((r.band, count))
        count += parts[r.band]
    if not first:
        return rows.withColumn("shard", F.lit(0)).drop("band")
    of = F.create_map(*[F.lit(x) for band, at in first for x in (band, f"{at}:{parts[band]}")])[F.col("band")]
    place = F.split(of, ":").cast("array<int>")
    return rows.withColumn("shard", (place[0] + F.pmod(F.xxhash64(F.lit(5), "v"), place[1])).cast("int")).drop("band")


INDEX = "dim int, shard int, n int, vectors binary, ids binary, cuts binary, links binary, widths array<int>, entry int"


def build_index(vectors: DataFrame, keep: int, size: int = SHARD_SIZE) -> DataFrame:
    """One row per shard: original vectors, their ids, and the graph's neighbour arrays, all flat. Every vector is in it."""

    def build(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        ids, cuts = flat_ids(table["ids"].to_pylist())
        graph = Graph.built(lifted(v))
        row = {
            "dim": pa.array([v.shape[1]], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()),
            "vectors": [v.tobytes()], "ids": [ids.tobytes()], "cuts": [cuts.tobytes()], "links": [b"".join(x.tobytes() for x in graph.links)],
            "widths": pa.array([[x.shape[1] for x in graph.links]], pa.list_(pa.int32())), "entry": pa.array([graph.entry], pa.int32()),
        }
        return pa.table(row)

    shards = banded(written(distinct(vectors, keep), "vectors"), size)
    return shards.groupBy("dim", "shard").applyInArrow(build, INDEX)


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, size: int = SHARD_SIZE, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, k rows of largest inner product.

    Candidates are all rows but the query's own, found by the graphs of all shards (approximate: the graph may miss some;
    scores are exact in double precision). Equal vectors are one node with their k + 1 smallest ids. Null vectors, zero
    vectors and those with null or non-finite components take no part; vectors meet those of their length only; a row
    of a repeated vec_id counts as itself. Queries go to shards in packed blocks; every block meets every shard, so the
    search grows with queries times shards, and shards are as large as a task can build. Vectors of any finite size are
    searched, in shards by bands of size; a score beyond double precision is infinite.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, allow_zero=False)
    index = written(build_index(rows, k + 1, size), "graph")
    blocks = written(query_blocks(rows, every), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, dim = row["n"], row["dim"]
                v = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
                ids, cuts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cuts"], np.int64)
                flat, links = np.frombuffer(row["links"], np.int32), []
                for width in row["widths"]:
                    links.append(flat[: n * width].reshape(n, width))
                    flat = flat[n * width :]
                graph = Graph(lifted(v), links, row["entry"])
                qids, qs = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["qs"], np.float64).reshape(-1, dim)
                out: tuple[list, list, list] = ([], [], [])
                for q, query in zip(qids.tolist(), qs, strict=True):
                    found = graph.search(np.append(query / np.abs(query).max(), 0), k + 1, ef)
                    scores = (v[found] * query).sum(axis=1)
                    some = [(s, i) for s, f in zip(scores.tolist(), found, strict=True) for i in ids[cuts[f] : cuts[f + 1]].tolist() if i != q]
                    for s, i in sorted(some, key=lambda x: (-x[0], x[1]))[:k]:
                        for column, value in zip(out, (q, i, s), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    small_batches(spark)
    return best_of(paired(blocks, index).mapInArrow(run, RESULT), k)
