"""Exact top-k by integer inner product: dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, written
from .vectors import best_of, distinct, flat_ids, paired, query_blocks, sharded, valid

SCALE, LEAF, SHARD_SIZE = 256, 64, 16_384
RESULT = "query_id long, vec_id long, score long"
#: Whole numbers below this are exact in double precision, and so are their sums.
EXACT = 2.0**53
#: How much narrower a level is than the one above. In many dimensions all distances are alike, and balls half as wide hold
#: one point each; levels this close still gather some.
BASE = 1.1
#: Points that a group of queries is scored against at a time.
SCORED = 4096
#: Scores are cut to a long; as doubles, its ends.
ENDS = (-(2.0**63), 2.0**63)
NODE = np.dtype([("centre", "<i8"), ("start", "<i8"), ("stop", "<i8"), ("parent", "<i8"), ("radius", "<f8"), ("longest", "<f8"), ("angle", "<f8")])


class CoverTree:
    """Levels of balls, each `base` times narrower than the one above: the centres of a node's children are farther apart
    than the children's width (separation), and every point of the node is within that width of a child's centre (covering).

    Nodes are rows of one flat array; points of a node are one slice of `order`. Of its points a node knows the largest
    distance from the centre (`radius`), the largest length and the largest angle from the centre, so that bounds by balls
    and by cones are as tight as the points allow. A node of at most `leaf` points has no children.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> None:
        self.points, self.order, self.nodes = points, order, nodes
        self.centres, self.radii = points[nodes["centre"]], nodes["radius"]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.slice = list(zip(nodes["start"].tolist(), nodes["stop"].tolist(), strict=True))
        self.children: list[list[int]] = [[] for _ in nodes]
        for n, parent in enumerate(nodes["parent"].tolist()):
            if parent >= 0:
                self.children[parent].append(n)

    @classmethod
    def built(cls, points: np.ndarray, leaf: int = LEAF, base: float = 2.0) -> CoverTree:
        order, rows = np.arange(len(points)), []
        norms = np.sqrt((points**2).sum(axis=1))
        stack = []
        if len(points):
            far = np.sqrt(((points - points[0]) ** 2).sum(axis=1).max())
            stack = [(0, len(points), 0, -1, float(far))]  # slice, centre, parent, width
        while stack:
            a, b, centre, parent, width = stack.pop()
            mine = order[a:b]
            some = points[mine]
            radius = np.sqrt(((some - points[centre]) ** 2).sum(axis=1).max())
            rows.append((centre, a, b, parent, radius, norms[mine].max(), angles(some @ points[centre], norms[mine] * norms[centre]).max()))
            if b - a <= leaf or radius == 0:
                continue
            centres, owner = cover(some, int(np.flatnonzero(mine == centre)[0]), width / base)
            heads = mine[centres]
            order[a:b] = mine[np.argsort(owner, kind="stable")]
            ends = a + np.cumsum(np.bincount(owner, minlength=len(centres)))
            stack += [(int(s), int(e), int(h), len(rows) - 1, width / base) for s, e, h in zip([a, *ends[:-1]], ends, heads, strict=True)]
        return cls(points, order, np.array(rows, NODE))

    @classmethod
    def read(cls, points: np.ndarray, order: bytes, nodes: bytes) -> CoverTree:
        return cls(points, np.frombuffer(order, np.int64), np.frombuffer(nodes, NODE))


def angles(products: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Angles of pairs of vectors by their inner products and the products of their lengths; zero vectors have none (pi)."""
    return np.arccos(np.clip(np.divide(products, sizes, out=np.full(np.shape(products), -1.0), where=sizes > 0), -1, 1))


def cover(points: np.ndarray, first: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of centres and the centre of each point: the farthest point becomes the next centre, until all are within reach
    of one. Points that are all farther apart become a centre each."""
    dist, owner = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    centres, far = [], first
    while not centres or dist[far] > reach:
        d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        nearer = d < dist
        dist[nearer], owner[nearer] = d[nearer], len(centres)
        centres.append(far)
        far = int(dist.argmax())
    # one ball is the node again, a level narrower
    return np.array(centres), owner


class Best:
    """The k best (score, smallest id) of each query so far; `floor` is a score that the kth best of a query reaches elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.floor, self.scored = np.full(n, -np.inf) if floor is None else floor, 0
        self.score, self.id, self.row = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def worst(self, queries: np.ndarray) -> float:
        return float(np.maximum(self.score[queries, -1], self.floor[queries]).min())

    def add(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.score.shape[1]
        self.scored += scores.size
        some = (scores >= self.score[queries, -1:]).any(axis=0)
        if not some.any():
            return
        rows, ids, scores = rows[some], ids[some], scores[:, some]
        score = np.concatenate([self.score[queries], scores], axis=1)
        id_ = np.concatenate([self.id[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        row = np.concatenate([self.row[queries], np.broadcast_to(rows, scores.shape)], axis=1)
        order = np.lexsort((id_, -score), axis=1)[:, :k]
        self.score[queries], self.id[queries], self.row[queries] = (np.take_along_axis(x, order, axis=1) for x in (score, id_, row))


class Within:
    """Scores by double precision as bounds: each pair's whole-number score is within `slack` of its product, and cut to a long.

    First the k best lower bounds of each query are gathered; `held()` then asks for every pair whose upper bound reaches
    the worst of them. Where both bounds are one, at an end of a long, the score is known.
    """

    def __init__(self, queries: np.ndarray, data: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.queries, self.data, self.k, self.floor = queries, data, k, floor
        self.sizes = np.sqrt((queries**2).sum(axis=1)), np.sqrt((data**2).sum(axis=1))
        self.low, self.pairs, self.reached = Best(len(queries), k, floor), [[] for _ in queries], None

    def held(self) -> None:
        self.reached = np.maximum(self.low.score[:, -1], self.low.floor)

    def worst(self, queries: np.ndarray) -> float:
        return self.low.worst(queries) if self.reached is None else float(self.reached[queries].min())

    def add(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        slack = (self.data.shape[1] + 2) * 2.0**-52 * np.outer(self.sizes[0][queries], self.sizes[1][rows])
        low, high = np.clip(scores - slack, *ENDS), np.clip(scores + slack, *ENDS)
        if self.reached is None:
            self.low.add(queries, rows, ids, low)
            return
        for n, q in enumerate(queries.tolist()):
            known = low[n] == high[n]
            for at, end in enumerate(ENDS):  # the k smallest ids of those cut to an end are all that can be among the k best
                cut = np.flatnonzero(known & (low[n] == end) & (end >= self.reached[q]))
                few = cut[np.argsort(ids[cut], kind="stable")[: self.k]]
                self.pairs[q] += [(-((1 << 63) - 1) if at else 1 << 63, int(ids[i]), int(rows[i])) for i in few]
            for i in np.flatnonzero(~known & (high[n] >= self.reached[q])).tolist():
                product = sum(int(a) * int(b) for a, b in zip(self.queries[q].tolist(), self.data[rows[i]].tolist(), strict=True))
                self.pairs[q].append((-max(-(1 << 63), min((1 << 63) - 1, product)), int(ids[i]), int(rows[i])))
            self.pairs[q] = sorted(self.pairs[q])[: self.k]

    def best(self) -> Best:
        out = Best(len(self.queries), self.k)
        out.score = out.score.astype(object)
        for q, pairs in enumerate(self.pairs):
            for n, (less, id_, row) in enumerate(pairs):
                out.score[q, n], out.id[q, n], out.row[q, n] = -less, id_, row
        return out


def visit(queries: CoverTree, data: CoverTree, least_ids: np.ndarray, best: Best | Within) -> None:
    """Visit node pairs, best bound first; a pair goes once its bound is below the query group's worst kth score.

    For centres c, d and radii r, s every inner product of the pair is at most c.d + |c| s + |d| r + r s. It is also at most
    the largest lengths times the cosine of the angle that is left between the two cones. Bounds have a slack for what double
    precision and roots lose, relative to the lengths, so they hold for vectors of any size.
    """
    stack = [(0, np.array([0]))] if len(queries.points) and len(data.points) else []
    long, wide_ = data.nodes["longest"], data.nodes["angle"]
    while stack:
        q, front = stack.pop()
        c, r = queries.centres[q], queries.radii[q]
        size, angle = queries.nodes["longest"][q], queries.nodes["angle"][q]
        a, b = queries.slice[q]
        group = queries.order[a:b]

        def bounds(nodes: np.ndarray, c=c, r=r, q=q, size=size, angle=angle) -> np.ndarray:
            product = data.centres[nodes] @ c
            ball = product + queries.norms[q] * data.radii[nodes] + data.norms[nodes] * r + r * data.radii[nodes]
            left = angles(product, data.norms[nodes] * queries.norms[q]) - wide_[nodes] - angle - 1e-6
            cone = size * long[nodes] * np.maximum(np.cos(np.clip(left, 0, np.pi)), 0)
            return np.minimum(ball, cone) + 1e-9 * (queries.norms[q] + r) * (data.norms[nodes] + data.radii[nodes]) + 1e-6

        front = front[bounds(front) >= best.worst(group)]
        wide = [n for n in front.tolist() if data.children[n] and data.radii[n] >= r]
        if queries.children[q]:
            inner = {*wide}
            front = np.array([x for n in front.tolist() for x in (data.children[n] if n in inner else [n])], np.int64)
            stack += [(child, front) for child in queries.children[q]]
            continue
        nodes = front.tolist()
        while nodes:
            up = bounds(np.array(nodes))
            order = np.argsort(-up, kind="stable")
            worst = best.worst(group)
            nodes = [nodes[i] for i in order.tolist() if up[i] >= worst]
            first = max(8, len(nodes) // 4)
            some, nodes = nodes[:first], nodes[first:]
            nodes += [x for n in some for x in data.children[n]]
            ends = [data.slice[n] for n in some if not data.children[n]]
            every = np.concatenate([data.order[s:e] for s, e in ends]) if ends else np.empty(0, np.int64)
            for s in range(0, len(every), SCORED):
                rows = every[s : s + SCORED]
                best.add(group, rows, least_ids[rows], queries.points[group] @ data.points[rows].T)


def dual_search(queries: CoverTree, data: CoverTree, least_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best of each query, where products are whole numbers below 2**53, so exact in double precision."""
    best = Best(len(queries.points), k, floor)
    visit(queries, data, least_ids, best)
    return best


def exact_search(queries: CoverTree, data: CoverTree, least_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best of each query for whole numbers of any size, scores beyond a long cut to it.

    Both trees are visited twice: for the k best lower bounds of each query, and for all pairs that may reach these. Only
    such pairs are summed as whole numbers.
    """
    best = Within(queries.points, data.points, k, floor)
    visit(queries, data, least_ids, best)
    best.held()
    visit(queries, data, least_ids, best)
    return best.best()


def whole(rows: DataFrame) -> DataFrame:
    """Each component x as floor(256 x), kept as a double (a whole number)."""
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, size: int = SHARD_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k largest integer products.

    Candidates are all rows but the query's own; ties go to the smaller vec_id; fewer than k candidates give as many
    rows. Exact: node pairs are left out only where their bound is below the kth score, or below the kth score that the
    query has in shard 0, which is searched first. Trees are built once for each shard and block, and written. Equal
    vectors are one point with their k + 1 smallest ids. Null vectors and those with null or non-finite components take no
    part, zero vectors do; vectors meet those of their length only. Products that double precision does not hold are
    searched by bounds and summed as whole numbers, and cut to a long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole(valid(vectors, allow_zero=True))
    classes = sharded(written(distinct(rows, k + 1), "vectors"), size)

    def build(table: pa.Table) -> pa.Table:
        v = np.array(table["v"].to_pylist(), np.float64)
        ids, cuts = flat_ids(table["ids"].to_pylist())
        tree = CoverTree.built(v, base=BASE)
        return pa.table(
            {
                "dim": pa.array([v.shape[1]], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()), "vectors": [v.tobytes()],
                "ids": [ids.tobytes()], "cuts": [cuts.tobytes()], "order": [tree.order.tobytes()], "nodes": [tree.nodes.tobytes()],
            }
        )

    def plant(cols: dict) -> dict:
        trees = [CoverTree.built(np.frombuffer(q, np.float64).reshape(-1, dim), base=BASE) for q, dim in zip(cols["qs"], cols["dim"], strict=True)]
        return cols | {"q_order": [t.order.tobytes() for t in trees], "q_nodes": [t.nodes.tobytes() for t in trees]}

    packed = written(classes.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, n int, vectors binary, ids binary, cuts binary, order binary, nodes binary"), "shards")
    asked = "dim int, block int, qids binary, qs binary, q_order binary, q_nodes binary"
    blocks = written(map_rows(query_blocks(rows, every), lambda: plant, asked), "queries")

    def found(row: dict) -> Best:
        v, q = (np.frombuffer(row[x], np.float64).reshape(-1, row["dim"]) for x in ("vectors", "qs"))
        least = np.frombuffer(row["ids"], np.int64)[np.frombuffer(row["cuts"], np.int64)[:-1]]
        longest = np.abs(v).max(initial=0.0) * np.abs(q).max(initial=0.0) * row["dim"]
        floor = np.frombuffer(row["floor"], np.float64) if row.get("floor") else None
        search = dual_search if longest < EXACT else exact_search
        return search(CoverTree.read(q, row["q_order"], row["q_nodes"]), CoverTree.read(v, row["order"], row["nodes"]), least, k + 1, floor)

    def floors(cols: dict) -> dict:
        each = [dict(zip(cols, values, strict=True)) for values in zip(*cols.values(), strict=True)]
        # whole numbers beyond double precision may have been rounded up
        worst = [np.nextafter(np.array(found(row).score[:, -1], np.float64), -np.inf).tobytes() for row in each]
        return {"dim": cols["dim"], "block": cols["block"], "floor": worst}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, cuts, qids = (np.frombuffer(row[x], np.int64) for x in ("ids", "cuts", "qids"))
                best = found(row)
                out: tuple[list, list, list] = ([], [], [])
                for q, scores, rows_ in zip(qids.tolist(), best.score, best.row, strict=True):
                    some = [(s, i) for s, f in zip(scores.tolist(), rows_.tolist(), strict=True) if f >= 0 for i in ids[cuts[f] : cuts[f + 1]].tolist() if i != q]
                    for s, i in sorted(some, key=lambda x: (-x[0], x[1]))[:k]:
                        for column, value in zip(out, (q, i, int(s)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    first = written(map_rows(paired(blocks, packed.where("shard = 0")), lambda: floors, "dim int, block int, floor binary"), "floors")
    return best_of(paired(blocks.join(first, ["dim", "block"], "left"), packed).mapInArrow(run, RESULT), k)
