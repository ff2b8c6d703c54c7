"""Exact top-k by inner product: dual-tree search over cover trees.

Every row belongs to the cell of its nearest centre (a bounded sample of rows).
Queries of neighbouring cells form blocks.  A first round searches the cells of
a block's own queries; each query's k-th score there is a floor, and a second
round shuffles only those cells to a block whose centre and radius could still
beat the floor of one of its queries.  A task builds a cover tree over its
candidates and one over its queries and walks both together: a pair of nodes is
dropped when even its best possible product, from the centres' product and both
covering radii, is below the worst k-th score of the queries in the query node,
so nothing that could count is lost."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import stored

SCALE = 1024
#: Candidates and queries of a block, candidates and queries of a leaf.
BLOCK, QUERY_BLOCK, LEAF, QUERY_LEAF = 8192, 512, 64, 16
#: Cells at most; below, twice the square root of the rows.  Rows that are compared with the centres at once.
CELLS, STEP = 1024, 4096
NONE = np.iinfo(np.int64).min
RESULT = "query_id long, vec_id long, score long"


@dataclass
class Node:
    """rows are [low, high) of the tree's order; every row is within radius of the centre."""

    center: np.ndarray
    low: int
    high: int
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Greedy nets of halving radius; each row stands below the first center that covers it."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf, self.order = x, leaf, np.arange(len(x))
        self.root = self._build(np.arange(len(x)), 0, None) if len(x) else None

    def _build(self, rows: np.ndarray, low: int, cover: float | None) -> Node:
        center = self.x[rows].mean(axis=0) if cover is None else self.x[rows[0]]
        distance = np.sqrt(np.maximum(((self.x[rows] - center) ** 2).sum(axis=1), 0))
        radius = float(distance.max()) * (1 + 1e-9) + 1e-6
        self.order[low : low + len(rows)] = rows
        node = Node(center, low, low + len(rows), radius, float(np.sqrt((center**2).sum())) * (1 + 1e-9))
        if len(rows) <= self.leaf or radius <= 1e-5:
            return node
        cover = radius / 2 if cover is None else min(cover / 2, radius / 2)
        left, at, loose, missed = rows[np.argsort(distance, kind="stable")[::-1]], low, [], 0
        while len(left):
            if len(loose) + len(left) <= self.leaf or missed == self.leaf:  # no net in sight: the rest shares leaves
                loose = [*loose, *left.tolist()]
                break
            near = ((self.x[left] - self.x[left[0]]) ** 2).sum(axis=1) <= cover**2
            near[0] = True
            if near.sum() * 8 < self.leaf:  # a net of near-single rows prunes nothing: such rows share leaves
                loose += left[near].tolist()
                missed += 1
            else:
                missed = 0
                node.children.append(self._build(left[near], at, cover))
                at = node.children[-1].high
            left = left[~near]
            while len(loose) >= self.leaf:
                node.children.append(self._flat(np.array(loose[: self.leaf]), at))
                at, loose = node.children[-1].high, loose[self.leaf :]
        while loose:
            node.children.append(self._flat(np.array(loose[: self.leaf]), at))
            at, loose = node.children[-1].high, loose[self.leaf :]
        return node

    def _flat(self, rows: np.ndarray, low: int) -> Node:
        center = self.x[rows].mean(axis=0)
        radius = float(np.sqrt(((self.x[rows] - center) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        self.order[low : low + len(rows)] = rows
        return Node(center, low, low + len(rows), radius, float(np.sqrt((center**2).sum())) * (1 + 1e-9))


class DualSearch:
    """Best k candidates of each query, ties to the smaller id; a query's own id
    takes no part.  What is below a query's floor needn't be found.  whole:
    products of 2**53 and more, taken in integers."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, leaf: int = QUERY_LEAF, floor: np.ndarray | None = None, whole: bool = False):
        self.tree, self.k, self.whole, self.products = CoverTree(queries, leaf), k, whole, 0
        self.q, self.ids = queries[self.tree.order], query_ids[self.tree.order]
        n = len(queries)
        self.floor = np.full(n, NONE) if floor is None else floor[self.tree.order]
        self.score = np.full((n, k), NONE)
        self.found = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, a: Node) -> np.ndarray:
        return np.maximum(self.score[a.low : a.high, -1], self.floor[a.low : a.high])

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        tree = CoverTree(x)
        if tree.root is None or self.tree.root is None:
            return
        x, ids = x[tree.order], ids[tree.order]
        stack = [(self.tree.root, tree.root, np.inf)]
        while stack:
            a, b, bound = stack.pop()
            if bound < float(self.worst(a).min()):
                continue
            if not a.children and not b.children:
                self._leaf(a, b, x, ids)
                continue
            pairs = []
            for c in a.children if a.children and (not b.children or a.radius >= b.radius) else [a]:
                for d in b.children if c is a else [b]:
                    best = float(c.center @ d.center) + c.norm * d.radius + d.norm * c.radius + c.radius * d.radius
                    pairs.append((c, d, best + (abs(best) + c.norm * d.norm) * 1e-9 + 1e-6))
            stack += sorted(pairs, key=lambda p: p[2])  # the most promising comes off first

    def _leaf(self, a: Node, b: Node, x: np.ndarray, ids: np.ndarray) -> None:
        mine, theirs = slice(a.low, a.high), slice(b.low, b.high)
        self.products += (a.high - a.low) * (b.high - b.low)
        if self.whole:
            s = self.q[mine].astype(np.int64) @ x[theirs].astype(np.int64).T
        else:
            s = (self.q[mine] @ x[theirs].T).astype(np.int64)
        s[self.ids[mine][:, None] == ids[theirs][None, :]] = NONE
        better = np.flatnonzero(((s >= self.worst(a)[:, None]) & (s > NONE)).any(axis=1))
        if not len(better):
            return
        rows = a.low + better
        scores = np.hstack([self.score[rows], s[better]])
        found = np.hstack([self.found[rows], np.where(s[better] == NONE, np.iinfo(np.int64).max, np.broadcast_to(ids[theirs], s[better].shape))])
        order = np.lexsort((found, ~scores), axis=1)[:, : self.k]  # ~ turns the order without overflow
        self.score[rows], self.found[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)

    def results(self) -> Iterator[tuple[int, int, int]]:
        for q, s, f in zip(self.ids.tolist(), self.score.tolist(), self.found.tolist(), strict=True):
            for v, i in zip(s, f, strict=True):
                if v != NONE:
                    yield q, i, v


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column.to_pylist()):
        out[k, : len(v)] = v
    return out


def _cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, h, v, cell (nearest centre), far (distance from it)."""
    shared, norms = vectors.sparkSession.sparkContext.broadcast(centres), (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                x = _matrix(part.column(2), centres.shape[1])
                cell = (norms - 2 * (x @ shared.value.T)).argmin(axis=1)
                far = np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "h", "v", "cell", "far"])

    return vectors.select("id", "h", "v").mapInArrow(run, "id long, h long, v array<double>, cell int, far double")


def query_groups(centres: np.ndarray, asked: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell: neighbours, halved along the widest axis while they have over `most` queries."""
    group, todo, n = np.zeros(len(centres), np.int64), [np.arange(len(centres))], 0
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and asked[cells].sum() > most:
            axis = np.ptp(centres[cells], axis=0).argmax()
            cells = cells[np.argsort(centres[cells, axis], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(asked[cells]), asked[cells].sum() / 2) + 1, 1, len(cells) - 1))
            todo += [cells[:half], cells[half:]]
            continue
        group[cells] = n
        n += 1
    return group


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner
    products of floor(scale * x) for each query (id divisible by `every`) among
    all rows with another id, ties to the smaller id; all, if there are fewer.

    Rows with a null id, with null vectors or with null or non-finite
    components take no part.  A shorter vector counts as padded with zeros;
    empty vectors score 0.  Rows that repeat an id are candidates of their own,
    and give that query once (the one of least hash).  Scores that could pass
    2**63 raise an error.  An empty table gives no rows.  Other columns are not
    looked at."""
    spark, v = vectors.sparkSession, F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    given = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    given = given.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")).withColumn("h", F.xxhash64("id", "v"))
    n, n_queries, width, most = given.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    width, most = width or 0, most or 0.0
    if most >= 2.0**63:
        raise ValueError("scores do not fit a long")
    exact = most >= 2.0**53
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = np.zeros((0, width))
    for r in given.orderBy("h", "id").limit(min(cells, 2 * int(n**0.5) + 1)).collect():  # at most `cells` rows
        centres = np.vstack([centres, np.pad(np.array(r.v, float), (0, width - len(r.v)))])
    whole = stored(_cells(given, centres), "vectors")
    size, asked, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in whole.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q"), F.max("far").alias("far")).collect():  # a row for each cell
        size[r.cell], asked[r.cell], radius[r.cell] = r.n, r.q, r.far
    parts_of = np.maximum(1, -(-size // block))  # a cell of very many rows is cut by hash
    group = query_groups(centres, asked, query_block)
    shares = np.array([max(1, -(-int(asked[group == g].sum()) // query_block)) for g in range(group.max() + 1)])
    first_of = np.cumsum(shares) - shares  # of each group's query blocks
    cell_parts = F.element_at(F.array(*[F.lit(int(p)) for p in parts_of]), F.col("cell") + 1)
    candidates = whole.select("id", "v", "cell", F.pmod("h", cell_parts).cast("int").alias("part"))
    groups = spark.createDataFrame([(c, int(first_of[g]), int(shares[g])) for c, g in enumerate(group)], "cell int, first int, shares int")
    queries = whole.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("h", "v", "cell")).alias("m")).select("id", "m.v", "m.cell").join(F.broadcast(groups), "cell")
    queries = stored(queries.select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))).cast("int").alias("q")), "queries")

    def near(g: int) -> list[int]:
        """A group's own cells, and the nearest others until they hold more than k rows."""
        own = np.flatnonzero(group == g)
        if size[own].sum() <= k:
            center = centres[own].mean(axis=0)
            order = [c for c in np.argsort(((centres - center) ** 2).sum(axis=1), kind="stable").tolist() if group[c] != g]
            more = np.searchsorted(np.cumsum(size[own].sum() + size[order]), k, side="right") + 1
            own = np.concatenate((own, order[:more])).astype(np.int64)
        return own.tolist()

    def chunked(wanted: list[tuple[int, int]]) -> list[int]:
        """Numbers of chunks, each of `block` rows or one cell's part."""
        out, chunk, held = [], 0, 0
        for c, _ in wanted:
            rows = min(int(size[c]), block)
            if held and held + rows > block:
                chunk, held = chunk + 1, 0
            held += rows
            out.append(chunk)
        return out

    met = {g: near(g) for g in range(len(shares))}
    plan = []
    for g, own in met.items():
        for (c, p), chunk in zip([(c, 0) for c in own], chunked([(c, 0) for c in own]), strict=True):
            plan += [(c, p, int(first_of[g]) + s, chunk) for s in range(shares[g])]
    schema = "cell int, part int, q int, chunk int"
    found = stored(_search(spark.createDataFrame(plan, schema), candidates, queries.withColumn("floor", F.lit(NONE)), k, width, exact), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "floor")
    queries = stored(queries.join(floors, "id", "left").select("id", "v", "q", F.coalesce("floor", F.lit(NONE)).alias("floor")), "floors")
    group_of = np.repeat(np.arange(len(shares)), shares)
    shared = spark.sparkContext.broadcast((centres, radius))

    def wanted(key: tuple, table: pa.Table) -> pa.Table:
        """The parts of cells that could still matter to a block of queries."""
        (q,) = (x.as_py() for x in key)
        at, far = shared.value
        x, floor = _matrix(table.column("v"), width), table.column("floor").to_numpy().astype(np.float64)
        norm = np.sqrt((x**2).sum(axis=1))
        bound = x @ at.T + norm[:, None] * far
        slack = (np.abs(bound) + norm[:, None] * np.sqrt((at**2).sum(axis=1))) * 1e-9 + 1e-6
        keep = np.flatnonzero((bound + slack >= floor[:, None]).any(axis=0) & (size > 0))
        seen = set(met[int(group_of[q])])
        pairs = [(c, p) for c in keep.tolist() for p in range(int(c in seen), int(parts_of[c]))]
        cols = [[c for c, _ in pairs], [p for _, p in pairs], [q] * len(pairs), chunked(pairs)]
        return pa.table([pa.array(x, pa.int32()) for x in cols], names=["cell", "part", "q", "chunk"])

    rest = stored(queries.groupBy("q").applyInArrow(wanted, schema), "search-plan")
    local = found.unionByName(_search(rest, candidates, queries, k, width, exact))
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(plan: DataFrame, candidates: DataFrame, queries: DataFrame, k: int, width: int, exact: bool) -> DataFrame:
    """The best of each query among the cells that plan (cell, part, q, chunk) sends to its block."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            found = DualSearch(_matrix(left.column("v"), width), left.column("id").to_numpy(), k, floor=left.column("floor").to_numpy(), whole=exact)
            found.add(_matrix(right.column("v"), width), right.column("id").to_numpy())
            rows = list(found.results())
        cols = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    block = [F.col(c).alias(c) for c in ("q", "chunk")]  # columns of their own on either side
    each_q = queries.join(plan.select("q", "chunk").distinct(), "q").select(*block, "id", "v", "floor")
    each_c = candidates.join(plan, ["cell", "part"]).select(*block, "id", "v")
    return each_q.groupBy("q", "chunk").cogroup(each_c.groupBy("q", "chunk")).applyInArrow(search, RESULT)
