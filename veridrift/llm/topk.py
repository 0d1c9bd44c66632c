"""Exact top-k inner products by dual-tree search of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import again, discard, slices, written

SCALE = 1024
#: Rows of a block of data, of a group of queries, and groups that come to a block at a time.
BLOCK_ROWS, GROUP_ROWS, SLOT_GROUPS = 1024, 256, 1024
#: Nodes of the upper level at most, and the sample that it is shaped by; both are broadcast or sent to the driver (2 MB of 64 dimensions).
CELLS, SAMPLE = 1024, 4096
#: How much smaller children are than their node, points of a node that is not divided, and rows scored at a time.
BASE, LEAF, SCORED = 1.3, 4, 256


def net(points: np.ndarray, first: int, near: float, most: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres more than ``near`` apart that cover all points within it, farthest first; each point's centre and distance. None beyond ``most``."""
    centers, owner = [first], np.zeros(len(points), np.int64)
    apart = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    while apart[far := int(apart.argmax())] > near:
        if len(centers) == most:
            return None
        to = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = to < apart
        owner[closer], apart[closer] = len(centers), to[closer]
        centers.append(far)
    return centers, owner, apart


def upper_level(points: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest level of the sample's cover tree that has ``most`` nodes or fewer."""
    if not len(points):
        return np.zeros((1, 1))
    first = _middle(points)
    found, near = [first], float(np.sqrt(((points - points[first]) ** 2).sum(axis=1)).max())
    while near > 1e-9:
        near /= BASE
        level = net(points, first, near, most)
        if level is None:
            break
        found = level[0]
        if len(found) == len(np.unique(points, axis=0)):
            break
    return points[found]


def _middle(points: np.ndarray) -> int:
    return int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())


class CoverTree:
    """Nodes centred at points; children are more than their parent's radius by ``BASE`` apart and cover its points within that."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.at: list[int] = []
        self.radii: list[float] = []
        self.children: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []  # the node's points in ``order``
        self.order: list[int] = []
        self._add(np.arange(len(points)), _middle(points))
        self.order = np.array(self.order)
        self.centers, self.radii = points[self.at], np.array(self.radii)
        self.sizes = np.sqrt((self.centers**2).sum(axis=1))
        self.leaf = np.array([not len(c) for c in self.children])
        self.begin, self.held = np.array([a for a, _ in self.span]), np.array([b - a for a, b in self.span])

    def _add(self, rows: np.ndarray, center: int) -> int:
        own, node, begin = self.points[rows], len(self.at), len(self.order)
        radius = float(np.sqrt(((own - self.points[center]) ** 2).sum(axis=1)).max())
        self.at.append(center), self.radii.append(radius), self.children.append(np.empty(0, np.int64)), self.span.append((0, 0))
        if len(rows) <= LEAF or radius == 0:
            self.order += rows.tolist()
        else:
            centers, owner, _ = net(own, int(np.flatnonzero(rows == center)[0]), radius / BASE)
            self.children[node] = np.array([self._add(rows[owner == i], int(rows[c])) for i, c in enumerate(centers)])
        self.span[node] = begin, len(self.order)
        return node

    def rows(self, node: int) -> np.ndarray:
        return self.order[slice(*self.span[node])]

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        """The points of several nodes, one node after another."""
        n = self.held[nodes]
        shift = np.repeat(self.begin[nodes] - (np.cumsum(n) - n), n)
        return self.order[shift + np.arange(len(shift))]


class Best:
    """The k best (score, id) of each query so far, worst last."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.k, self.found, self.bound = k, [[] for _ in range(queries)], bound

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            good = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[good], ids[good]
        kept = self.found[query]
        kept += zip((-scores).tolist(), ids.tolist())
        kept.sort()
        del kept[self.k :]
        if len(kept) == self.k:
            self.bound[query] = max(self.bound[query], -kept[-1][0])


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, bound: np.ndarray, pruned: list[int] | None = None, tree: CoverTree | None = None, names: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """For each query (-score, name) of its k best rows of ``data`` that reach ``bound``, the row of its own id left out.

    ``names`` of the data's rows need not be unique and decide ties (the ids, if there are none).

    A node of the queries is taken down with all nodes of the data that it may still need; the larger ones are divided first. A pair of
    nodes is pruned (and counted in ``pruned``: pairs pruned, pairs scored) if their covering radii allow no score
    as high as the worst kth score below the query node. ``tree`` is that of the data, if there is one already.
    """
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    q, d = queries.astype(np.float64), data.astype(np.float64)
    # whole numbers: sums below 2**53 are exact as floats, below 2**63 as longs, else as Python's
    exact_q, exact_d = (q, d) if most < 2.0**53 else (queries, data) if most < 2.0**62 else (queries.astype(object), data.astype(object))
    best = Best(len(queries), k, bound.astype(np.float64))
    counted = pruned if pruned is not None else [0, 0]
    names = data_ids if names is None else names

    def allowed(a: int, bs: np.ndarray) -> np.ndarray:
        top = y.centers[bs] @ x.centers[a] + y.sizes[bs] * x.radii[a] + x.sizes[a] * y.radii[bs] + x.radii[a] * y.radii[bs]
        return top + np.abs(top) * 1e-9 + 1e-6

    def visit(a: int, bs: np.ndarray) -> None:
        rows = x.rows(a)
        while True:
            top = allowed(a, bs)
            alive = top >= best.bound[rows].min()
            counted[0] += int((~alive).sum())
            bs, top = bs[alive], top[alive]
            wide = ~y.leaf[bs]
            if not wide.any() or (not x.leaf[a] and y.radii[bs[wide]].max() < x.radii[a]):
                break
            bs = np.concatenate([bs[~wide], *(y.children[b] for b in bs[wide])])
        if not x.leaf[a]:
            for child in x.children[a]:
                visit(child, bs)
            return
        order = np.argsort(-top, kind="stable")
        bs, top = bs[order], top[order]
        held = np.cumsum(y.held[bs])
        at = 0
        while at < len(bs):
            end = max(at + 1, int(np.searchsorted(held, held[at] + SCORED)))
            if top[at] < best.bound[rows].min():
                counted[0] += len(bs) - at
                return
            counted[1] += end - at
            other = y.rows_of(bs[at:end])
            scores, own = exact_q[rows] @ exact_d[other].T, names[other]
            reached = (scores >= best.bound[rows][:, None]) & (data_ids[other] != query_ids[rows][:, None])
            for i in np.flatnonzero(reached.any(axis=1)):
                good = scores[i][reached[i]]
                best.offer(rows[i], good if good.dtype == object else good.astype(np.int64), own[reached[i]])
            at = end

    if len(queries) and len(data):
        x, y = CoverTree(q), tree or CoverTree(d)
        visit(0, np.zeros(1, np.int64))
    return best.found


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` with whole components; rows with a null id, a null vector or a component that is null or not finite are left out."""
    x = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, _whole).alias("x"))


def _whole(c):
    """floor(1024 * c); where that is no long the query fails."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for a score")).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = [r.values.to_numpy() for r in column]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), max(width, 1)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


_MATCH = "query_row long, vec_id long, score long"


def _matches(found: list, query_rows: np.ndarray) -> pa.Table:
    rows = [(q, i, -s) for q, own in zip(query_rows.tolist(), found) for s, i in own]
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (a condition on ``vec_id``) picks the k rows of highest inner product of components floor(1024 * x).

    The upper level of a cover tree (of a bounded sample) has cells, in which queries and data are placed together; cells are cut
    into blocks of bounded size by row hash, however full. Each query first searches its own block,
    which gives its kth score so far. Then groups of a cell's queries are tested against the cells' covering radii;
    what a cell may hold is searched in its blocks: a cover tree of the group and one of the block are
    descended together, and node pairs are pruned against the worst kth score of the queries below. Vectors without
    clusters leave little to prune: then every group meets every block, which is quadratic work.

    Ties go to the smaller id. A query's own row is never among its results. Rows are told apart, whatever their ids: of
    rows that share a query's id each asks on its own and may find the others, so such an id has k results for
    each of its rows, in which a rank comes once for each. A vector shorter than
    another counts as filled up with zeros; empty vectors score 0. Vectors null or holding null
    or non-finite components take no part, nor do rows without an id. Components from 2**52 on and scores that are no longs
    fail the query. An empty table gives no rows; other columns are not read.
    """
    rows = written(_vectors(vectors, id_col, vector_col))
    spark, n = rows.sparkSession, rows.count()
    sample = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(SAMPLE)).alias("bucket")).agg(F.min(F.struct("vec_id", "x")).alias("least")).select("least.x")
    shaped = _matrix(sample.toArrow()["x"].combine_chunks())
    centers = spark.sparkContext.broadcast(upper_level(shaped.astype(np.float64), max(1, min(CELLS, n // BLOCK_ROWS))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x, c = _alike(_matrix(batch.column("x")).astype(np.float64), centers.value)
            cell = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            apart = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
            yield pa.record_batch([*(batch.column(c) for c in ("vec_id", "row", "x")), pa.array(cell.astype(np.int32)), pa.array(apart)], names=["vec_id", "row", "x", "cell", "apart"])

    numbered = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "x")
    placed = written(numbered.mapInArrow(place, "vec_id long, row long, x array<long>, cell int, apart double"))
    full = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked"), F.max("apart").alias("radius")).collect()  # CELLS rows at most
    cells = [(r.cell, max(1, -(-r.n // BLOCK_ROWS)), max(1, -(-r.asked // GROUP_ROWS))) for r in full]
    sizes = F.broadcast(spark.createDataFrame(cells, "cell int, parts int, groups int"))
    hashed = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(count)).cast("int")
    data = written(placed.join(sizes, "cell").select("vec_id", "row", "x", "cell", hashed("parts", 1).alias("part"), hashed("groups", 2).alias("grp")))
    discard(rows, placed)
    queries = again(data).where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("x").alias("q"), "cell", "part", "grp")

    def in_own_block(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return _matches([], np.empty(0))
        q, d = _alike(_matrix(asked["q"].combine_chunks()), _matrix(block["x"].combine_chunks()))
        ids = asked["query_row"].to_numpy()
        return _matches(search(q, ids, d, block["row"].to_numpy(), k, np.full(len(q), -np.inf), names=block["vec_id"].to_numpy()), ids)

    data_rows, data = data, data.drop("grp")
    own = written(queries.drop("query_id").groupBy("cell", "part").cogroup(data.groupBy("cell", "part")).applyInArrow(in_own_block, _MATCH))
    kth = own.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))

    def packed(group: pa.Table) -> pa.Table:
        q = _matrix(group["q"].combine_chunks())
        bound = group["kth"].to_numpy()
        bound = np.where(np.isnan(bound), -np.inf, bound)
        middle = q[_middle(q.astype(np.float64))].astype(np.float64)
        radius = float(np.sqrt(((q - middle) ** 2).sum(axis=1)).max())
        small = np.min_scalar_type(-int(np.abs(q).max(initial=1)) - 1)
        row = {"from_cell": group["cell"][0].as_py(), "grp": group["grp"][0].as_py(), "ids": group["query_row"].to_pylist(), "kth": bound.tolist(), "own_part": group["part"].to_pylist()}
        return pa.Table.from_pylist([row | {"width": q.shape[1], "kind": small.str, "q": q.astype(small).tobytes(), "middle": middle.tolist(), "radius": radius, "worst": float(bound.min())}], _GROUP)

    groups = written(queries.drop("query_id").join(kth, "query_row", "left").groupBy("cell", "grp").applyInArrow(packed, _GROUP_SQL))
    slots = max(1, -(-sum(c[2] for c in cells) // SLOT_GROUPS))
    extents = spark.sparkContext.broadcast((np.array([r.cell for r in full], np.int64), np.array([r.radius for r in full], float), [c[1] for c in cells]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, radii, parts = extents.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, c = _alike(np.array([row["middle"]]), centers.value[which])
                a, r = a[0], row["radius"]
                top = c @ a + np.sqrt((c * c).sum(axis=1)) * r + np.sqrt(a @ a) * radii + r * radii
                for i in np.flatnonzero(top + np.abs(top) * 1e-9 + 1e-6 >= row["worst"]):
                    out += [(row["from_cell"], row["grp"], int(which[i]), part) for part in range(parts[i])]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int32()) for c in columns], names=["from_cell", "grp", "cell", "part"])

    pairs = groups.select("from_cell", "grp", "middle", "radius", "worst").mapInArrow(meet, "from_cell int, grp int, cell int, part int")
    slot = F.pmod(F.xxhash64("from_cell", "grp"), F.lit(slots)).cast("int").alias("slot")
    met = again(groups).select("from_cell", "grp", "ids", "kth", "own_part", "width", "kind", "q").join(pairs, ["from_cell", "grp"]).select("*", slot)

    def in_block(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return _matches([], np.empty(0))
        out = []
        d, own_rows, names = _matrix(block["x"].combine_chunks()), block["row"].to_numpy(), block["vec_id"].to_numpy()
        trees: dict[int, CoverTree] = {}  # by the width that vectors are filled up to
        for row in range(asked.num_rows):
            r = {c: asked[c][row].as_py() for c in ("ids", "kth", "own_part", "width", "kind", "q", "from_cell", "cell", "part")}
            q, own_d = _alike(np.frombuffer(r["q"], r["kind"]).reshape(-1, r["width"]).astype(np.int64), d)
            ids, bound = np.array(r["ids"]), np.array(r["kth"])
            new = (np.array(r["own_part"]) != r["part"]) | (r["from_cell"] != r["cell"])  # the own block has been searched
            if new.any():
                width = own_d.shape[1]
                tree = trees[width] = trees.get(width) or CoverTree(own_d.astype(np.float64))
                out.append(_matches(search(q[new], ids[new], own_d, own_rows, k, bound[new], tree=tree, names=names), ids[new]))
        if not out:
            return _matches([], np.empty(0))
        return pa.concat_tables(out)

    in_slots = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    others = met.groupBy("cell", "part", "slot").cogroup(in_slots.groupBy("cell", "part", "slot")).applyInArrow(in_block, _MATCH)
    ranked = own.union(others).withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    asked = again(data_rows).where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return ranked.join(asked, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_GROUP_SQL = "from_cell int, grp int, ids array<long>, kth array<double>, own_part array<int>, width int, kind string, q binary, middle array<double>, radius double, worst double"
_GROUP = pa.schema(
    [("from_cell", pa.int32()), ("grp", pa.int32()), ("ids", pa.list_(pa.int64())), ("kth", pa.list_(pa.float64())), ("own_part", pa.list_(pa.int32())), ("width", pa.int32())]
    + [("kind", pa.string()), ("q", pa.binary()), ("middle", pa.list_(pa.float64())), ("radius", pa.float64()), ("worst", pa.float64())]
)
