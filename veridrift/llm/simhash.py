"""SimHash near-duplicates: exact fingerprint pairs from sharded vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, ids_and_text, slices, texts, written
from .components import connected_components
from .words import MIX, hashed_windows, hashed_words

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints for each shard, and the sample that the trees are shaped by.
SHARD_SIZE, LINK_SHARD, SAMPLE = 4096, 512, 16_384
#: Blocks of a fingerprint's bits, each with a tree.
BLOCKS = 8
#: Members of a leaf beyond which it is dealt, and the members that all its parts share.
LEAF_MOST, PIVOTS = 4 * SHARD_SIZE, 8
_CHUNK = 65_536
#: Distances that a task computes at a time, and the members at least that it does so for.
_COMPARED, _ROWS = 1 << 20, 64


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; 0 if it has no words."""
    words = text.encode().lower().split()  # of bytes: lowers A-Z and cuts at the six blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for each row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, size) for t in texts(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


@dataclass
class VantageTree:
    """A complete vantage-point tree over one block of the bits; node i has the children 2i+1 (inside) and 2i+2."""

    mask: np.uint64
    reach: int  # a pair within the radius differs in some block by this much at most
    depth: int
    points: np.ndarray
    radii: np.ndarray

    @classmethod
    def shaped(cls, sample: np.ndarray, mask: int, reach: int, depth: int) -> VantageTree:
        nodes = (1 << depth) - 1
        tree = cls(np.uint64(mask), reach, depth, np.zeros(nodes, np.uint64), np.zeros(nodes, np.int64))
        members = {0: sample}
        for i in range(nodes):
            own = members.pop(i, sample[:0])
            if len(own):
                tree.points[i], tree.radii[i] = tree._cut(own)
            inside = tree.distance(own, i) <= tree.radii[i]
            members[2 * i + 1], members[2 * i + 2] = own[inside], own[~inside]
        return tree

    def _cut(self, own: np.ndarray) -> tuple[np.uint64, int]:
        """Of a few points and near-median radii: the even cut with the fewest members at its border."""
        best, r = None, np.arange(64)
        for point in own[:: max(1, len(own) // 8)][:8]:
            below = np.concatenate([[0], np.cumsum(np.bincount(np.bitwise_count((own ^ point) & self.mask), minlength=66))])
            border = below[np.minimum(r + self.reach + 1, 66)] - below[np.maximum(r - self.reach + 1, 0)] if self.reach else 0
            cost = np.maximum(below[r + 1], len(own) - below[r + 1]) + border
            at = int(np.argmin(cost))
            if best is None or cost[at] < best[0]:
                best = cost[at], point, at
        return best[1], best[2]

    def distance(self, fps: np.ndarray, node) -> np.ndarray:
        return np.bitwise_count((fps ^ self.points[node]) & self.mask).astype(np.int64)

    def leaf(self, fps: np.ndarray) -> np.ndarray:
        """The leaf that each fingerprint is stored in."""
        node = np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            node = 2 * node + np.where(self.distance(fps, node) <= self.radii[node], 1, 2)
        return node

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the fingerprint, leaf, and whether the leaf is its own, for each leaf that its ball of ``reach`` meets."""
        who, node, own = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        if not self.reach:  # equal blocks go the same way
            return who, self.leaf(fps), own
        for _ in range(self.depth):
            d, r = self.distance(fps[who], node), self.radii[node]
            into, out = d - self.reach <= r, d + self.reach > r
            who = np.concatenate([who[into], who[out]])
            own = np.concatenate([own[into] & (d[into] <= r[into]), own[out] & (d[out] > r[out])])
            node = np.concatenate([2 * node[into] + 1, 2 * node[out] + 2])
        return who, node, own


def _forest(sample: np.ndarray, count: int, radius: int, shard_size: int | None = None, blocks: int = BLOCKS) -> list[VantageTree]:
    """A tree for each block of the bits: some block of a pair within ``radius`` differs by its share of it at most.

    With more blocks than ``radius`` one is equal, so a fingerprint visits its own leaf only, however deep the trees are.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, count / (shard_size or SHARD_SIZE))))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) // 4)))))
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    return [VantageTree.shaped(sample, (1 << b) - (1 << a), radius // blocks, depth) for a, b in zip(bounds, bounds[1:])]


def spanning_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, members: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, by rounds in which each tree takes its lightest way out."""
    label, chosen = np.arange(members), np.zeros(len(u), bool)
    order = np.argsort(weight, kind="stable")
    while True:
        a, b = label[u[order]], label[v[order]]
        out = a != b
        order, a, b = order[out], a[out], b[out]
        if not len(order):
            return np.flatnonzero(chosen)
        # the first way out of each tree; in one order for all, so that no rings close but pairs that choose each other
        trees, first = np.unique(np.stack([a, b], axis=1).ravel(), return_index=True)
        way = first // 2
        chosen[order[way]] = True
        parent = np.arange(members)
        parent[trees] = np.where(first % 2 == 0, b[way], a[way])
        mutual = (parent[parent] == np.arange(members)) & (parent > np.arange(members))
        parent[mutual] = np.flatnonzero(mutual)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


@dataclass
class Near:
    """Which pairs are close: so many differing bits at most, and sizes (if there are any) alike by ``similarity``."""

    bits: int
    similarity: float = 0.0

    def lightest(self, own: np.ndarray, shapes: np.ndarray, sizes: np.ndarray | None, label: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the close pairs (own member, any member) a minimum spanning forest over the labels; pairs of one kind are passed over.

        Members are taken in order of size, and those of a few neighbouring sizes are compared with the sizes that can be alike only.
        """
        _, place = np.unique(label, return_inverse=True)
        order = np.arange(len(own)) if sizes is None else np.argsort(sizes, kind="stable")
        own, shapes, place, kind = own[order], shapes[order], place[order], kind[order]
        sizes = None if sizes is None else sizes[order]
        u, v, w = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
        mine, all_own, more, held = np.flatnonzero(own), own.all(), [], 0

        def chosen() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, c = (np.concatenate(x) for x in zip((u, v, w), *more))
            kept = spanning_forest(place[a], place[b], c, len(own))
            return a[kept], b[kept], c[kept]

        def upto(row: int) -> int:
            return int(np.searchsorted(sizes, sizes[row] / self.similarity + 1e-6, side="right"))

        at = 0
        while at < len(mine):
            low, high = mine[at] if all_own else 0, len(own)
            step = max(1, _COMPARED // (high - low))
            if sizes is not None:
                low = low if all_own else np.searchsorted(sizes, sizes[mine[at]] * self.similarity - 1e-6)
                step = max(_ROWS, (upto(mine[at]) - low) // 2)
                while step > 1 and step * (upto(mine[min(at + step, len(mine)) - 1]) - low) > _COMPARED:
                    step //= 2
                high = upto(mine[min(at + step, len(mine)) - 1])
            rows = mine[at : at + step]
            at += step
            apart = np.zeros((len(rows), high - low), np.uint8)
            for k in range(shapes.shape[1]):
                apart += np.bitwise_count(shapes[rows, k][:, None] ^ shapes[None, low:high, k])
            i, j = np.nonzero(apart <= self.bits)
            weight, j = apart[i, j], j + low
            near = (kind[rows[i]] != kind[j]) & ~(own[j] & (j <= rows[i]))
            if sizes is not None:
                near &= np.minimum(sizes[rows[i]], sizes[j]) >= self.similarity * np.maximum(sizes[rows[i]], sizes[j])
            if near.any():
                more.append((rows[i[near]], j[near], weight[near]))
                held += int(near.sum())
            if held > _COMPARED:
                u, v, w = chosen()
                more, held = [], 0
        if more:
            u, v, w = chosen()
        return order[u], order[v]


def _meetings(distinct: DataFrame, node: str, trees: list[tuple[str, VantageTree]], shapes: list[str], near: Near, size: str | None = None) -> DataFrame:
    """Edges ``u, v`` that connect all close pairs of nodes; ``trees`` are each asked with a fingerprint column.

    Every node is stored in its own leaf of each tree and visits every leaf that the triangle bound cannot rule out. A shard
    emits a spanning forest, so never more rows than it has members. Leaves with more than ``LEAF_MOST``
    members (near copies that no tree divides) are dealt: first their members, in parts that share a few pivots, which
    joins a large group into one class; then the largest class in parts, each with all others, as
    within the class nothing is left to ask. So no task holds a group of near copies, and rows grow in proportion to it.
    """
    spark = distinct.sparkSession
    spread = spark.sparkContext.broadcast(trees)
    columns = list(dict.fromkeys([node, *([size] if size else []), *shapes]))
    fields = ", ".join(f"{c} long" for c in columns)
    words = lambda table, names: np.stack([table[c].to_numpy() for c in names], axis=1).view(np.uint64)

    def held(batches: Iterator[pa.RecordBatch], by_label: bool, only: dict | None) -> Iterator[pa.RecordBatch]:
        """How many members each leaf has, by label or in all."""
        for batch in slices(batches, 4096):
            label = batch.column("label").to_numpy() if by_label else np.zeros(batch.num_rows, np.int64)
            for t, (column, tree) in enumerate(spread.value):
                leaf = tree.leaf(batch.column(column).to_numpy().view(np.uint64))
                if only is not None:
                    full = np.isin(leaf, only.get(t, _NONE))
                    pairs, n = np.unique(np.stack([leaf[full], label[full]], axis=1), axis=0, return_counts=True)
                else:
                    pairs, n = np.unique(np.stack([leaf, label], axis=1), axis=0, return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(n), t, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["tree", "leaf", "label", "held"])

    counted = "tree int, leaf long, label long, held long"
    sizes = distinct.mapInArrow(lambda x: held(x, False, None), counted).groupBy("tree", "leaf").agg(F.sum("held").alias("held"))
    full = {(r.tree, r.leaf): -(-r.held // SHARD_SIZE) for r in sizes.where(F.col("held") > LEAF_MOST).collect()}  # as many as leaves at most
    rows, first, most = distinct.withColumn("label", F.col(node)), None, {}
    if full:
        leaves: dict[int, np.ndarray] = {t: np.array([leaf for of, leaf in full if of == t]) for t in range(len(trees))}
        rows, first = _dealt_first(distinct, node, columns, spread, shapes, near, size, full, leaves)
        label_sizes = rows.mapInArrow(lambda x: held(x, True, leaves), counted).groupBy("tree", "leaf", "label").agg(F.sum("held").alias("held"))
        largest = label_sizes.groupBy("tree", "leaf").agg(F.max(F.struct("held", "label")).alias("most")).collect()
        most = {(r.tree, r.leaf): (r.most.label, max(1, -(-r.most.held // LEAF_MOST))) for r in largest}
    dealt = spark.sparkContext.broadcast(most)
    kept = ["label", *columns] if full else columns  # a node is its own label otherwise

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "own", *kept]
        full_leaves: dict[int, dict] = {}
        for (t, leaf), value in dealt.value.items():
            full_leaves.setdefault(t, {})[leaf] = value
        for batch in slices(batches, 4096):
            label, nodes = batch.column("label").to_numpy(), batch.column(node).to_numpy()
            for t, (column, tree) in enumerate(spread.value):
                who, leaf, own = tree.visits(batch.column(column).to_numpy().view(np.uint64))
                part = np.zeros(len(who), np.int32)
                more = [(who, leaf, own, part)]
                for at, (largest, parts) in full_leaves.get(t, {}).items():
                    here = np.flatnonzero(leaf == at)
                    inside = label[who[here]] == largest
                    mixed = nodes[who[here[inside]]].view(np.uint64) * MIX >> np.uint64(33)
                    part[here[inside]] = (mixed % np.uint64(parts)).astype(np.int32)
                    others = np.tile(here[~inside], parts - 1)
                    more.append((who[others], leaf[others], own[others], np.repeat(np.arange(1, parts, dtype=np.int32), (~inside).sum())))
                who, leaf, own, part = (np.concatenate(c) for c in zip(*more))
                shard = (np.int64(t) << 56) | (leaf << 32) | part
                yield pa.record_batch([pa.array(shard), pa.array(own), *batch.select(kept).take(pa.array(who)).columns], names=names)

    def match(group: pa.Table) -> pa.Table:
        group = group.sort_by(node)
        label = kind = group[kept[0]].to_numpy()
        shard = group["shard"][0].as_py()
        if shard & 0xFFFFFFFF:  # the others meet each other in part 0
            kind = (label == dealt.value[shard >> 56, shard >> 32 & 0xFFFFFF][0]).astype(np.int64)
        u, v = near.lightest(group["own"].to_numpy(), words(group, shapes), group[size].to_numpy() if size else None, label, kind)
        return _edge_table(group[node].to_numpy(), u, v)

    # a shard is a tree, a leaf and a part, in one number
    routed = rows.mapInArrow(route, f"shard long, own boolean, {', '.join(f'{c} long' for c in kept)}")
    found = routed.groupBy("shard").applyInArrow(match, "u long, v long")
    return (found.union(first) if full else found).distinct()


_NONE = np.empty(0, np.int64)


def _edge_table(nodes: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table({"u": np.minimum(nodes[u], nodes[v]), "v": np.maximum(nodes[u], nodes[v])})


def _dealt_first(distinct: DataFrame, node: str, columns: list[str], spread, shapes: list[str], near: Near, size: str | None, full: dict, leaves: dict) -> tuple[DataFrame, DataFrame]:
    """The nodes with a ``label``, and the edges by which nodes with the same label hang together: within a part
    of an over-full leaf all that reach the same pivot."""
    spark, fields = distinct.sparkSession, ", ".join(f"{c} long" for c in columns)
    parts = spark.sparkContext.broadcast(full)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "leaf", "part", "slot", "mixed", *columns]
        for batch in slices(batches, 4096):
            mixed = (batch.column(node).to_numpy().view(np.uint64) ^ MIX) * MIX >> np.uint64(33)
            for t, (column, tree) in enumerate(spread.value):
                leaf = tree.leaf(batch.column(column).to_numpy().view(np.uint64))
                at = np.flatnonzero(np.isin(leaf, leaves.get(t, _NONE)))
                if len(at):
                    among = np.array([parts.value[t, x] for x in leaf[at].tolist()], np.uint64)
                    part, slot = (mixed[at] // np.uint64(PIVOTS)) % among, mixed[at] % np.uint64(PIVOTS)
                    numbers = [np.full(len(at), t, np.int32), leaf[at], part.astype(np.int32), slot.astype(np.int32), mixed[at].astype(np.int64)]
                    yield pa.record_batch([*map(pa.array, numbers), *batch.select(columns).take(pa.array(at)).columns], names=names)

    shared = distinct.mapInArrow(members, f"tree int, leaf long, part int, slot int, mixed long, {fields}")
    chosen = shared.groupBy("tree", "leaf", "slot").agg(F.min(F.struct("mixed", *columns)).alias("least")).select("tree", "leaf", "least.*").collect()
    pivots: dict = {}
    for r in chosen:  # PIVOTS for each over-full leaf
        pivots.setdefault((r.tree, r.leaf), []).append([r[c] for c in columns])
    spread_pivots = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in pivots.items()})

    def match(group: pa.Table) -> pa.Table:
        own = np.stack([group[c].to_numpy() for c in columns], axis=1)
        shared_by_all = spread_pivots.value[group["tree"][0].as_py(), group["leaf"][0].as_py()]
        every = np.unique(np.concatenate([own, shared_by_all]), axis=0)
        ids = every[:, columns.index(node)]
        sizes = every[:, columns.index(size)] if size else None
        u, v = near.lightest(np.ones(len(every), bool), every[:, [columns.index(c) for c in shapes]].view(np.uint64), sizes, ids, ids)
        label = np.arange(len(ids))
        for a, b in zip(u, v):  # a forest: each edge joins two classes
            label[label == label[a]] = label[b]
        # a class with pivots takes the least of them for its label, and its pivots each other's
        with_pivot = np.isin(ids, shared_by_all[:, columns.index(node)])
        least = {c: ids[with_pivot & (label == c)].min() for c in np.unique(label[with_pivot])}
        known = np.isin(label, list(least))
        table = _edge_table(ids, u, v)
        told = pa.table({"u": ids[known], "v": np.array([least[c] for c in label[known]], np.int64)})
        kinds = pa.array(np.repeat([False, True], [len(u), int(known.sum())]))
        return pa.concat_tables([table, told]).append_column("told", kinds)

    met = written(shared.groupBy("tree", "leaf", "part").applyInArrow(match, "u long, v long, told boolean"))
    label = met.where("told").groupBy(F.col("u").alias("_member")).agg(F.min("v").alias("label"))
    known = distinct.join(label, F.col(node) == F.col("_member"), "left").drop("_member")
    return written(known.withColumn("label", F.coalesce("label", node))), met.where("not told").select("u", "v").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, sample_size: int = SAMPLE, shard_size: int | None = None) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints (column ``fp``) that connect all pairs within ``radius`` bits.

    Trees are shaped by a bounded sample and broadcast (one more than ``radius``, of at most ``SAMPLE / 4`` nodes each);
    every fingerprint is routed, to one leaf of each, as some block of a close pair is equal. Leaves aim at ``shard_size`` members (``LINK_SHARD``, ``SHARD_SIZE`` if that is less), as the comparisons in a leaf grow with its square
    and a fingerprint of eight bytes is cheap to route.
    """
    sample = distinct.groupBy(F.pmod(F.xxhash64("fp"), F.lit(sample_size)).alias("bucket")).agg(F.min_by("fp", F.xxhash64(F.lit(SEED), "fp")).alias("fp"))  # by another hash: least values have their first bits in common
    points = np.array([r.fp for r in sample.select("fp").orderBy(F.xxhash64("fp"), "fp").collect()], np.int64).view(np.uint64)
    trees = [("fp", tree) for tree in _forest(points, distinct.count(), radius, shard_size or min(LINK_SHARD, SHARD_SIZE), radius + 1)]
    return _meetings(distinct.select("fp"), "fp", trees, ["fp"], Near(radius))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row.

    Fingerprints of lower-cased four-word shingles link at ``radius`` or fewer differing bits;
    the component is the smallest doc id reachable through links, equal fingerprints included.
    Copies meet once, as one distinct fingerprint.

    Null and empty texts have fingerprint 0 and link like any other. A row without an id has a
    null component and links nothing. Repeated rows keep their rows, an empty table gives none,
    and other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    distinct = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    classes = _classes(distinct.withColumnRenamed("fp", "node"), links(distinct, radius))
    return prints.join(classes, prints.fp == classes.node, "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component_id`` for each of ``node, first_id``: the least ``first_id`` that the edges reach."""
    member = connected_components(edges)
    reached = written(member.join(nodes, "node"))
    least = reached.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = written(reached.join(least, "root").select("node", "component_id"))
    return written(nodes.join(joined, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")))


#: Near copies: shingles whose sets are compared, and the least similarity.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints that trees route by and those that distances are taken over, and the share of the latter's bits that
#: candidates may differ by (0.15 is expected at a similarity of 0.8, with a deviation of 0.026; 0.5 of unrelated texts).
WIDE, APART = 3, 0.255
#: Members of a group, and about the shingles, that are compared with as many others at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Shingles of texts that a task keeps to count further pairs.
_SHINGLES_HELD = 1 << 21
_MIXES = np.arange(1, 4 * WIDE, 2, dtype=np.uint64) * MIX
_FPS, _SHAPES = [f"f{k}" for k in range(WIDE)], [f"g{k}" for k in range(WIDE)]


def _shingle_set(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-cased words, and the sorted hashes of the distinct shingles (of few words: the whole sequence)."""
    h = hashed_words(text, lower=True)
    return h, np.unique(hashed_windows(h, min(size, len(h)))) if len(h) else h


def _set_key(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes(), SEED), "big", signed=True)


def wide_fingerprints(h: np.ndarray, shingles: np.ndarray) -> list[int]:
    """Signed 64-bit SimHashes under different mixings: of the distinct words (two), of the pairs of neighbours, of the shingles (``WIDE``)."""
    words, pairs = np.unique(h), np.unique(hashed_windows(h, min(2, len(h)))) if len(h) else h
    out = []
    for features, by in zip((words, words, pairs, *[shingles] * WIDE), _MIXES):
        mixed = features * by
        mixed ^= mixed >> np.uint64(32)
        mixed *= MIX
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), _CHUNK):
            ones += np.unpackbits(mixed[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(features)).tobytes(), "big", signed=True))
    return out


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, node, n`` and fingerprints of each row; the node is a hash of the shingle set, n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in texts(batch.column("text")):
                h, shingles = _shingle_set(text, size)
                rows.append((_set_key(shingles), len(shingles), *wide_fingerprints(h, shingles)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "part", "node", "n", *_FPS, *_SHAPES])

    return docs.select("doc_id", "part", "text").mapInArrow(run, f"doc_id long, part long, node long, n long, {', '.join(f'{f} long' for f in _FPS + _SHAPES)}")


def candidates(distinct: DataFrame, similarity: float = SIMILARITY, sample_size: int = SAMPLE) -> DataFrame:
    """Edges ``u, v`` that connect all nodes that may be as similar and meet in one of the vantage-point trees over each fingerprint.

    Routing is that of ``links``, by words and word pairs; distances are those of the shingles'
    fingerprints. Each of ``BLOCKS`` blocks has a tree, so nodes within ``BLOCKS - 1`` bits of a fingerprint meet for certain, and
    a node goes to as many leaves whatever the size of the input. The edges are the lightest that connect, so most of them are links.
    """
    sample = distinct.groupBy(F.pmod(F.xxhash64(*_FPS), F.lit(sample_size)).alias("bucket")).agg(F.min_by(F.struct(*_FPS), F.xxhash64(F.lit(SEED), *_FPS)).alias("fps"))
    points = np.array([tuple(r) for r in sample.select("fps.*").orderBy(F.xxhash64(*_FPS), *_FPS).collect()], np.int64).reshape(-1, WIDE).view(np.uint64)
    count = distinct.count()
    trees = [(_FPS[k], tree) for k in range(WIDE) for tree in _forest(points[:, k].copy(), count, 3)]
    return _meetings(distinct, "node", trees, _SHAPES, Near(int(64 * WIDE * APART), similarity), "n")


def _texts(edges: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of each end of the edges: a text is shipped, not its many shingles, and all are looked up once."""
    wanted = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().join(nodes, "node").select("node", F.col("first_id").alias("doc_id"), "part")
    return written(rows.join(wanted, ["doc_id", "part"]).select("node", "text").dropDuplicates(["node"]))


def _as_similar(edges: DataFrame, bodies: DataFrame, similarity: float, size: int) -> DataFrame:
    """Of the edges those whose shingle sets are as similar, counted exactly."""
    pairs = edges
    for end in "uv":
        pairs = pairs.join(bodies.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(batches):
            kept = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v"))):
                if held > _SHINGLES_HELD:
                    sets.clear()
                    held = 0
                for node, text in zip(row[:2], row[2:]):
                    if node not in sets:
                        sets[node] = _shingle_set(text or "", size)[1]
                        held += len(sets[node])
                a, b = (sets[x] for x in row[:2])
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return written(pairs.select("u", "v", "text_u", "text_v").mapInArrow(count, "u long, v long"))


def _links_across(left: list[np.ndarray], right: list[np.ndarray], left_class: np.ndarray, right_class: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places (left, right) of links that connect the classes as all pairs as similar do; pairs of one class are passed over."""
    values, ids = np.unique(np.concatenate(left + right), return_inverse=True)
    sizes = np.array([len(s) for s in left])
    starts = np.cumsum(sizes) - sizes
    ids, at = (ids[: sizes.sum()], ids[sizes.sum() :]), 0
    _, label = np.unique(np.concatenate([left_class, right_class]), return_inverse=True)
    out, mark = [], np.zeros(len(values), np.int64)
    for j, own in enumerate(right):
        mine, mark_at = label[len(left) + j], ids[1][at : at + len(own)]
        at += len(own)
        apart = label[: len(left)] != mine
        if not apart.any():
            continue
        mark[mark_at] = 1
        shared = np.add.reduceat(mark[ids[0]], starts)
        mark[mark_at] = 0
        near = np.flatnonzero(apart & (shared >= similarity * (sizes + len(own) - shared)))
        found, first = np.unique(label[near], return_index=True)
        out += [(int(i), j) for i in near[first]]
        label[np.isin(label, found)] = mine
    return out


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of the groups that have several classes, whether the class is not the group's largest (``other``), and into how many
    blocks all members and the others are cut."""
    sizes = members.groupBy("grp", "class").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    groups = sizes.groupBy("grp").agg(F.count("*").alias("classes"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), F.max(F.struct("size", "shingles", "class")).alias("main"))
    cut = lambda size, shingles: F.ceil(F.greatest(size / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    several = groups.where("classes > 1").select(
        "grp",
        F.col("main.class").alias("main"),
        cut(F.col("size"), F.col("shingles")).alias("blocks"),
        cut(F.col("size") - F.col("main.size"), F.col("shingles") - F.col("main.shingles")).alias("other_blocks"),
    )
    return written(members.join(several, "grp").select("node", "grp", "n", "links", "class", (F.col("class") != F.col("main")).alias("other"), "blocks", "other_blocks"))


def _between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges as edges between the classes of their ends, where these differ."""
    for end in "uv":
        edges = edges.join(members.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}")), end)
    return edges.where("class_u != class_v").select(F.col("class_u").alias("u"), F.col("class_v").alias("v")).distinct()


def _remaining_links(edges: DataFrame, links: DataFrame, members: DataFrame, bodies: DataFrame, similarity: float, size: int) -> DataFrame:
    """Edges ``u, v`` between classes (of ``members``, which ``links`` connect) that have a link, so that no pair that meets is lost.

    The edges join every pair that meets, so all such pairs lie within the groups of classes that these connect. In groups
    of several classes each member outside the largest class is compared with all members of other classes.
    Groups of more than a block first have their best linked member counted against all others, in
    one pass that is linear; blocks of what is still apart are then compared pairwise.
    """
    apart = written(_between(edges, members))
    if apart.isEmpty():
        return apart
    groups = connected_components(apart).withColumnsRenamed({"node": "class", "root": "grp"})
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    opened = members.where("n > 0").join(groups, "class").join(degree, "node", "left")
    opened = _in_blocks(opened.select("node", "grp", "n", "class", F.coalesce("links", F.lit(0)).alias("links")))
    found = None
    wide = opened.where("blocks > 1")
    if not wide.isEmpty():
        hubs = wide.groupBy("grp").agg(F.max(F.struct("links", "node", "class")).alias("hub"))
        rest = wide.join(hubs, "grp").where("class != hub.class")
        to_hub = written(rest.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")))
        found = written(_between(_as_similar(to_hub, bodies, similarity, size), opened))
        roots = connected_components(found).withColumnsRenamed({"node": "class"})
        joined = opened.select("node", "grp", "n", "links", "class").join(roots, "class", "left")
        opened = _in_blocks(joined.select("node", "grp", "n", "links", F.coalesce("root", "class").alias("class")))
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))
    one = opened.select("grp", place("blocks").alias("i"), every("other_blocks").alias("j"), "node", "class", F.lit(False).alias("right"))
    two = opened.where("other").select("grp", every("blocks").alias("i"), place("other_blocks").alias("j"), "node", "class", F.lit(True).alias("right"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        right, own = group["right"].to_numpy(), group["class"].to_numpy()
        shingles = [_shingle_set(t or "", size)[1] for t in group["text"].to_pylist()]
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        met = _links_across([shingles[k] for k in a], [shingles[k] for k in b], own[a], own[b], similarity) if len(a) and len(b) else []
        return pa.table({"u": pa.array([int(own[a[i]]) for i, _ in met], pa.int64()), "v": pa.array([int(own[b[j]]) for _, j in met], pa.int64())})

    last = written(one.union(two).join(bodies, "node").groupBy("grp", "i", "j").applyInArrow(compare, "u long, v long"))
    discard(apart)
    return last if found is None else last.union(found)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = COPY_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for each row: documents whose sets of ``size``-word shingles are ``similarity`` or more alike (Jaccard).

    Copies meet once, as one distinct set. Candidates come from vantage-point trees over
    64-bit SimHashes of the words and word pairs used (an edit breaks fewer of these than of
    long shingles, so near copies stay closer); links are counted exactly, the closest pairs first, then
    within each group of candidates that these leave apart. The component is the smallest doc id reachable.

    Words are lower-cased (A-Z). Fewer words than ``size`` are one shingle; null and empty texts
    have none and are copies of each other. A row without an id has a null component and links
    nothing. Repeated rows keep their rows, an empty table gives none; other columns are not read.
    """
    rows, every = ids_and_text(docs, id_col, text_col).withColumn("part", F.xxhash64("text")), [*_FPS, *_SHAPES]
    prints = written(_sketches(rows, size))
    one_text = F.min(F.struct("doc_id", "part")).alias("least")
    nodes = prints.where("doc_id is not null").groupBy("node").agg(one_text, *(F.min(c).alias(c) for c in ("n", *every)))
    nodes = written(nodes.select("node", F.col("least.doc_id").alias("first_id"), "least.part", "n", *every))
    # of sets with the same fingerprints one goes through the trees, the others are candidates of it
    same = nodes.groupBy(*every).agg(F.min(F.struct("first_id", "node", "n")).alias("least"))
    distinct = written(same.select("least.node", "least.n", *every))
    first = distinct.withColumnRenamed("node", "first_node").drop("n")
    twins = nodes.join(first, every).where("node != first_node").select(F.least("node", "first_node").alias("u"), F.greatest("node", "first_node").alias("v"))
    edges = written(candidates(distinct, similarity).union(twins))
    discard(distinct)
    bodies = _texts(edges, rows, nodes)
    links = _as_similar(edges, bodies, similarity, size)
    members = nodes.join(connected_components(links), "node", "left").select("node", "n", "first_id", F.coalesce("root", "node").alias("class"))
    members = written(members)
    more = connected_components(_remaining_links(edges, links, members, bodies, similarity, size)).withColumnRenamed("node", "class")
    joined = written(members.join(more, "class", "left").select("node", "first_id", F.coalesce("root", "class").alias("class")))
    least = joined.groupBy("class").agg(F.min("first_id").alias("component_id"))
    classes = written(joined.join(least, "class").select("node", "component_id"))
    discard(edges, bodies, links, members, joined)
    return prints.join(classes, "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component (its smallest id; of repeated rows with that id the one of least text hash), all columns.

    Rows without an id stay: nothing tells them apart.
    """
    return _first_of_each(docs, near_duplicates(docs, radius, id_col, text_col), id_col, text_col)


def keep_one_copy(docs: DataFrame, similarity: float = SIMILARITY, size: int = COPY_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for components of ``near_copies``.

    Null and empty texts have no shingles and are copies of each other. Rows without an id stay; of rows
    that share an id one stays at most. An empty table gives no rows; all columns stay, whatever their names.
    """
    return _first_of_each(docs, near_copies(docs, similarity, size, id_col, text_col), id_col, text_col)


def _first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    place = free_name("_place", docs)
    by_text = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    first = docs.join(written(kept), id_col, "left_semi").withColumn(place, F.row_number().over(by_text)).where(F.col(place) == 1).drop(place)
    return first.select(docs.columns).union(docs.where(F.col(id_col).isNull()))
