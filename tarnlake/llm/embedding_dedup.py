"""Embedding near-dedup: cover trees, traversed in pairs, give the exact links at a threshold.

Vectors are compared within their label. On unit vectors a cosine of at least ``threshold`` is a
distance of at most tau = sqrt(2 - 2 * threshold), so that covering radii bound it.

1. Equal vectors of a label (their bytes) form a class of known size: copies link with each other
   and have the same other links, so one of them is compared.
2. Each class goes to the nearest of its label's pivots (about one for each ``BLOCK`` classes, at
   most about ``PIVOTS``, chosen by a hash) and to a block there, by a hash, such that blocks hold
   about ``BLOCK`` classes whatever the cell holds. A block knows how near and far its classes are
   from its own pivot and from ``WITNESSES`` others of its label.
3. Pairs of blocks of a label are kept if no pivot shows that they are more than tau apart; each is
   one piece of work, dealt over all tasks. A label with a third of all rows is thus many pieces.
4. In a piece each block becomes a cover tree: nested levels whose radii halve, built as greedy
   nets down to single points. Both trees are traversed together: pairs of nodes whose centres are
   further apart than tau and both covering radii are pruned with all below them, others go on with
   their children, down to pairs of points, whose cosines are compared in double precision.
5. A piece returns how many links each class has there (copies counted), and for components a
   spanning forest of its links instead of the links themselves.

Sampled pivots decide only where rows go, never what is found: results are exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label, have no links and are their own component; vectors of different lengths
don't link; repeated rows with one vec_id count as several vectors for n_links, and different
vectors of one vec_id are linked only if they are near; rows with a null vec_id link with nothing,
their component_id is null and they are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, settle, task_count
from tarnlake.llm.components import components

THRESHOLD = 0.93
PIVOTS = 2048
BLOCK = 4096
WITNESSES = 4
#: A node of a cover tree with fewer points isn't divided if its radius is small beside tau.
LEAF = 24
#: Distances are compared with this much room for rounding (a distance near 0 errs by some 1e-8);
#: cosines aren't.
ROOM = 1e-7
#: Entries of a matrix of cosines that is held at once.
CELLS = 1 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)  # no overflow of squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Node:
    """Points (row numbers) around a centre within radius. Its children are single points and
    nodes; a leaf has only single points."""

    __slots__ = ("center", "radius", "points", "single", "nodes")

    def __init__(self, center: int, radius: float, points: np.ndarray, single: np.ndarray, nodes: list[Node]):
        self.center, self.radius, self.points, self.single, self.nodes = center, radius, points, single, nodes


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def net(x: np.ndarray, points: np.ndarray, center: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """A greedy net: centres (the given one first), each further than level from those before it,
    and for each point the number of a centre within level."""
    least = 1 - level * level / 2
    found, count = np.empty((len(points) + 1, x.shape[1])), 1
    found[0] = x[center]
    names, owner = [center], np.full(len(points), -1)
    for first in range(0, len(points), 256):
        own = points[first : first + 256]
        near = cosines(x[own], found[:count])
        best = near.argmax(1)
        at = np.where(near[np.arange(len(own)), best] >= least, best, -1)
        at[own == center] = 0
        rest = np.flatnonzero(at < 0)
        between = cosines(x[own[rest]], x[own[rest]])
        open_ = np.ones(len(rest), bool)
        for i in range(len(rest)):
            if open_[i]:
                hold = open_ & (between[i] >= least)
                hold[i] = True
                at[rest[hold]] = count
                open_ &= ~hold
                names.append(int(own[rest[i]]))
                found[count] = x[own[rest[i]]]
                count += 1
        owner[first : first + 256] = at
    return np.array(names), owner


def cover_tree(x: np.ndarray, small: float, points: np.ndarray | None = None, center: int | None = None, level: float = 1.0) -> Node:
    """The tree of points; nodes of radius up to small and of few points are leaves."""
    points = np.arange(len(x)) if points is None else points
    center = int(points[0]) if center is None else center
    radius = float(distances(x[points], x[center][None]).max(initial=0.0))
    if radius < 1e-6 or (len(points) <= LEAF and radius <= small):
        return Node(center, radius, points, points, [])
    while True:
        names, owner = net(x, points, center, level)
        if len(names) > 1:
            break
        level /= 2
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(names) + 1))
    size = np.diff(ends)
    single = points[order[ends[:-1][size == 1]]]
    nodes = []
    for i in np.flatnonzero(size > 1).tolist():
        own = points[order[ends[i] : ends[i + 1]]]
        child = cover_tree(x, small, own, int(names[i]), level / 2)
        if child.nodes or child.radius <= small:
            nodes.append(child)
        else:  # wide and of few points: its radius would prune nothing
            single = np.concatenate((single, child.points))
    return Node(center, radius, points, single, nodes)


class Links:
    """Pairs found: rows of x and of y."""

    def __init__(self, threshold: float):
        self.threshold, self.tau = threshold, float(np.sqrt(2 - 2 * threshold)) + ROOM
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def points(self, x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, upper: bool = False, turned: bool = False) -> None:
        """All links between points a of x and b of y. upper: a is b, each pair once."""
        rows = max(1, CELLS // max(1, len(b)))
        for first in range(0, len(a) if len(b) else 0, rows):
            skip = first if upper else 0
            i, j = np.nonzero(cosines(x[a[first : first + rows]], y[b[skip:]]) >= self.threshold)
            i, j = i + first, j + skip
            if upper:
                i, j = i[i < j], j[i < j]
            (self.right if turned else self.left).append(a[i])
            (self.left if turned else self.right).append(b[j])

    def node(self, x: np.ndarray, p: Node, y: np.ndarray, b: np.ndarray, turned: bool = False) -> None:
        """All links between a node of x and points b of y."""
        b = b[distances(y[b], x[p.center][None])[:, 0] <= self.tau + p.radius]
        if len(b):
            self.points(x, p.single, y, b, turned=turned)
            for child in p.nodes:
                self.node(x, child, y, b, turned)


def dual_traversal(x: np.ndarray, a: Node, y: np.ndarray, b: Node, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of x, row of y) with a cosine of at least threshold. same: x and y are one
    block, and each pair is wanted once, without pairs of a row with itself."""
    links, todo = Links(threshold), [(a, b)]
    if float(distances(x[a.center][None], y[b.center][None])[0, 0]) > links.tau + a.radius + b.radius:
        todo = []
    while todo:
        p, q = todo.pop()
        own = same and p is q
        links.points(x, p.single, y, q.single, upper=own)
        for child in p.nodes:
            links.node(x, child, y, q.single)
        if own:
            todo += [(child, child) for child in p.nodes]
        else:
            for child in q.nodes:
                links.node(y, child, x, p.single, turned=True)
        if p.nodes and q.nodes:
            far = distances(x[[c.center for c in p.nodes]], y[[c.center for c in q.nodes]])
            reach = links.tau + np.array([c.radius for c in p.nodes])[:, None] + np.array([c.radius for c in q.nodes])[None, :]
            todo += [(p.nodes[i], q.nodes[j]) for i, j in np.argwhere(far <= reach).tolist() if not own or i < j]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *links.left]), np.concatenate([none, *links.right])


def forest(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of links between ids."""
    root: dict[int, int] = {}
    left, right = [], []

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            left.append(a)
            right.append(b)
    return left, right


def as_bytes(column) -> pa.Array:
    """Each vector of a list column as the bytes of its doubles; null if it can't be compared."""
    column = column.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros; null is NaN
    ends = np.concatenate(([0], np.cumsum(size)))

    def number(test: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(test)))[ends])

    good = (number(~np.isfinite(values)) == 0) & (number(values != 0) > 0)
    raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends * 8), pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(pa.array(good), raw, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, label, raw: bytes or null) and the classes (id, label, raw, first: their
    smallest vec_id, n). A class has an id of its own, as a vec_id may have several vectors."""
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), as_bytes(batch.column(2))], names=["vec_id", "label", "raw"])

    schema = source.select("vec_id", "label", F.lit(None).cast("binary").alias("raw")).schema
    rows = settle(source.mapInArrow(run, schema), "vectors")
    linked = rows.where("raw IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    grouped = linked.groupBy("label", "raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return rows, settle(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")


NEARS, FARS = [f"least_to_{i}_" for i in range(WITNESSES)], [f"most_to_{i}_" for i in range(WITNESSES)]


def placed(kinds: DataFrame) -> tuple[DataFrame, dict]:
    """Classes with cell (the nearest pivot of their label, by number), its distance (far) and those
    of the first pivots (FARS); pivots."""
    total = kinds.count()
    share = min(1 / BLOCK, PIVOTS / max(1, total))
    # only labels that need several blocks get pivots
    big = kinds.groupBy("label").agg(F.count("*").alias("all")).where(F.col("all") > BLOCK).select("label")
    chosen = kinds.where(F.pmod(F.xxhash64("first", "raw"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).join(big, "label", "left_semi")
    pivots: dict = {}
    for r in chosen.select("label", "raw").collect():
        pivots.setdefault((r.label, len(r.raw)), []).append(bytes(r.raw))
    fixed = {key: unit(np.stack([np.frombuffer(v) for v in sorted(found)])) for key, found in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, raws = batch.column("label").to_pylist(), batch.column("raw").to_pylist()
            cell, far = np.full(len(raws), -1, np.int64), np.full((len(raws), 1 + WITNESSES), 4.0)
            groups: dict = {}
            for i, (label, raw) in enumerate(zip(labels, raws, strict=True)):
                groups.setdefault((label, len(raw)), []).append(i)
            for key, at in groups.items():
                if key in fixed:
                    for first in range(0, len(at), 1024):
                        some = at[first : first + 1024]
                        d = distances(unit(np.stack([np.frombuffer(raws[i]) for i in some])), fixed[key])
                        cell[some], far[some, 0] = d.argmin(1), d.min(1)
                        width = min(WITNESSES, d.shape[1])
                        far[some, 1 : 1 + width] = d[:, :width]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), *(pa.array(c) for c in far.T.copy())], names=[*batch.schema.names, "cell", "far", *FARS])

    schema = kinds.withColumns({"cell": F.lit(0).cast("long")} | {n: F.lit(0.0) for n in ("far", *FARS)}).schema
    return settle(kinds.mapInArrow(run, schema), "placed"), fixed


def pieces(at: DataFrame, fixed: dict, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes with their block, and pairs of blocks (i <= j) of a label to compare."""
    size = F.octet_length("raw")
    cells = at.groupBy("label", size.alias("width"), "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cells = settle(cells, "cells")
    blocked = at.withColumn("width", size).join(cells, ["label", "width", "cell"]).withColumn("part", F.pmod(F.xxhash64("raw", F.lit(3)), F.col("parts")).cast("int"))
    blocked = settle(blocked.drop("parts"), "blocked")
    known = ["cell", "part", "far", *NEARS, *FARS]
    blocks = blocked.groupBy("label", "width", "cell", "part").agg(F.max("far").alias("far"), *[F.min(f).alias(n) for n, f in zip(NEARS, FARS, strict=True)], *[F.max(f).alias(f) for f in FARS])
    blocks = settle(blocks, "blocks")
    tau = float(np.sqrt(2 - 2 * threshold)) + ROOM

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, width, c1, f1, c2, f2 = (batch.column(n).to_pylist() for n in ("label", "width", "cell", "far", "cell2", "far2"))
            keep = np.ones(batch.num_rows, bool)
            for k in range(batch.num_rows):
                own = fixed.get((label[k], width[k]))
                keep[k] = own is None or c1[k] < 0 or float(distances(own[c1[k]][None], own[c2[k]][None])[0, 0]) <= tau + f1[k] + f2[k]
            yield batch.filter(pa.array(keep))

    two = blocks.select("label", "width", *[F.col(c).alias(f"{c}2") for c in known])
    apart = [(F.col(n) > F.col(f"{f}2") + tau) | (F.col(f"{n}2") > F.col(f) + tau) for n, f in zip(NEARS, FARS, strict=True)]
    pairs = blocks.join(two, ["label", "width"]).where("cell < cell2 OR (cell = cell2 AND part <= part2)")
    for test in apart:
        pairs = pairs.where(~test)
    return blocked, settle(pairs.mapInArrow(bound, pairs.schema).select("label", "width", "cell", "part", "cell2", "part2"), "pairs")


def links(blocked: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: for b null, class a has n links (copies counted) in some piece; else a link of a
    spanning forest."""
    key = ["label", "width", "cell", "part", "cell2", "part2"]
    first = pairs.select(*key).join(blocked, ["label", "width", "cell", "part"]).select(*key, F.lit(0).alias("side"), "id", "n", "raw")
    other = blocked.select("label", "width", F.col("cell").alias("cell2"), F.col("part").alias("part2"), "id", "n", "raw")
    second = pairs.where("cell <> cell2 OR part <> part2").select(*key).join(other, ["label", "width", "cell2", "part2"]).select(*key, F.lit(1).alias("side"), "id", "n", "raw")

    def piece(table: pa.Table) -> pa.RecordBatch:
        side = table.column("side").to_numpy()
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = unit(np.stack([np.frombuffer(v) for v in table.column("raw").to_pylist()]))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1)
        small = float(np.sqrt(2 - 2 * threshold)) / 2
        if len(b):
            i, j = dual_traversal(x[a], cover_tree(x[a], small), x[b], cover_tree(x[b], small), threshold, False)
            i, j = a[i], b[j]
        else:
            tree = cover_tree(x[a], small)
            i, j = dual_traversal(x[a], tree, x[a], tree, threshold, True)
            i, j = a[i], a[j]
        count = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        some = np.flatnonzero(count)
        left, right = forest(ids[i], ids[j])
        return pa.RecordBatch.from_arrays(
            [pa.array([*ids[some].tolist(), *left], pa.int64()), pa.array([*[None] * len(some), *right], pa.int64()), pa.array([*count[some].astype(int).tolist(), *[0] * len(left)], pa.int64())],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells = list(zip(*(batch.column(c).to_pylist() for c in range(len(key))), strict=True))
            begin = 0
            for i in range(1, len(cells) + 1):
                if i == len(cells) or cells[i] != cells[begin]:
                    if cells[begin] != at:
                        if group:
                            yield piece(pa.concat_tables(group))
                        at, group = cells[begin], []
                    group.append(table.slice(begin, i - begin))
                    begin = i
        if group:
            yield piece(pa.concat_tables(group))

    size = pairs.count() * BLOCK * 2 * (int(blocked.agg(F.max("width")).first()[0] or 0) + 64)
    parts = task_count(blocked.sparkSession, size)
    return first.union(second).repartition(parts, *key).sortWithinPartitions(*key, "side", "id").mapInArrow(run, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, kinds = classes(embeddings)
    at, fixed = placed(kinds)
    blocked, pairs = pieces(at, fixed, threshold)
    found = settle(links(blocked, pairs, threshold), "found")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    joined = settle(components(found.where("b IS NOT NULL").select("a", "b")).join(kinds.select("id", "first"), "id"), "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(least, "component").select("id", "least")
    named = kinds.join(counts, "id", "left").join(joined, "id", "left")
    named = settle(named.select("label", "raw", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component")), "named")
    for old in (at, blocked, pairs, found, kinds):
        discard(old)
    own = rows.withColumn("raw", F.when(F.col("vec_id").isNotNull(), F.col("raw")))
    out = own.join(named, ["label", "raw"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
