"""Hard-negative mining over a vantage-point tree.

Scores are integer inner products.  Each vector gets one more component that
brings all to the length of the longest, a query a zero: then the squared
distance of a query q and a row x is |q|^2 + M^2 - 2 q.x, so nearer means a
higher score, and a window of scores is an annulus of distances.

A vantage-point tree, grown on a sample, deals all rows to leaves; each leaf
knows the least and largest distance of its rows to every vantage point above
it.  By the triangle inequality these bound the distance of a query to all rows
of the leaf.  A query visits leaves nearest first: first the few nearest ones
that reach into its annulus, then, with the scores found there as a new inner
bound, all that can still hold one of its k best.  Nothing else can, so results
are exact; how many leaves are spared depends on the data.

Leaves and their visitors are cut into blocks, so no task holds an unbounded
group, and a block returns k rows for each query and window at most.  Of rows
equal in label and vector only the first few by id can be among the k best of
anyone (ties go by id), so copies leave before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import drop, materialised

#: Rows a leaf is meant to hold, leaves at most, and vantage components in all.
LEAF_ROWS, MOST_LEAVES, TREE_VALUES = 1024, 4096, 1 << 20
#: Rows of the sample for each leaf, and its components at most.
SAMPLE_ROWS, SAMPLE_VALUES = 8, 1 << 22
#: Leaves of the first increment of a traversal.
FIRST_LEAVES = 4
#: Rows of a leaf, and visitors, that meet in one group.
BLOCK_ROWS, BLOCK_VISITORS = 2048, 2048
#: Squared length from which a vector's scores are no sure longs; and up to which doubles hold them exactly.
LONGEST, EXACT = float(1 << 56), float(1 << 53)
_ALL = 1 << 60


class VantageTree:
    """Vantage points and radii; a child below zero is the leaf of number ~child."""

    def __init__(self, points: np.ndarray, leaves: int):
        """Grown on ``points``: each node's vantage point spreads the distances most, its radius is their median."""
        depth = int(np.ceil(np.log2(max(leaves, 1))))
        vantage, radius, child = [], [], []
        self.leaves: list[list[int]] = []

        def grow(rows: np.ndarray, path: list[int]) -> int:
            if len(path) < depth and len(rows) >= 2:
                some = points[rows[:: max(1, len(rows) // 256)]]
                best, most = None, 0.0
                for candidate in points[rows[:: max(1, len(rows) // 8)]]:
                    spread = float(np.var(_distances(some, candidate[None, :])))
                    if spread > most:
                        best, most = candidate, spread
                if best is not None:
                    away = _distances(points[rows], best[None, :])[:, 0]
                    middle = float(np.median(away))
                    if middle >= away.max():
                        middle = float(away[away < middle].max(initial=away.min()))
                    inside = away <= middle
                    if not inside.all():
                        node = len(vantage)
                        vantage.append(best)
                        radius.append(middle)
                        child.append([0, 0])
                        child[node][0] = grow(rows[inside], [*path, node])
                        child[node][1] = grow(rows[~inside], [*path, node])
                        return node
            self.leaves.append(path)
            return ~(len(self.leaves) - 1)

        root = grow(np.arange(len(points)), [])
        self.depth = max(map(len, self.leaves))
        self.root = root
        self.vantage = np.array(vantage).reshape(len(vantage), points.shape[1])
        self.radius, self.child = np.array(radius), np.array(child, np.int64).reshape(-1, 2)
        #: node of each leaf's path by level, -1 beyond its end
        self.path = np.full((len(self.leaves), self.depth), -1, np.int64)
        for row, nodes in zip(self.path, self.leaves):
            row[: len(nodes)] = nodes

    def place(self, points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each point's leaf, and its distances to the vantage points above it."""
        at = np.full(len(points), self.root, np.int64)
        away = np.zeros((len(points), self.depth))
        level = np.zeros(len(points), np.int64)
        for step in range(self.depth):
            on = np.flatnonzero(at >= 0)
            if not len(on):
                break
            v = self.vantage[at[on]]
            d = np.sqrt(np.maximum(((points[on] - v) ** 2).sum(axis=1), 0))
            away[on, step] = d
            level[on] = step + 1
            at[on] = self.child[at[on], (d > self.radius[at[on]]).astype(np.int64)]
        return ~at, [row[:n] for row, n in zip(away, level)]


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :] - 2 * points @ others.T
    return np.sqrt(np.maximum(squared, 0))


class LeafBounds:
    """What the rows of each leaf have in common: least and largest distance to the vantage points above."""

    def __init__(self, tree: VantageTree, leaf: np.ndarray, level: np.ndarray, least: np.ndarray, largest: np.ndarray, rows: np.ndarray):
        self.tree = tree
        self.least = np.full(tree.path.shape, -np.inf)
        self.largest = np.full(tree.path.shape, np.inf)
        self.least[leaf, level], self.largest[leaf, level] = least, largest
        self.rows = rows

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, leaves): bounds of the distance to any row of the leaf, from below and above."""
        low = np.zeros((len(queries), len(self.rows)))
        high = np.full((len(queries), len(self.rows)), np.inf)
        if self.tree.depth:
            to_vantage = _distances(queries, self.tree.vantage)
            for level in range(self.tree.depth):
                node = self.tree.path[:, level]
                away = to_vantage[:, node]
                on = node >= 0
                np.maximum(low, np.where(on, np.maximum(away - self.largest[:, level], self.least[:, level] - away), 0), out=low)
                np.minimum(high, np.where(on, away + self.largest[:, level], np.inf), out=high)
        return low, high


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers as doubles, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lifted(z: np.ndarray, longest: float) -> np.ndarray:
    """With the component that brings a row to the length of the longest."""
    return np.hstack([z, np.sqrt(np.maximum(longest - (z**2).sum(axis=1, keepdims=True), 0))])


def _place(tree, width: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, away = tree.value.place(_lifted(_matrix(batch.column("z"), width), longest))
            offsets = pa.array(np.cumsum([0, *map(len, away)]), pa.int32())
            path = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(away) if away else np.empty(0), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("z"), pa.array(leaf.astype(np.int32)), path], ["vec_id", "label", "z", "leaf", "path"])

    return run


def _next_leaves(bounds, width: int, longest: float, most: int | None):
    """Adds ``leaves``: those not yet seen that can hold a row of a window, nearest first, ``most`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_rows = bounds.value.rows
        step = max(1, 2_000_000 // len(leaf_rows))
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            z = _matrix(batch.column("z"), width)
            low, high = bounds.value.reach(np.hstack([z, np.zeros((len(z), 1))]))
            own = (z**2).sum(axis=1, keepdims=True) + longest
            # doubles may err by this much
            slack = 1e-6 * own + 1
            top, bottom = (own - low**2) / 2 + slack, np.where(np.isinf(high), -np.inf, (own - high**2) / 2 - slack)
            leaves = []
            for i, (los, his, seen) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), batch.column("seen").to_pylist())):
                fits = np.zeros(len(leaf_rows), bool)
                for lo, hi in zip(los, his):
                    if lo <= hi:
                        fits |= (top[i] >= lo) & (bottom[i] <= hi)
                fits &= leaf_rows > 0
                fits[seen] = False
                found = np.flatnonzero(fits)
                leaves.append(found[np.argsort(low[i][found], kind="stable")][:most].astype(np.int32))
            offsets = pa.array(np.cumsum([0, *map(len, leaves)]), pa.int32())
            values = pa.array(np.concatenate(leaves) if leaves else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values)], [*batch.schema.names, "leaves"])

    return run


def _best(k: int, same: bool, width: int, longest: float):
    """The k best of a block's rows for each query and window."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        visitor = table.column("visitor").to_numpy()
        mine, theirs = table.filter(pa.array(visitor == 0)), table.filter(pa.array(visitor == 1))
        found: list[np.ndarray] = []
        if len(mine) and len(theirs):
            mine = mine.sort_by("vec_id").combine_chunks()
            ids, labels = mine.column("vec_id").to_numpy(), mine.column("label").to_numpy()
            x, q = (_matrix(t.combine_chunks().column("z").chunk(0), width) for t in (mine, theirs))
            scores = (q @ x.T if longest <= EXACT else q.astype(np.int64) @ x.astype(np.int64).T).astype(np.int64)
            los, his = theirs.column("lo").to_pylist(), theirs.column("hi").to_pylist()
            for i, (anchor, label) in enumerate(zip(theirs.column("vec_id").to_pylist(), theirs.column("label").to_pylist())):
                s = scores[i]
                at = np.flatnonzero(((labels == label) == same) & (s >= min(los[i])) & (s <= max(his[i])) & (ids != anchor))
                # rows are in order of their ids, so a stable order by score breaks ties by id
                at = at[np.argsort(-s[at], kind="stable")]
                down = -s[at]
                for w, (lo, hi) in enumerate(zip(los[i], his[i])):
                    part = at[np.searchsorted(down, -hi) : np.searchsorted(down, -lo, "right")][:k]
                    if len(part):
                        found.append(np.column_stack([np.full(len(part), anchor), np.full(len(part), w), ids[part], s[part]]))
        rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        return pa.table({c: pa.array(rows[:, n].astype(t)) for n, (c, t) in enumerate((("anchor", np.int64), ("w", np.int32), ("vec_id", np.int64), ("score", np.int64)))})

    return run


class _Index:
    """Rows in their leaves, and what a search needs to know of them."""

    def __init__(self, rows: DataFrame, total: int, width: int, longest: float, copies: int):
        spark = rows.sparkSession
        self.width, self.longest, self.spark = width, longest, spark
        leaves = int(np.clip(total // LEAF_ROWS, 1, max(1, min(MOST_LEAVES, TREE_VALUES // (width + 1)))))
        take = max(1, min(SAMPLE_ROWS * max(leaves, 128), SAMPLE_VALUES // (width + 1)))
        # by the hash's range, not by order, so that no task holds them all
        some = rows if total <= take else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(total)) < take)
        sample = some.select("vec_id", "z").toArrow().combine_chunks().sort_by("vec_id").combine_chunks()
        points = _matrix(sample.column("z").chunk(0), width) if len(sample) else np.zeros((1, width))
        tree = VantageTree(_lifted(points, longest), leaves)
        hot = Window.partitionBy("h1", "h2", "label").orderBy("vec_id")
        apart = rows.withColumns({"h1": F.xxhash64("z"), "h2": F.xxhash64(F.lit(7), "z")}).withColumn("copy", F.row_number().over(hot)).where(F.col("copy") <= copies)
        shared = spark.sparkContext.broadcast(tree)
        self.placed = materialised(apart.select("vec_id", "label", "z").mapInArrow(_place(shared, width, longest), "vec_id long, label long, z array<long>, leaf int, path array<double>"))
        levels = self.placed.select("leaf", F.posexplode("path").alias("level", "away")).groupBy("leaf", "level").agg(F.min("away").alias("least"), F.max("away").alias("largest"))
        # a row for each leaf and level at most
        got = levels.toArrow().combine_chunks()
        counted = self.placed.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()
        held = np.zeros(len(tree.leaves), np.int64)
        held[counted.column("leaf").to_numpy()] = counted.column("n").to_numpy()
        self.bounds = spark.sparkContext.broadcast(LeafBounds(tree, *(got.column(c).to_numpy() for c in ("leaf", "level", "least", "largest")), held))
        self.blocks = spark.createDataFrame([(i, max(1, -(-int(n) // BLOCK_ROWS))) for i, n in enumerate(held)], "leaf int, blocks int")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, vec_id, score, rank): the k best rows of each query's windows.

        queries: vec_id, label, z, lo and hi (lists of windows, both ends included).
        """
        first = materialised(self._leaves(queries.withColumn("seen", F.array().cast("array<int>")), FIRST_LEAVES))
        near = materialised(self._met(first, k, same))
        enough = _ranked(near, k).groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        # a window each, five at most
        kth = enough.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("kth"))
        joined = first.join(kth, first["vec_id"] == kth["anchor"], "left")
        inner = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at(F.col("kth"), w), x)))
        second = joined.select("vec_id", "label", "z", inner.alias("lo"), "hi", F.col("leaves").alias("seen"))
        second = materialised(self._leaves(second, None))
        rest = materialised(self._met(second, k, same))
        best = materialised(_ranked(near.unionByName(rest), k))
        drop(first, near, second, rest)
        return best

    def _leaves(self, queries: DataFrame, most: int | None) -> DataFrame:
        ask = queries.select("vec_id", "label", "z", "lo", "hi", "seen")
        return ask.mapInArrow(_next_leaves(self.bounds, self.width, self.longest, most), "vec_id long, label long, z array<long>, lo array<long>, hi array<long>, seen array<int>, leaves array<int>")

    def _met(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        visit = queries.select("vec_id", "label", "z", "lo", "hi", F.explode("leaves").alias("leaf"))
        load = queries.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("guests"))
        # a row for each leaf at most
        plan = F.broadcast(load.join(F.broadcast(self.blocks), "leaf").select("leaf", "blocks", F.ceil(F.col("guests") / BLOCK_VISITORS).cast("int").alias("turns")))
        whole = F.lit(None).cast("array<long>")
        mine = self.placed.join(plan, "leaf").select(
            "leaf", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"),
            F.lit(0).alias("visitor"), "vec_id", "label", "z", whole.alias("lo"), whole.alias("hi"),
        )
        theirs = visit.join(plan, "leaf").select(
            "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), "turns").cast("int").alias("turn"),
            F.lit(1).alias("visitor"), "vec_id", "label", "z", "lo", "hi",
        )
        return mine.union(theirs).groupBy("leaf", "block", "turn").applyInArrow(_best(k, same, self.width, self.longest), "anchor long, w int, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floor_share(value: Column, per_cent: int) -> Column:
    """The largest integer not above so many per cent, exactly."""
    product = value * per_cent
    return F.call_function("div", product - F.pmod(product, F.lit(100)), F.lit(100))


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Reads vec_id, label (an integer) and embedding, and what ``anchor``, the
    rows to mine for (default: ids divisible by 100), reads.  Components become
    floor(scale * x); scores are inner products, higher first, ties by id.  An
    anchor's positives are its first ``positives`` other rows of the same label;
    for each, the first ``negatives`` rows of other labels follow whose score is
    ``low`` to ``high`` per cent of the positive's.

    Rows take no part whose id, label or vector is null, that hold a null or a
    non-finite component, or whose floored vector has a squared length of 2^56
    or more (their scores need not be longs).  Shorter vectors count as filled
    up with zeros.  Rows that repeat an id count once, the least by label and
    vector.  Without anchors, positives or negatives there are no rows.  Runs
    Spark jobs before it returns.
    """
    wanted = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float(1 << 40) / scale)))
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), wanted.alias("wanted"), "embedding")
    source = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    squared = F.aggregate("z", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    sound = source.select("vec_id", "label", "wanted", whole.alias("z")).withColumn("squared", squared).where(F.col("squared") < LONGEST)
    # of rows that repeat an id one stays; all of an id are anchors or none, unless they differ in other columns
    single = sound.groupBy("vec_id").agg(F.min(F.struct("label", "z", "squared", "wanted")).alias("row"))
    rows = materialised(single.select("vec_id", "row.label", "row.z", "row.squared", "row.wanted"))
    facts = rows.agg(F.count("*").alias("n"), F.max("squared").alias("longest"), F.max(F.size("z")).alias("width")).first()
    index = _Index(rows.select("vec_id", "label", "z"), facts["n"], max(facts["width"] or 1, 1), facts["longest"] or 0.0, max(positives + 1, negatives))
    anchors = rows.where(F.coalesce("wanted", F.lit(False))).select("vec_id", "label", "z")
    everything = anchors.withColumns({"lo": F.array(F.lit(-_ALL)), "hi": F.array(F.lit(_ALL))})
    near = index.search(everything, positives, same=True)
    # five each at most
    own = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own"))
    own = materialised(own)
    asked = anchors.join(own, anchors["vec_id"] == own["anchor"]).select(
        "vec_id", "label", "z",
        F.transform("own", lambda p: -_floor_share(-p["score"], low)).alias("lo"),
        F.transform("own", lambda p: _floor_share(p["score"], high)).alias("hi"),
    )
    far = index.search(asked, negatives, same=False)
    drop(rows, near, index.placed)
    positive = own.select("anchor", F.posexplode("own").alias("w", "p"))
    out = far.join(positive, ["anchor", "w"])
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
