"""Embedding near-dedup over an inverted multi-index (Babenko & Lempitsky 2012).

Two codebooks, one for each half of the unit vectors, form a grid of cells.
Every vector lies in one cell and visits the cells nearest to it in the order
of the multi-sequence algorithm, those up to its own by number, so that two
vectors meet once.  How many cells it visits is set by measuring:
query vectors outside the fit are compared with all rows, in blocks, and the
traversal is made long enough to meet every link of every one of them, however
small its group.  They are added until enough groups have been seen.  Where too
few are found, nothing is guessed: cells are coarser and a vector visits all
whose distance bound allows a link, which loses none.
What meets in a cell is verified by cosine in double precision.

Equal vectors are one class and compared once.  A crowded cell is cut into
blocks of vectors and of visitors, so no task gets an unbounded group; a block
returns link counts and a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import drop, materialised

#: Rows the codebooks are fitted on for each codeword, and components of such rows in all, at most.
SAMPLE_ROWS, SAMPLE_VALUES = 8, 1 << 24
#: Query vectors of the recall measurement: at first, and at most, but for long vectors; four times more each time.
PROBE_QUERIES, MOST_PROBES = 2048, 32768
#: Vectors a cell is meant to hold, and codewords of a codebook at most.
CELL_ROWS, MOST_WORDS = 256, 8192
#: Cells visited at least.
LEAST_CELLS = 4
BLOCK_ROWS, BLOCK_VISITORS = 512, 4096
#: Vectors of a cell and of a block where cells are visited by the distance bound.
BOUND_ROWS = 1024


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_codebook(points: np.ndarray, words: int, rounds: int = 10) -> np.ndarray:
    """k-means with a deterministic spread of first centres."""
    words = min(words, len(points))
    centres = points[np.linspace(0, len(points) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin(_squared(points[lo : lo + 512], centres), axis=1) for lo in range(0, len(points), 512)])
        count = np.bincount(near, minlength=words)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def _nearest(distances: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest of each row, in order; a cell of rank ``count`` needs none beyond."""
    if count >= distances.shape[1]:
        return distances.argsort(1, kind="stable")
    some = np.sort(np.argpartition(distances, count - 1, axis=1)[:, :count], axis=1)
    return np.take_along_axis(some, np.take_along_axis(distances, some, 1).argsort(1, kind="stable"), 1)


def _beyond(squared: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Least squared distance of rows to what is nearest to each centre, by rows' squared distances to all."""
    out = np.zeros_like(squared)
    apart = np.sqrt(_squared(centres, centres))
    for k in range(len(centres)):
        plane = np.where(apart[k] > 1e-6, 2 * apart[k], np.inf)
        np.maximum(out, (squared - squared[:, k : k + 1]) / plane, out=out)
    return out**2


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    @classmethod
    def fit(cls, units: np.ndarray, words: int) -> MultiIndex:
        half = units.shape[1] // 2
        return cls(fit_codebook(units[:, :half], words), fit_codebook(units[:, half:], words))

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(units[:, : self.half], self.first), _squared(units[:, self.half :], self.second)

    def step(self) -> int:
        """Rows whose distances to all codewords are held at once."""
        return max(1, 4_000_000 // max(len(self.first), len(self.second)))

    def cells(self, units: np.ndarray) -> np.ndarray:
        out = np.empty(len(units), np.int64)
        for lo in range(0, len(units), self.step()):
            d1, d2 = self.distances(units[lo : lo + self.step()])
            out[lo : lo + self.step()] = d1.argmin(1) * len(self.second) + d2.argmin(1)
        return out

    def traverse(self, units: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each row, nearest first."""
        d1, d2 = self.distances(units)
        o1, o2 = _nearest(d1, count), _nearest(d2, count)
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        count = min(count, o1.shape[1] * o2.shape[1])
        out = np.empty((len(units), count), np.int64)
        for row in range(len(units)):
            a, b, u, v = s1[row].tolist(), s2[row].tolist(), o1[row], o2[row]
            heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
            for k in range(count):
                _, i, j = heapq.heappop(heap)
                out[row, k] = u[i] * len(self.second) + v[j]
                for x, y in ((i + 1, j), (i, j + 1)):
                    if x < len(a) and y < len(b) and (x, y) not in seen:
                        seen.add((x, y))
                        heapq.heappush(heap, (a[x] + b[y], x, y))
        return out

    def within(self, units: np.ndarray, squared: float) -> list[np.ndarray]:
        """For each row all cells, up to its own by number, that can hold a vector this near.

        A cell's vectors lie on its codeword's side of the plane halfway to any
        other, so a row is at least as far from them as from that plane.  Of
        two cells in reach of each other the one of higher number visits.
        """
        out: list[np.ndarray] = []
        step = max(1, 4_000_000 // (len(self.first) * len(self.second)))
        for lo in range(0, len(units), step):
            part = units[lo : lo + step]
            d1, d2 = self.distances(part)
            own = d1.argmin(1) * len(self.second) + d2.argmin(1)
            near = _beyond(d1, self.first)[:, :, None] + _beyond(d2, self.second)[:, None, :] <= squared + 1e-7
            out += [np.flatnonzero(row[: mine + 1]) for row, mine in zip(near.reshape(len(part), -1), own)]
        return out

    def rank(self, d1: np.ndarray, d2: np.ndarray, cell: int) -> int:
        """How many cells a traversal with these distances visits before ``cell``."""
        mine = d1[cell // len(d2)] + d2[cell % len(d2)]
        return int((d1[:, None] + d2[None, :] < mine).sum())


def _matrix(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = batch.column(name)
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _link_ranks(index: MultiIndex, queries: np.ndarray, ids: np.ndarray, cosine: float):
    """For each query with links in a batch: its number, the least id among it and them, the cells its traversal visits before the last of them, and their count.

    Products are in single precision, and in double where their error could decide.
    """
    slack = 2e-6 + 2e-7 * queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(_matrix(batch))
            if not len(units):
                continue
            rows = batch.column("rep").to_numpy()
            cells = index.cells(units)
            found: list[tuple[int, int, int, int]] = []
            rough = units.astype(np.float32)
            for lo in range(0, len(queries), 512):
                near = queries[lo : lo + 512].astype(np.float32) @ rough.T
                at, x = np.nonzero(near >= cosine - slack)
                close = np.flatnonzero(near[at, x] < cosine + slack)
                sure = np.ones(len(at), bool)
                sure[close] = (queries[lo + at[close]] * units[x[close]]).sum(axis=1) >= cosine
                at, x = at[sure], x[sure]
                other = ids[lo + at] != rows[x]
                at, x = at[other], x[other]
                if not len(at):
                    continue
                d1, d2 = index.distances(queries[lo : lo + 512])
                for q, own in zip(*_runs(at, x)):
                    rank = max(index.rank(d1[q], d2[q], c) for c in np.unique(cells[own]))
                    found.append((lo + q, min(int(ids[lo + q]), int(rows[own].min())), rank, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, ["probe", "least", "rank", "n"])

    return run


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct keys, which are in order, and the values of each."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts].tolist(), np.split(values, starts[1:])


def _place(index: MultiIndex, visits: int | None, cosine: float):
    """Each vector's cell, and the cells up to it that it visits: of the nearest ones, or without a number all that the bound allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, index.step()) for whole in batches for lo in range(0, whole.num_rows, index.step())):
            units = unit_rows(_matrix(batch))
            cells = index.cells(units)
            if visits:
                seen = [np.unique(np.append(row[row < own], own)) for row, own in zip(index.traverse(units, visits), cells)]
            else:
                seen = index.within(units, 2 - 2 * cosine)
            offsets = pa.array(np.cumsum([0, *map(len, seen)]), pa.int32())
            visited = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(seen), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("vector"), pa.array(cells), visited], ["rep", "copies", "vector", "cell", "visited"]
            )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable, for n nodes and edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _verify(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        visitor = table.column("visitor").to_numpy()
        mine = table.filter(pa.array(visitor == 0))
        theirs = table.filter(pa.array(visitor == 1))
        empty = pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(mine) or not len(theirs):
            return empty
        x, q = (unit_rows(_matrix(t.to_batches()[0])) for t in (mine, theirs))
        x_id, q_id = mine.column("rep").to_numpy(), theirs.column("rep").to_numpy()
        q_at, x_at = np.nonzero(q @ x.T >= cosine)
        keep = q_id[q_at] != x_id[x_at]
        q_at, x_at = q_at[keep], x_at[keep]
        # of two in one cell, each visits the other
        keep = (theirs.column("cell").to_numpy()[q_at] != mine.column("cell").to_numpy()[0]) | (q_id[q_at] < x_id[x_at])
        q_at, x_at = q_at[keep], x_at[keep]
        if not len(q_at):
            return empty
        ids, node = np.unique(np.concatenate([q_id[q_at], x_id[x_at]]), return_inverse=True)
        a, b = node[: len(q_at)], node[len(q_at) :]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a, mine.column("copies").to_numpy()[x_at])
        np.add.at(count, b, theirs.column("copies").to_numpy()[q_at])
        return pa.table({"rep": ids, "n": count, "root": ids[_forest(a, b, len(ids))]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, target: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row of ``vectors``.

    Reads vec_id and embedding only.  Vectors that are null, empty or zero or
    hold a null or a non-finite component link with nothing.  Vectors of each
    length have an index of their own.  vec_id is a key: rows that repeat an id
    are one vector; rows without one stand alone, each of them.  An empty table gives an empty one.  Runs Spark jobs before
    it returns.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    source = source.withColumn("sound", sound).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(7)))
    good = source.where("sound")
    lengths = [r["d"] for r in good.groupBy(F.size("vector").alias("d")).count().where("count > 1").orderBy(F.desc("count"), "d").collect()]
    known = source.where("vec_id is not null").dropDuplicates(["vec_id"])
    member = known.unionByName(source.where("vec_id is null")).select("vec_id", "h1", "h2", "sound")
    result: DataFrame | None = None
    for d in lengths:
        one = _linked(good.where(F.size("vector") == d).dropDuplicates(["vec_id"]), d, _is_float(vectors), cosine, target)
        result = one if result is None else result.union(one)
    if result is None:
        joined = member.withColumns({"n": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    else:
        joined = member.join(result, ["h1", "h2"], "left")
    component = F.when(F.col("sound"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    links = F.when(F.col("sound"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _linked(narrow: DataFrame, d: int, single: bool, cosine: float, target: float) -> DataFrame:
    """(h1, h2, n, component) of each distinct vector of one length."""
    classes = narrow.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialised(classes.withColumn("vector", F.transform("vector", lambda x: x.cast("float")) if single else F.col("vector")))
    total = classes.count()
    words = _words(total, CELL_ROWS)
    rows = max(1, min(SAMPLE_ROWS * max(words, 1024), SAMPLE_VALUES // d))
    # by the hash's range, not by order, so that no task holds them all
    some = classes if total <= rows else classes.where(F.pmod(F.xxhash64("rep", F.lit(13)), F.lit(total)) < rows)
    sample = some.select("rep", "vector").toArrow().combine_chunks().sort_by("rep")
    if not len(sample):
        sample = classes.select("rep", "vector").limit(1).toArrow().combine_chunks()
    units = unit_rows(_matrix(sample.to_batches()[0]))
    index = MultiIndex.fit(units, words)
    visits, _, _ = calibrate(classes, index, total, sample.column("rep").to_numpy(), cosine, target)
    if visits is None:
        index = MultiIndex.fit(units, _words(total, BOUND_ROWS))
    kind = classes.schema["vector"].dataType.simpleString()
    placed = materialised(classes.select("rep", "copies", "vector").mapInArrow(_place(index, visits, cosine), f"rep long, copies long, vector {kind}, cell long, visited array<long>"))
    met = _meetings(placed, BLOCK_ROWS if visits else BOUND_ROWS).groupBy("cell_at", "block", "turn").applyInArrow(_verify(cosine), "rep long, n long, root long")
    met = materialised(met)
    drop(placed)
    linked = met.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(met.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "component")
    result = classes.select("h1", "h2", "rep", "copies").join(linked, "rep", "left").join(roots, "rep", "left")
    result = materialised(result.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    drop(met, classes)
    return result


def _is_float(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.elementType.simpleString() == "float"


def _words(total: int, rows: int) -> int:
    """Codewords of each codebook for cells that hold so many rows."""
    return int(np.clip(round((total / rows) ** 0.5), 1, MOST_WORDS))


def calibrate(classes: DataFrame, index: MultiIndex, total: int, fitted: np.ndarray, cosine: float, target: float) -> tuple[int | None, int, int]:
    """Cells to visit so that each probe meets all its links, and a quarter more; and the groups and links this was measured on.

    A group counts once, however large.  If all of n groups are met, a share
    ``target`` of all groups is with 95 % confidence, for n of 3 / (1 - target)
    (the rule of three).  With fewer groups there is no length (None), unless
    every vector has been a probe and so nothing is left unseen.
    """
    groups = links = 0
    # probes travel to all tasks: as many as the components allow
    most = max(1, min(MOST_PROBES, SAMPLE_VALUES // (index.first.shape[1] + index.second.shape[1])))
    count = min(PROBE_QUERIES, most)
    while True:
        whole = total <= count
        # by the hash's range, not by order, so that no task holds them all
        some = classes if whole else classes.where(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(total)) < count)
        got = some.select("rep", "vector").toArrow().combine_chunks()
        rows = []
        if len(got):
            queries, ids = unit_rows(_matrix(got.to_batches()[0])), got.column("rep").to_numpy()
            if not whole:
                fresh = ~np.isin(ids, fitted)
                queries, ids = queries[fresh], ids[fresh]
            ranks = classes.select("rep", "vector").mapInArrow(_link_ranks(index, queries, ids, cosine), "probe long, least long, rank long, n long")
            rows = ranks.groupBy("probe").agg(F.min("least").alias("least"), F.max("rank").alias("rank"), F.sum("n").alias("n")).collect()
        groups, links = len({r["least"] for r in rows}), sum(r["n"] for r in rows)
        if whole or groups >= 3 / (1 - target):
            return max(LEAST_CELLS, int((max((r["rank"] for r in rows), default=0) + 1) * 1.25) + 1), groups, links
        if count >= most:
            return None, groups, links
        count = min(4 * count, most)


def _meetings(placed: DataFrame, block_rows: int) -> DataFrame:
    """Vectors and the visitors of their cells, in blocks of bounded size.

    A cell without a vector of its own drops its visitors in the join with the plan.
    """
    own = placed.groupBy("cell").agg(F.count("*").alias("rows"))
    visit = placed.select("rep", "copies", "vector", "cell", F.explode("visited").alias("cell_at"))
    load = placed.select(F.explode("visited").alias("cell_at")).groupBy("cell_at").agg(F.count("*").alias("guests"))
    plan = own.withColumnRenamed("cell", "cell_at").join(load, "cell_at").select(
        "cell_at", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("guests") / BLOCK_VISITORS).cast("int").alias("turns")
    )
    plan = materialised(plan)
    mine = placed.withColumnRenamed("cell", "cell_at").join(plan, "cell_at").select(
        "cell_at",
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"),
        F.lit(0).alias("visitor"), "rep", "copies", "vector", F.col("cell_at").alias("cell"),
    )
    theirs = visit.join(plan, "cell_at").select(
        "cell_at",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("rep"), F.col("turns")).cast("int").alias("turn"),
        F.lit(1).alias("visitor"), "rep", "copies", "vector", "cell",
    )
    return mine.union(theirs)
