"""Joins with the k nearest rows: exact by cells and bounds, or by random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewatch.session import write_scratch

#: Rows a cell should have, rows on each side of a block that is compared at once, and the most pivots (what tasks hold: pivots x dimensions x 8 bytes).
CELL_ROWS, BLOCK_ROWS, PIVOTS = 1_000, 2_000, 1 << 16
TABLES, LSH_SAMPLE = 16, 512
#: Other cells that a row is sent to by itself; rows that meet more of them are compared block by block, without being written again.
SENT_CELLS = 8
#: Distances that are held at once; bytes of a packed block, of the left and right files of blocks, and of the right blocks that a task holds.
PAIRS, BLOCK_BYTES, FILE_BYTES, TASK_BYTES = 1 << 19, 1 << 22, 1 << 25, 1 << 26


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension to stay within one block."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the row of ``b`` beside it, summed as by ``distances``."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += (a[:, i] - b[:, i]) ** 2
    return np.sqrt(out)


def about(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and for each row of ``a`` more than they can be wrong. NaN where squares overflow."""
    with np.errstate(all="ignore"):
        left, right = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        # the squares are columns of the product
        out = np.column_stack([a, left, np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), right]).T
        return out, 4 * (a.shape[1] + 8) * np.finfo(float).eps * (left + right.max(initial=0))


def between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, from below and from above, of all distances."""
    square, wrong = about(a, b)
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(square - wrong[:, None], 0)), np.sqrt(square + wrong[:, None])


def closest_of(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The number of the nearest pivot of each vector, or of one as near but for rounding."""
    out, step = np.zeros(len(v), np.int64), max(1, PAIRS // len(pivots))
    for i in range(0, len(v), step):
        out[i:i + step] = about(v[i:i + step], pivots)[0].argmin(axis=1)
    return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float, copy=False)


class Nearest:
    """The ``need`` nearest others of each row of ``v`` so far, ties by key; none beyond the distance ``most`` is kept."""

    def __init__(self, v: np.ndarray, most: np.ndarray, need: int):
        self.v, self.most, self.need = v, most, need
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def meet(self, rows: np.ndarray, w: np.ndarray, others: np.ndarray) -> None:
        """Compare some rows with all vectors ``w``: products leave out what is surely too far, the rest is summed exactly."""
        step = max(1, PAIRS // len(w))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            a = self.v[some]
            square, wrong = about(a, w)
            with np.errstate(all="ignore"):
                limit = self.most[some] ** 2 * (1 + 1e-15) + wrong
            near = np.flatnonzero(~(square > limit[:, None]))
            crowd = np.flatnonzero(np.bincount(near // len(w), minlength=len(some)) > 4 * self.need)
            if len(crowd):
                kth = np.partition(square[crowd], self.need - 1, axis=1)[:, self.need - 1]
                limit[crowd] = np.fmin(limit[crowd], kth + 2 * wrong[crowd])
                near = np.flatnonzero(~(square > limit[:, None]))
            r, c = near // len(w), near % len(w)
            for j in range(0, len(r), PAIRS // 64):
                at, to = r[j:j + PAIRS // 64], c[j:j + PAIRS // 64]
                with np.errstate(all="ignore"):
                    d = beside(a[at], w[to])
                within = ~(d > self.most[some[at]])
                self.kept.append((some[at[within]], d[within], others[to[within]]))
                self.fresh += int(within.sum())
                if self.fresh > PAIRS:
                    self.merge()

    def merge(self) -> None:
        if not self.fresh:
            return
        row, d, other = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((pd.factorize(other, sort=True)[0] if other.dtype == object else other, d, row))
        row, d, other = row[order], d[order], other[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.need - 1
        self.most[row[last]] = np.fmin(self.most[row[last]], d[last])
        keep = place < self.need
        self.kept, self.fresh = [(row[keep], d[keep], other[keep])], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """``(row, distance, other)``, if there are any."""
        self.merge()
        return self.kept[0] if self.kept else None


def _numbers(df: DataFrame, vector: str) -> str:
    """Vectors stay floats if they are; they are compared as doubles."""
    kind = df.schema[vector].dataType
    return "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"


def _named(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """``(id, c, key, v)``: rows with equal vectors are one point, named by the first key; only the first (``c`` 1) holds the vector.

    Rows with an incomplete vector have no place.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(vector).cast(_numbers(df, vector)).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    equal = Window.partitionBy("v").orderBy("id")
    placed = rows.withColumn("c", F.row_number().over(equal)).withColumn("key", F.first("id").over(equal))
    return write_scratch(placed.select("id", "c", "key", F.when(F.col("c") == 1, F.col("v")).alias("v")))


class Cells:
    """Pivots in two levels: every pivot belongs to the nearest of a few coarse ones, so a row looks at two short lists."""

    def __init__(self, pivots: np.ndarray, group: np.ndarray | None = None):
        self.pivots = pivots
        self.coarse = pivots[:math.ceil(math.sqrt(len(pivots)))]
        self.group = distances(pivots, self.coarse).argmin(axis=1) if group is None else group
        self.members = [np.flatnonzero(self.group == g) for g in range(len(self.coarse))]
        #: Rows, nearest and farthest reach of every cell; radius of every coarse group.
        self.count = self.near = self.far = self.radius = np.zeros(0)

    def measured(self, stats: pd.DataFrame) -> None:
        self.count, self.near, self.far = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        at = stats["cell"].to_numpy(np.int64)
        self.count[at], self.near[at], self.far[at] = stats["n"], stats["near"], stats["far"]
        to_coarse = [distances(self.pivots[m], self.coarse[g:g + 1])[:, 0] for g, m in enumerate(self.members)]
        self.radius = np.array([(d + self.far[m]).max(initial=-np.inf) for d, m in zip(to_coarse, self.members, strict=True)])

    def plain(self) -> tuple[np.ndarray, ...]:
        """Arrays that tasks can read without this package."""
        return self.pivots, self.group, self.count, self.near, self.far, self.radius

    @staticmethod
    def of(shared: Broadcast) -> Cells:
        pivots, group, *stats = shared.value
        out = Cells(pivots, group)
        out.count, out.near, out.far, out.radius = stats
        return out

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and the distance to its pivot."""
        group = closest_of(v, self.coarse)
        cell = np.zeros(len(v), np.int32)
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            if len(self.members[g]):
                cell[rows] = self.members[g][closest_of(v[rows], self.pivots[self.members[g]])]
        return cell, beside(v, self.pivots[cell])

    def surely_within(self, v: np.ndarray, need: int) -> np.ndarray:
        """A distance within which each vector has ``need`` rows for certain: whole cells, from the nearest on, until they hold enough."""
        out = np.full(len(v), np.inf)
        if self.count.sum() < need:
            return out
        step = max(1, PAIRS // len(self.pivots))
        for i in range(0, len(v), step):
            far = distances(v[i:i + step], self.pivots) + np.where(self.count > 0, self.far, np.inf)
            order = np.argsort(far, axis=1)
            enough = np.cumsum(self.count[order], axis=1) >= need
            out[i:i + step] = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough.argmax(axis=1)]
        return out

    def areas(self, v: np.ndarray, ball: np.ndarray) -> np.ndarray:
        """``v`` by coarse groups: whether a group may hold a row within a vector's ball."""
        return ~(between(v, self.coarse)[0] - self.radius > (ball + _slack(ball))[:, None])

    def meets(self, v: np.ndarray, ball: np.ndarray, some: np.ndarray) -> np.ndarray:
        """``v`` by ``some`` cells: whether a cell may hold a row within a vector's ball."""
        least, most = between(v, self.pivots[some])
        least = np.maximum(least - self.far[some], self.near[some] - most)
        return ~(least > (ball + _slack(ball))[:, None]) & (self.count[some] > 0)

    def met(self, v: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of all cells that may hold a row within each vector's ball."""
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        to_area = self.areas(v, ball)
        for g, members in enumerate(self.members):
            some = np.flatnonzero(to_area[:, g])
            if not len(some) or not len(members):
                continue
            r, c = np.nonzero(self.meets(v[some], ball[some], members))
            rows.append(some[r])
            cells.append(members[c])
        return np.concatenate(rows), np.concatenate(cells)


def _slack(ball: np.ndarray) -> np.ndarray:
    return 1e-9 * (1 + np.where(np.isinf(ball), 0, ball))


def _assigned(df: DataFrame, cells: Broadcast) -> DataFrame:
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("area", T.IntegerType()), T.StructField("reach", T.DoubleType())])

    @F.pandas_udf(schema)
    def assign(vectors: pd.Series) -> pd.DataFrame:
        known = Cells.of(cells)
        cell, reach = known.assign(matrix(vectors))
        return pd.DataFrame({"cell": cell, "area": known.group[cell], "reach": reach})

    return df.withColumn("a", assign("v")).select(*df.columns, "a.cell", "a.area", "a.reach")


def _meet(lefts: DataFrame, rights: DataFrame, need: int, block_rows: int) -> DataFrame:
    """``(key, other, distance)``: the ``need`` nearest of each block of right rows, for left rows (target, key, v) and right rows (target, other, w).

    Both sides of a target are dealt over blocks by hash, so a target with a third of all rows is many tasks.
    """
    # written, so that Spark knows its size and need not shuffle vectors to it
    sizes = write_scratch(lefts.groupBy("target").agg((F.floor((F.count(F.lit(1)) - 1) / block_rows) + 1).alias("l_parts")).join(
        rights.groupBy("target").agg((F.floor((F.count(F.lit(1)) - 1) / block_rows) + 1).alias("r_parts")), "target"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    l_blocks = lefts.join(sizes, "target").select("target", part("key", "l_parts").alias("l"), spread("r_parts").alias("r"), "key", "v")
    r_blocks = rights.join(sizes, "target").select("target", part("other", "r_parts").alias("r"), spread("l_parts").alias("l"), "other", "w")
    kind = lefts.schema["key"].dataType.simpleString()

    def closest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"key": a["key"][:0], "other": b["other"][:0], "distance": np.zeros(0)})
        near = Nearest(matrix(a["v"]), np.full(len(a), np.inf), need)
        near.meet(np.arange(len(a)), matrix(b["w"]), b["other"].to_numpy())
        row, d, other = near.found()
        return pd.DataFrame({"key": a["key"].to_numpy()[row], "other": other, "distance": d})

    return l_blocks.groupBy("target", "l", "r").cogroup(r_blocks.groupBy("target", "l", "r")).applyInPandas(
        closest, f"key {kind}, other {rights.schema['other'].dataType.simpleString()}, distance double")


def _first(pairs: DataFrame, need: int) -> DataFrame:
    best = Window.partitionBy("key").orderBy("distance", "other")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= need).drop("place")


def _pivots(rights: DataFrame, n: int, cell_rows: int) -> np.ndarray:
    """About one vector for each ``cell_rows`` distinct ones, at most ``PIVOTS`` of them, by a hash of the vector."""
    wanted = min(PIVOTS, math.ceil(n / cell_rows))
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * wanted / n))
    rows = rights.where(share).select("v").limit(2 * wanted + 64).collect() if wanted > 1 else []
    return np.array(sorted(r.v for r in rows) or [rights.first().v])


def _exact(lefts: DataFrame, rights: DataFrame, n: int, need: int, cell_rows: int, block_rows: int) -> DataFrame:
    sc = lefts.sparkSession.sparkContext
    cells = Cells(np.random.default_rng(5).permutation(_pivots(rights, n, cell_rows)))
    plain = sc.broadcast(cells.plain())
    placed = write_scratch(_assigned(rights.select(F.col("key").alias("other"), F.col("v").alias("w"), "v"), plain).drop("v"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far")).toPandas()
    cells.measured(stats)
    shared = sc.broadcast(cells.plain())
    targets = placed.select(F.col("cell").alias("target"), "other", "w")
    own = placed.select(F.col("other").alias("key"), F.col("w").alias("v"), "cell", "area") if lefts is rights else write_scratch(_assigned(lefts, plain).drop("reach"))
    # first round: the k-th distance inside a row's own cell
    inside = write_scratch(_meet(own.withColumnRenamed("cell", "target"), targets, need, block_rows))
    ball = _first(inside, need).groupBy("key").agg(F.when(F.count(F.lit(1)) >= need, F.max("distance")).alias("ball"))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = Cells.of(shared)
        step = max(1, min(BLOCK_ROWS, PAIRS // len(cells.pivots)))
        for batch in batches:
            for i in range(0, len(batch), step):
                some = batch.iloc[i:i + step]
                v = matrix(some["v"])
                within = some["ball"].to_numpy(float, copy=True)
                short = np.isnan(within)
                sure = cells.surely_within(v[short], need)
                within[short] = sure + _slack(sure)
                row, cell = cells.met(v, within)
                other = cell != some["cell"].to_numpy()[row]
                row, cell = row[other], cell[other]
                sent = np.bincount(row, minlength=len(some)) <= SENT_CELLS
                row, cell = np.concatenate([row[sent[row]], np.flatnonzero(~sent)]), np.concatenate([cell[sent[row]], np.full((~sent).sum(), -1)])
                yield some.iloc[row][["key", "v", "cell", "area"]].assign(ball=within[row], target=cell.astype(np.int32))

    # second round: to the cells that the ball of that distance meets; rows that meet many (target -1) are compared in blocks
    kind = own.schema["key"].dataType.simpleString()
    routed = write_scratch(own.join(ball, "key", "left").mapInPandas(
        reached, f"key {kind}, v {own.schema['v'].dataType.simpleString()}, cell int, area int, ball double, target int"))
    sent, spread = routed.where("target >= 0").select("target", "key", "v"), routed.where("target < 0").drop("target")
    found = inside.unionByName(_meet(sent, targets, need, block_rows))
    some = spread.count()
    return found.unionByName(_scan(spread, some, placed, n, shared, need)) if some else found


def _packed(df: DataFrame, n: int, key: str, vector: str, shared: Broadcast) -> DataFrame:
    """``(block, keys, vectors, cells, balls, areas)``: rows in the order of their cells, many to a row.

    ``areas`` are the coarse groups that the rows with a ball may meet, or those that the rows without lie in.
    """
    item = df.schema[vector].dataType
    size, dims = (4 if isinstance(item.elementType, T.FloatType) else 8), shared.value[0].shape[1]
    rows = max(1, min(8 * CELL_ROWS, BLOCK_BYTES // (8 * dims)))
    has_ball = "ball" in df.columns
    files = max((4 if has_ball else 1) * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * size * dims / FILE_BYTES))

    def block(number: int, held: pa.Table, cells: Cells) -> pa.RecordBatch:
        keys, cell = held[key].combine_chunks(), held["cell"].to_numpy().astype(np.int32)
        v = held[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1)
        ball = held["ball"].to_numpy() if has_ball else np.zeros(0)
        if has_ball:
            wide, areas = v.astype(float), set()
            step = max(1, PAIRS // len(cells.coarse))
            for i in range(0, len(v), step):
                areas |= set(np.flatnonzero(cells.areas(wide[i:i + step], ball[i:i + step]).any(axis=0)).tolist())
        else:
            areas = set(held["area"].to_numpy().tolist())
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([v.tobytes()], pa.binary()),
            pa.array([cell.tobytes()], pa.binary()), pa.array([ball.tobytes()], pa.binary()), pa.array([sorted(areas)], pa.list_(pa.int32())),
        ], names=["block", "keys", "vectors", "cells", "balls", "areas"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, number = Cells.of(shared), None, TaskContext.get().partitionId() << 32
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]) if held is not None else more
            while len(held) >= rows:
                yield block(number, held[:rows], cells)
                held, number = held[rows:], number + 1
        if held is not None and len(held):
            yield block(number, held, cells)

    kind = df.schema[key].dataType.simpleString()
    order = ["area", "cell", F.xxhash64(key)]
    return write_scratch(df.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(
        pack, f"block long, keys array<{kind}>, vectors binary, cells binary, balls binary, areas array<int>"))


def _scan(spread: DataFrame, some: int, placed: DataFrame, n: int, shared: Broadcast, need: int) -> DataFrame:
    """``(key, other, distance)``: the ``need`` nearest in other cells, of rows whose balls meet many of them.

    A task takes some left and some right blocks as they lie; no row is shuffled again. Blocks whose coarse groups do not meet are not
    paired, cells that no ball of a block meets are not compared, and balls shrink on the way.
    """
    lefts = _packed(spread, some, "key", "v", shared)
    rights = _packed(placed, n, "other", "w", shared).select(
        F.col("keys").alias("others"), F.col("vectors").alias("r_vectors"), F.col("cells").alias("r_cells"), F.col("areas").alias("r_areas"))
    wide = lambda df, c: np.dtype(np.float32 if isinstance(df.schema[c].dataType.elementType, T.FloatType) else np.float64)
    left_kind, right_kind = wide(spread, "v"), wide(placed, "w")
    rights = rights.coalesce(math.ceil(n * right_kind.itemsize * shared.value[0].shape[1] / TASK_BYTES))

    def table(near: Nearest, keys: pa.Array, other_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if (found := near.found()) is not None:
            row, d, other = found
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(other, other_type), pa.array(d)], names=["key", "other", "distance"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, block, near = Cells.of(shared), None, None
        for batch in batches:
            raw = lambda c, i, kind, batch=batch: np.frombuffer(batch[c][i].as_buffer(), kind)
            other_type = batch.schema.field("others").type.value_type
            for i in range(batch.num_rows):
                if (now := batch["block"][i].as_py()) != block:
                    if near is not None:
                        yield from table(near, keys, other_type)
                    # copies, since the batch goes
                    block, keys, own = now, pa.concat_arrays([batch["keys"][i].values]), raw("cells", i, np.int32).copy()
                    near = Nearest(raw("vectors", i, left_kind).reshape(len(own), -1).astype(float), raw("balls", i, float).copy(), need)
                others, at = batch["others"][i].values.to_numpy(zero_copy_only=False), raw("r_cells", i, np.int32)
                w = raw("r_vectors", i, right_kind).reshape(len(at), -1).astype(float)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                met = cells.meets(near.v, near.most, at[first]) & (own[:, None] != at[first])
                for k, (begin, end) in enumerate(zip(first, [*first[1:], len(at)], strict=True)):
                    if len(rows := np.flatnonzero(met[:, k])):
                        near.meet(rows, w[begin:end], others[begin:end])
                near.merge()
        if near is not None:
            yield from table(near, keys, other_type)

    pairs = lefts.join(rights.hint("shuffle_replicate_nl"), F.arrays_overlap("areas", "r_areas"))
    return pairs.select("block", "keys", "vectors", "cells", "balls", "others", "r_vectors", "r_cells").mapInArrow(
        scan, f"key {spread.schema['key'].dataType.simpleString()}, other {placed.schema['other'].dataType.simpleString()}, distance double")


def _approximate(lefts: DataFrame, rights: DataFrame, n: int, need: int, cell_rows: int, block_rows: int, tables: int, width: float | None) -> DataFrame:
    sample = np.array([r.v for r in rights.orderBy(F.xxhash64("v")).limit(LSH_SAMPLE).select("v").collect()])
    rng = np.random.default_rng(17)
    if width is None:
        # distances to the k-th row shrink as rows get more; the sample's nearest distance is an upper bound for them
        d = distances(sample, sample) + np.diag(np.full(len(sample), np.inf))
        near = d.min(axis=1)
        width = 2 * float(np.median(near[np.isfinite(near)])) if np.isfinite(near).any() else 1.0
    width = width or 1.0
    # projections by the number of rows: the fewest that leave about ``cell_rows`` rows of the sample's spread in a bucket
    count = 1
    directions = rng.normal(size=(tables, 24, sample.shape[1]))
    shift = rng.random((tables, 24)) * width
    while count < 24:
        code = np.floor((sample @ directions[0, :count].T + shift[0, :count]) / width)
        _, sizes = np.unique(code, axis=0, return_counts=True)
        if n * float((sizes ** 2).sum()) / len(sample) ** 2 <= cell_rows:
            break
        count += 1
    shared = lefts.sparkSession.sparkContext.broadcast((directions[:, :count], shift[:, :count], width))

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        way, start, wide = shared.value
        v = matrix(vectors)
        out = np.zeros((len(v), len(way)), np.uint64)
        for t in range(len(way)):
            cell = np.floor((v @ way[t].T + start[t]) / wide).astype(np.int64).view(np.uint64)
            key = np.full(len(v), t + 1, np.uint64)
            for c in range(cell.shape[1]):
                key = (key ^ cell[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t] = key
        return pd.Series(list(out.view(np.int64)))

    put = lambda df: df.withColumn("target", F.explode(codes("v")))
    found = _meet(put(lefts), put(rights.select(F.col("key").alias("other"), "v")).withColumnRenamed("v", "w"), need, block_rows)
    return found.groupBy("key", "other").agg(F.min("distance").alias("distance"))


def knn_join(
    left: DataFrame, right: DataFrame, row_id: str, vector: str, k: int, exclude_self: bool = True, method: str = "exact",
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, tables: int = TABLES, width: float | None = None,
) -> DataFrame:
    """``(row_id, neighbour, distance, rank)``: the k nearest rows of ``right`` for each row of ``left``, ties by row key.

    Equal vectors are one point on both sides. ``method='exact'``: points belong to the nearest of pivots that grow with the
    table; each left point first meets its own cell, and its k-th distance there decides which other cells its ball meets. In
    clustered data these are few; in high dimensions without structure they are nearly all, and the join compares block with block.
    ``method='lsh'``: points that share a bucket of any of ``tables`` random projections are compared; ``recall`` measures what
    that misses. More projections are taken as the table grows, so buckets do not.

    Rows without key or with an incomplete vector have no neighbours and are none. Keys may be of any type that can be ordered.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"no method called {method!r}")
    need = k + 1 if exclude_self else k
    right_rows = _named(right, row_id, vector)
    left_rows = right_rows if left is right else _named(left, row_id, vector)
    rights = right_rows.where("c = 1").select("key", "v")
    lefts = rights if left is right else left_rows.where("c = 1").select("key", "v")
    n = rights.count()
    kind, other = left.schema[row_id].dataType.simpleString(), right.schema[row_id].dataType.simpleString()
    if n == 0:
        return left.sparkSession.createDataFrame([], f"`{row_id}` {kind}, neighbour {other}, distance double, rank int")
    found = _exact(lefts, rights, n, need, cell_rows, block_rows) if method == "exact" else _approximate(
        lefts, rights, n, need, cell_rows, block_rows, tables, width)
    # back from points to rows
    ids = right_rows.where(F.col("c") <= need).groupBy(F.col("key").alias("other")).agg(F.collect_list("id").alias("ids"))
    near = _first(found, need).join(ids, "other").select("key", "distance", F.explode("ids").alias("other"))
    lists = _first(near, need).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("other").alias("neighbour")))).alias("near"))
    rows = left_rows.select("id", "key").join(lists, "key")
    kept = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")) if exclude_self else F.col("near"), 1, k)
    return rows.select("id", kept.alias("kept")).select("id", F.posexplode("kept").alias("p", "x")).select(
        F.col("id").alias(row_id), "x.neighbour", "x.distance", (F.col("p") + 1).alias("rank"))


def recall(left: DataFrame, right: DataFrame, row_id: str, vector: str, k: int, share: float = 0.01, **approximate) -> DataFrame:
    """``(n_wanted, n_found, recall)`` of ``method='lsh'`` for a hash sample of left rows, against the exact neighbours among all right rows.

    A neighbour counts as found if it comes back, or one as near in its place.
    """
    some = left.where(F.pmod(F.xxhash64(row_id), F.lit(1_000_000)) < F.lit(round(1_000_000 * share)))
    exact = knn_join(some, right, row_id, vector, k)
    found = knn_join(some, right, row_id, vector, k, method="lsh", **approximate)
    reach = exact.groupBy(row_id).agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("wanted"))
    hits = found.join(reach, row_id).where("distance <= reach").groupBy(row_id).agg(F.count(F.lit(1)).alias("hit"))
    out = reach.join(hits, row_id, "left").agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("n_wanted"), F.coalesce(F.sum(F.least("hit", "wanted")), F.lit(0)).alias("n_found"))
    return out.withColumn("recall", F.when(F.col("n_wanted") > 0, F.col("n_found") / F.col("n_wanted")))
