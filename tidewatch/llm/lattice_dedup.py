"""Near-duplicate vectors by lattice hashing.

In each of ``TABLES`` tables a vector is projected to ``BLOCKS`` random subspaces of eight dimensions and each projection is
decoded to the nearest point of the E8 lattice; together the points name a cell. A vector also probes neighbouring cells: those
in which one block's point is replaced by the next nearest found. Two vectors meet in a table where one's own cell is among
the cells of the other. Pairs that meet are verified by cosine in double precision.

A pair counts in the first table and cell in which it meets, which both members know, so pairs are counted once without being
written. Cells with many members are cut into blocks and worked on block by block; what leaves a task are counts per vector and the
links of a spanning forest. Equal vectors are one node with a weight. Only the choice of projections is random (seeded); no cell
is left out or cut short.

Defined results: vectors that are null, empty, zero or hold null, infinite or undefined components are linked with nothing and kept; vectors
of different lengths are never linked; rows that repeat an id are vectors of their own with that id; rows without an id count as partners
and come back without component; an empty table gives no rows; further columns (labels) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import checkpointed, map_batches, mix64, salted_join, table
from tidewatch.llm.graph import components
from tidewatch.llm.registry import query

COSINE = 0.9
TABLES, BLOCKS, SCALE, SEED = 10, 2, 3.9, 20240601
#: Members of a cell that are compared at once.
BLOCK_ROWS = 512


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of eight numbers, the nearest lattice point (doubled, so whole numbers) and the next of four candidates.

    E8 is the union of D8 (whole numbers with an even sum) and D8 shifted by one half. A whole point with an odd sum becomes one of
    D8 by moving the coordinate with the largest rounding error the other way; moving two coordinates gives a neighbour.
    """
    points, gaps = [], []
    for shift in (0.0, 0.5):
        moved = x - shift
        near = np.rint(moved)
        error = moved - near
        order = np.argsort(-np.abs(error), axis=1)
        step = np.where(error >= 0, 1.0, -1.0)
        odd = (near.sum(axis=1) % 2) != 0
        rows = np.arange(len(x))
        first, second = order[:, 0], order[:, 1]
        best = near.copy()
        best[rows[odd], first[odd]] += step[rows[odd], first[odd]]
        # the neighbour: for odd sums the second coordinate moves instead, for even sums both
        other = near.copy()
        other[rows, second] += step[rows, second]
        even = ~odd
        other[rows[even], first[even]] += step[rows[even], first[even]]
        for p in (best, other):
            points.append(2 * (p + shift))
            gaps.append(((moved - p) ** 2).sum(axis=1))
    stacked, gap = np.stack(points, 1), np.stack(gaps, 1)
    order = np.argsort(gap, axis=1, kind="stable")
    rows = np.arange(len(x))
    return stacked[rows, order[:, 0]].astype(np.int64), stacked[rows, order[:, 1]].astype(np.int64)


def projections(length: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    """Orthonormal rows (for as many as the length has) per table and block, scaled so that distances keep their mean."""
    random = np.random.default_rng([seed, length])
    out = np.empty((tables, blocks, 8, length))
    for t in range(tables):
        basis = [np.linalg.qr(random.standard_normal((length, length)))[0] for _ in range(-(-blocks * 8 // length))]
        rows = np.concatenate(basis)[:blocks * 8]
        out[t] = rows.reshape(blocks, 8, length)
    return out * np.sqrt(length / 8)


def cells_of(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cells of unit vectors, rows x tables x (1 + blocks); the first of each table is the vector's own."""
    n, length = unit.shape
    maps = projections(length, tables, blocks, seed)
    out = np.empty((n, tables, 1 + blocks), np.uint64)
    weights = mix64(np.arange(1, 9, dtype=np.uint64))
    for t in range(tables):
        codes = []
        for b in range(blocks):
            for point in nearest_e8(scale / np.sqrt(8) * (unit @ maps[t, b].T)):
                codes.append(mix64((point.view(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + np.uint64(b + 1)))
        salt = mix64(np.array([t + 1], np.uint64))[0]
        own = [codes[2 * b] for b in range(blocks)]
        for probe in range(1 + blocks):
            parts = [codes[2 * b + 1] if probe == b + 1 else own[b] for b in range(blocks)]
            value = np.full(n, salt, np.uint64)
            for part in parts:
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + part)
            out[:, t, probe] = value
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = {len(v) for v in column}
    out = np.zeros((len(column), max(sizes, default=0)))
    for row, v in zip(out, column, strict=True):
        row[:len(v)] = v
    return out


def vector_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the 128-bit key of their vector (null if it cannot be linked), and one node per key: (node, weight, vector).

    A node's number is a hash of its key, not an id: ids may repeat.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    keyed = rows.select("vec_id", vector.alias("vector")).select(
        "vec_id", "vector", F.coalesce(usable, F.lit(False)).alias("usable")).select(
        "vec_id", "vector", F.when(F.col("usable"), F.xxhash64("vector")).alias("k1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(1), "vector")).alias("k2"))
    nodes = keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    return keyed.select("vec_id", "k1", "k2"), nodes.withColumn("node", F.xxhash64("k1", "k2"))


def linked(nodes: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Rows (a, b, n): either n partners of node a in one block (b null), or a link (a, b) of a block's spanning forest."""
    width = 1 + blocks

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["vector"].map(len), sort=True):
                x = _matrix(part["vector"])
                # the largest component is taken out first, so squares neither vanish nor overflow
                x /= np.abs(x).max(axis=1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                cells = cells_of(x, tables, blocks, scale, seed) ^ mix64(np.array([length], np.uint64))
                flat = cells.reshape(len(part), -1).view(np.int64)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "weight": part["weight"].to_numpy(), "unit": list(x), "codes": list(flat)})

    coded = checkpointed(map_batches(nodes.select("node", "weight", "vector"), code, "node long, weight long, unit array<double>, codes array<long>"))
    entries = coded.select("node", F.posexplode("codes").alias("_at", "cell")).select(
        "node", "cell", (F.floor(F.col("_at") / width)).cast("int").alias("t"), (F.col("_at") % width == 0).alias("own"))
    # cells where somebody is at home and somebody else is found
    sizes = entries.groupBy("t", "cell").agg(F.count("*").alias("held"), F.max("own").alias("home")).where("held > 1 AND home")
    sizes = sizes.select("t", "cell", F.ceil(F.col("held") / BLOCK_ROWS).cast("int").alias("parts"))
    found = salted_join(entries, sizes, ["t", "cell"], F.col("node"), "inner")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")
    units = found.withColumn("part", part).select("node", "t", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("node", "t", "cell", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    work = units.join(coded, "node").repartition("t", "cell", "p", "q").sortWithinPartitions("t", "cell", "p", "q", "part")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = batch[["t", "cell", "p", "q"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(cut) == 0:
                rest = batch
                continue
            # the last unit may go on in the next batch
            yield _compared(batch.iloc[:cut[-1]], np.concatenate([[0], cut]), tables, width, cosine)
            rest = batch.iloc[cut[-1]:]
        if rest is not None and len(rest):
            key = rest[["t", "cell", "p", "q"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            yield _compared(rest, np.concatenate([[0], cut, [len(rest)]]), tables, width, cosine)

    return map_batches(work, compare, "a long, b long, n long")


def _compared(rows: pd.DataFrame, bounds: np.ndarray, tables: int, width: int, cosine: float) -> pd.DataFrame:
    unit, codes = _matrix(rows["unit"]), np.array(rows["codes"].tolist(), np.int64).reshape(len(rows), tables, width)
    node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
    t, cell, part = rows["t"].to_numpy(), rows["cell"].to_numpy(), rows["part"].to_numpy()
    p, q = rows["p"].to_numpy(), rows["q"].to_numpy()
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    links: list[tuple[int, int]] = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if p[a] == q[a]:
            left = right = slice(a, b)
            i, j = np.nonzero(np.triu(unit[left] @ unit[right].T >= cosine, 1))
            i, j = i + a, j + a
        else:
            # the unit's rows are sorted by part
            middle = a + int(np.searchsorted(part[a:b], q[a]))
            i, j = np.nonzero(unit[a:middle] @ unit[middle:b].T >= cosine)
            i, j = i + a, j + middle
        if not len(i):
            continue
        x, y = codes[i, :t[a] + 1], codes[j, :t[a] + 1]
        at_x, at_y = (x[:, :, :1] == y).any(axis=2), (y[:, :, :1] == x).any(axis=2)
        meets = at_x | at_y
        # the first cell of this table in which they meet
        big = np.iinfo(np.int64).max
        first = np.minimum(np.where(at_x[:, -1], x[:, -1, 0], big), np.where(at_y[:, -1], y[:, -1, 0], big))
        own = ~meets[:, :-1].any(axis=1) & meets[:, -1] & (first == cell[a])
        i, j = i[own], j[own]
        if not len(i):
            continue
        counts += [(node[i], weight[j]), (node[j], weight[i])]
        links += _forest(node[i], node[j])
    if not counts:
        return pd.DataFrame({"a": [], "b": pd.array([], "Int64"), "n": []}).astype({"a": "int64", "n": "int64"})
    who, n = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
    names, back = np.unique(who, return_inverse=True)
    total = np.bincount(back, weights=n).astype(np.int64)
    return pd.DataFrame({
        "a": np.concatenate([names, np.array([x for x, _ in links], np.int64)]),
        "b": pd.array([None] * len(names) + [y for _, y in links], "Int64"),
        "n": np.concatenate([total, np.zeros(len(links), np.int64)])})


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the given ones."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            top[rx] = ry
            out.append((x, y))
    return out


def near_duplicates(rows: DataFrame, **settings) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``rows`` (vec_id, embedding)."""
    keyed, nodes = vector_nodes(rows)
    nodes = checkpointed(nodes)
    found = checkpointed(linked(nodes, **settings))
    partners = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("partners"))
    comp = components(found.where("b IS NOT NULL").select("a", "b"))
    whole = nodes.select("k1", "k2", "node", "weight", "least").join(partners, "node", "left").join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    # vectors that are alone need no row here
    of_key = salted_join(whole.where("weight > 1 OR partners > 0"), least, ["component"], F.col("node")).select(
        "k1", "k2", (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "component_id")
    out = salted_join(keyed, of_key, ["k1", "k2"], F.col("vec_id")).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query("op7_lattice_dedup")
def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, whatever its label."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
