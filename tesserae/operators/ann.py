"""An index for nearest neighbours by cosine: a coarse quantiser and lists of vectors by cell.

The quantiser is fitted to a bounded sample (spherical k-means); every vector belongs to the cell of its nearest centroid, and lists
are partitions of a table by cell, so a search reads only the cells that it probes. How many it must probe for a given recall is measured on
the sample and kept with the centroids.

``batch`` searches many queries in the cells that each probes; ``join`` is exact: a query is first met with its own cell, which gives a bound
for its k-th neighbour, and then goes only to cells that can hold nearer vectors, by their angle to the centroid and the largest
angle in the cell. Cells with very many vectors are dealt to parts, and a part is what a task holds.

Vectors that are null, empty, zero or not finite have no cell (null) and aren't found; ``join`` gives zero vectors the score 0 as the plain search does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import vectors
from tesserae.operators import scratch

#: Sampled vectors (or numbers in them, if that is less), cells at most, sampled queries that the probes are measured on, vectors of a part.
SAMPLE, SAMPLE_NUMBERS, MOST_CELLS, ASKED, PART = 20_000, 2_000_000, 4096, 256, 8192


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 1)


@dataclass(frozen=True)
class Quantiser:
    """Unit centroids; ``ranks``: of the sampled queries' neighbours, sorted, the place of their cell in the query's order of cells."""

    centroids: np.ndarray
    ranks: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, column: str = "embedding", cells: int | None = None, k: int = 10, steps: int = 10, seed: int = 1) -> Quantiser:
        """From a sample of the vectors that can be searched; about the square root of their number of cells."""
        good = rows.select(F.col(column).cast("array<double>").alias("v")).where(vectors.problem(F.col("v")).isNull())
        shape = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(2).collect()
        if not shape:
            raise ValueError("no vector to fit an index to")
        if len(shape) > 1:
            raise ValueError("vectors of an index must have one length")
        dim, n = shape[0]["d"], shape[0]["n"]
        most = min(SAMPLE, max(1000, SAMPLE_NUMBERS // dim))
        drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, most / n)))
        taken = (good if n <= most else good.where(drawn).limit(2 * most)).toArrow()
        x = _unit(_matrix(taken["v"]))
        x = x[np.lexsort(x.T)]  # the same sample gives the same cells, in whatever order it came
        cells = max(1, min(cells or round(n**0.5), MOST_CELLS, len(x) // 4 or 1))
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), cells, replace=False)]
        for _ in range(steps):
            own = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            empty = np.bincount(own, minlength=cells) == 0
            total[empty] = x[rng.choice(len(x), int(empty.sum()))]
            c = _unit(total)
        return cls(c, cls._measure(x, c, k, rng))

    @staticmethod
    def _measure(x: np.ndarray, c: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        if len(x) < 2:
            return np.zeros(1, np.int64)
        asked = rng.choice(len(x), min(ASKED, len(x)), replace=False)
        own = (x @ c.T).argmax(1)
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        found = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        order = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1, kind="stable"), axis=1)
        return np.sort(np.take_along_axis(order, own[found], 1).ravel())

    def probes(self, recall: float = 0.95) -> int:
        """Cells to probe so that this share of the sampled neighbours is found."""
        return int(self.ranks[min(len(self.ranks) - 1, int(np.ceil(recall * len(self.ranks))) - 1)]) + 1

    def cells_of(self, vector: list[float], probes: int) -> list[int]:
        u = _unit(np.asarray(vector, np.float64)[None])
        return np.argsort(-(u @ self.centroids.T)[0], kind="stable")[:probes].tolist()

    def dumps(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "ranks": self.ranks.tolist()})

    @classmethod
    def loads(cls, text: str) -> Quantiser:
        found = json.loads(text)
        return cls(np.array(found["centroids"], np.float64), np.array(found["ranks"], np.int64))


def _assigned(c: np.ndarray, probes: int, at: int):
    """Each row with its nearest cell and the angle to it; or, of ``probes`` above 1, a list of the nearest cells and angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                near = np.clip(_unit(_matrix(batch.column(at))) @ c.T, -1, 1)
                if probes == 1:
                    cell = near.argmax(1)
                    angle = np.arccos(near[np.arange(len(near)), cell])
                    made = [pa.array(cell.astype(np.int32)), pa.array(angle)]
                else:
                    cell = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    made = [pa.array(list(x), pa.list_(y)) for x, y in ((cell, pa.int32()), (np.arccos(np.take_along_axis(near, cell, 1)), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cell", "angle"])

    return run


def with_cells(rows: DataFrame, quantiser: Quantiser, column: str = "embedding") -> DataFrame:
    """``rows`` and the cell of each; null for vectors that can't be searched."""
    bad = vectors.problem(F.col(column)).isNotNull() | (F.size(column) != quantiser.centroids.shape[1])
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    good = rows.where(~bad).mapInArrow(_assigned(quantiser.centroids, 1, rows.columns.index(column)), f"{kinds}, cell int, angle double").drop("angle")
    return good.unionByName(rows.where(bad).withColumn("cell", F.lit(None).cast("int")))


def probed(rows: DataFrame, quantiser: Quantiser, vector: list[float], recall: float = 0.95) -> DataFrame:
    """Those of ``rows`` (with cells) that a search for one vector reads."""
    return rows.where(F.col("cell").isin(quantiser.cells_of(vector, quantiser.probes(recall))))


# many queries

_FOUND = "query_id bigint, id bigint, score double"


def _best(k: int):
    """Of one part of a cell: the k best of its rows for each query that came."""

    def run(part: pa.Table) -> pa.Table:
        ids, side = part["id"].to_numpy(), part["is_query"].to_numpy()
        if side.all() or not side.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        u = _unit(_matrix(part["v"]))
        rows, names = u[~side], ids[~side]
        out = []
        for at in range(0, int(side.sum()), 512):
            asked = np.flatnonzero(side)[at : at + 512]
            score = np.round(u[asked] @ rows.T, 6)
            order = np.lexsort((np.broadcast_to(names, score.shape), -score), axis=1)[:, :k]
            out.append((np.repeat(ids[asked], order.shape[1]), names[order].ravel(), np.take_along_axis(score, order, 1).ravel()))
        return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _sized(rows: DataFrame) -> dict[int, tuple[int, float]]:
    """{cell: (parts, largest angle)}: a row per cell."""
    found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()
    return {r["cell"]: (-(-r["n"] // PART), r["angle"]) for r in found}


def _met(rows: DataFrame, asked: DataFrame, sizes: dict[int, tuple[int, float]], k: int) -> DataFrame:
    """``rows`` (id, v, cell) with the queries (query_id, v, cell) that came to their cells: k of each query and part."""
    parts = F.element_at(F.create_map(*[F.lit(x) for c, (n, _) in sizes.items() for x in (c, n)]), F.col("cell"))
    left = rows.select(F.lit(False).alias("is_query"), "id", "v", "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    every = F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part")
    right = asked.where(F.col("cell").isin(list(sizes))).select(F.lit(True).alias("is_query"), F.col("query_id").alias("id"), "v", "cell", every)
    return left.unionByName(right).groupBy("cell", "part").applyInArrow(_best(k), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _side(rows: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(id, v) of the rows whose vectors have the length and are finite."""
    out = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.size("v") == dim)
    return out.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))


def batch(rows: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int = 10, key: str = "vec_id", query_key: str = "vec_id", column: str = "embedding", recall: float = 0.95) -> DataFrame:
    """(query_id, id, score, rank): the k nearest in the cells that each query probes. Keys are longs."""
    c, dim = quantiser.centroids, quantiser.centroids.shape[1]
    good = vectors.problem(F.col("v")).isNull()
    placed = _side(rows, key, column, dim).where(good).mapInArrow(_assigned(c, 1, 1), "id bigint, v array<double>, cell int, angle double")
    probes = quantiser.probes(recall)
    many = "array<int>, angle array<double>" if probes > 1 else "int, angle double"
    asked = _side(queries, query_key, column, dim).where(good).mapInArrow(_assigned(c, probes, 1), f"id bigint, v array<double>, cell {many}")
    asked = asked.select(F.col("id").alias("query_id"), "v", F.explode("cell").alias("cell") if probes > 1 else "cell")
    return _ranked(_met(placed, asked, _sized(placed), k), k)


def _reached(c: np.ndarray, cells: np.ndarray, angles: np.ndarray):
    """(query_id, v, cell) of each cell but the query's own that can hold a vector of score ``kth`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                part = whole.slice(k, 1024)
                theta = np.arccos(np.clip(_unit(_matrix(part.column("v"))) @ c[cells].T, -1, 1))
                most = np.cos(np.maximum(theta - angles, 0))
                kth = part.column("kth").to_numpy(zero_copy_only=False)[:, None]
                row, at = np.nonzero((most >= kth - 2e-6) & (cells[None, :] != part.column("cell").to_numpy()[:, None]))
                for a in range(0, len(row), 1 << 13):
                    took = part.select(["query_id", "v"]).take(pa.array(row[a : a + (1 << 13)]))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cells[at[a : a + (1 << 13)]].astype(np.int32))], names=["query_id", "v", "cell"])

    return run


def join(rows: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int = 10, key: str = "vec_id", query_key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The k nearest of ``rows`` for each query, exactly (query_id, id, score, rank); and how many cells each query went to (query_id, cells).

    Queries have one vector each. Zero vectors score 0 with all: of such rows the k smallest ids are enough for any query.
    """
    c, dim = quantiser.centroids, quantiser.centroids.shape[1]
    zero = ~F.exists("v", lambda x: x != 0)
    every, of = _side(rows, key, column, dim), _side(queries, query_key, column, dim)
    placed = scratch.settled(every.where(~zero).mapInArrow(_assigned(c, 1, 1), "id bigint, v array<double>, cell int, angle double"))
    sizes = _sized(placed)
    asked = of.where(~zero).mapInArrow(_assigned(c, 1, 1), "id bigint, v array<double>, cell int, angle double").select(F.col("id").alias("query_id"), "v", "cell")
    home = scratch.settled(_met(placed, asked, sizes, k))
    bound = _ranked(home, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    bound = asked.join(bound, "query_id", "left").select("query_id", "v", "cell", F.when(F.col("n") >= k, F.col("kth")).otherwise(-2.0).alias("kth"))
    cells = np.array(sorted(sizes), np.int64)
    angles = np.array([sizes[x][1] for x in cells.tolist()])
    reach = bound.mapInArrow(_reached(c, cells, angles), "query_id bigint, v array<double>, cell int") if len(cells) else asked.limit(0)
    reach = scratch.settled(reach)
    found = home.unionByName(_met(placed, reach, sizes, k)) if sizes else home
    least = lambda some: [r["id"] for r in some.select("id").orderBy("id").limit(k).collect()]
    for some, ids in ((asked, least(every.where(zero))), (of.where(zero).withColumnRenamed("id", "query_id"), least(every))):
        if ids:
            found = found.unionByName(some.select("query_id", F.explode(F.lit(ids).cast("array<bigint>")).alias("id"), F.lit(0.0).alias("score")))
    went = asked.select("query_id", F.lit(1).alias("n")).unionByName(reach.groupBy("query_id").agg(F.count("*").cast("int").alias("n")))
    return _ranked(found, k), went.groupBy("query_id").agg(F.sum("n").alias("cells"))
