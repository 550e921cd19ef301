"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are turned at random; each of ``CURVES`` curves takes ``DIMS`` of the turned dimensions, puts each on the scale of its own
quantiles, shifts it by a random part of that scale, and gives every vector its place on the Hilbert curve through those
dimensions. Vectors that are near tend to be near on some of the curves.

Along each curve in turn, vectors are partitioned by ranges of the key (edges from a sample, so any row's partition follows from its key alone).
A query goes to the partitions that its window of keys touches; there, queries in curve order meet the rows of their merged
windows, are ranked by products, and those that could be among the ``k`` nearest are measured again by the distance of the vectors as given. What
the curves found is merged: of each query, the ``k`` nearest.

The window's width is the only thing that is fitted: for at most ``CALIBRATION`` queries the true neighbours are looked up in one
pass over the table, and the window is the least that holds ``RECALL`` of them on one of the curves. It is a share of the table, so where
vectors have little in common (independent in all dimensions) it is wide, and where they lie in clusters it is small. Every
row is on every curve; no window, partition or candidate is capped.

Equal vectors are one point of the curves, with the ``k + 1`` smallest of their ids, which is all that a query can need of them. The key's lowest bits
are a hash, so points in one cell can be parted too.

Sizes: the sample that gives quantiles and edges has about ``SAMPLE`` vectors, or ``SAMPLE_NUMBERS`` numbers; a partition has ``PART_LEAST`` to ``PART_MOST`` points
or about half a window. Vectors of each length are searched among themselves.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without id; rows that repeat an id and vector count once; an id with several vectors is as near as the nearest of them, be it
query or candidate; ties go to the smaller id; with fewer than ``k`` others all are found; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.llm.common import cut, free, mix64

CURVES, DIMS, BITS, K, RECALL = 8, 8, 6, 10, 0.95
SAMPLE, SAMPLE_NUMBERS, CALIBRATION, PART_LEAST, PART_MOST, SALTS = 20_000, 2_000_000, 128, 2048, 65_536, 16
#: Queries whose windows are merged at a time.
TOGETHER = 64


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2 ** bits.

    From the highest bit plane down, each plane's bits (as a number) are the corner of the cube that holds the point; the curve's
    order of corners is a Gray code, turned so that it enters and leaves by the corners that the plane above calls for.
    """
    n, dims = x.shape
    full = (1 << dims) - 1
    key, entry, turn = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = np.arange(dims, dtype=np.int64)
    rotate = lambda v, by: ((v >> by) | (v << (dims - by))) & full  # noqa: E731  to the right, by less than dims
    for plane in reversed(range(bits)):
        corner = (((x >> plane) & 1) << place).sum(1)
        gray = rotate(corner ^ entry, (turn + 1) % dims)
        rank, step = gray.copy(), 1
        while step < dims:  # a Gray code's rank: each bit summed with those above it
            rank ^= rank >> step
            step *= 2
        key = (key << dims) | rank
        # where the next cube is entered: the Gray code of the even number at or below rank - 1; and along which axis it is left
        even = np.maximum((rank - 1) & ~np.int64(1), 0)
        begin = even ^ (even >> 1)
        back = (dims - (turn + 1) % dims) % dims
        entry = entry ^ rotate(begin, back)
        odd = np.where(rank == 0, 0, np.where(rank & 1 == 1, rank, rank - 1))
        ones = np.zeros(n, np.int64)
        for k in range(dims):  # trailing ones of odd
            ones += ((odd + 1) & ((np.int64(1) << (k + 1)) - 1)) == 0
        turn = (turn + ones % dims + 1) % dims
    return key


@dataclass
class Curve:
    """One curve: the axes that it projects on, the quantiles of each, the shifts, and what tells its hash from others'."""

    axes: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    seed: int
    bits: int = BITS

    def keys(self, v: np.ndarray, tie: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            y = np.nan_to_num(v @ self.axes)
        steps = np.linspace(0, 1, self.scale.shape[1])
        unit = np.stack([np.interp(y[:, d], self.scale[d], steps) for d in range(y.shape[1])], 1)
        cell = ((unit + self.shift) * (0.5 * ((1 << self.bits) - 1))).astype(np.int64)
        spare = 62 - self.bits * y.shape[1]
        low = mix64(tie.view(np.uint64) ^ np.uint64(self.seed)) >> np.uint64(64 - spare)
        return (hilbert(cell, self.bits) << spare) | low.astype(np.int64)


def curves(sample: np.ndarray, count: int = CURVES, dims: int = DIMS, seed: int = 11) -> list[Curve]:
    """Curves through axes of random orthogonal turns, as many to a turn as it has axes for."""
    rng, dim, out = np.random.default_rng(seed), sample.shape[1], []
    dims = min(dims, dim)
    bits = min(16, max(BITS, 40 // dims))
    axes = np.zeros((dim, 0))
    for k in range(count):
        if axes.shape[1] < dims:
            axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        mine, axes = axes[:, :dims], axes[:, dims:]
        with np.errstate(all="ignore"):
            scale = np.quantile(np.nan_to_num(sample @ mine), np.linspace(0, 1, 257), axis=0).T
        out.append(Curve(mine, np.ascontiguousarray(scale), rng.uniform(0, 1, dims), int(rng.integers(1, 1 << 62)), bits))
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def measured(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows of x and y, pair by pair; by parts of the largest difference where squares leave the range of doubles."""
    d = x - y
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((d * d).sum(1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
    if len(odd):
        most = np.abs(d[odd]).max(1)
        with np.errstate(all="ignore"):
            out[odd] = np.where(most > 0, most * np.sqrt(np.square(d[odd] / np.where(most > 0, most, 1)[:, None]).sum(1)), 0.0)
    return out


def nearest(q: np.ndarray, names: np.ndarray, v: np.ndarray, ids: list[np.ndarray], allowed: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(row of q, id, distance): for each query the k nearest ids among rows of v that ``allowed`` (query by row) lets it meet, but for its own.

    Squared distances by products choose, with room for their rounding; what they leave is measured.
    """
    if not len(v):
        return
    most = max(np.abs(q).max(initial=0), np.abs(v).max())
    a, b = q / most, v / most
    near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    near[~allowed] = np.inf
    room = 1e-12 * 4 * max(float((a * a).sum(1).max()), float((b * b).sum(1).max()))
    few = min(k + 1, near.shape[1])
    edge = np.partition(near, few - 1, axis=1)[:, few - 1] + room
    for i in range(len(q)):
        at = np.flatnonzero((near[i] <= edge[i]) & allowed[i])
        if not len(at):
            continue
        d = measured(np.broadcast_to(q[i], (len(at), q.shape[1])), v[at])
        order = np.lexsort((np.array([ids[j][0] for j in at]), d))[: k + 1]
        found = sorted((float(d[j]), int(x)) for j in order for x in ids[at[j]] if x != names[i])
        for distance, x in found[:k]:
            yield i, x, distance


_FOUND = "query_id bigint, id bigint, distance double"


def _rows(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "distance"])


def _ids(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _looked_up(q: np.ndarray, names: np.ndarray, dim: int, k: int):
    """Each task's k nearest points of a few queries, as (query's row, point's vector, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in names]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                v, ids = _matrix(batch.column("v"), dim), _ids(batch.column("ids"))
                own = {int(x): j for j, of in enumerate(ids) for x in of}
                for i, x, d in nearest(q, names, v, ids, np.ones((len(q), len(v)), bool), k):
                    best[i].append((d, x, v[own[x]]))
            best = [sorted(b, key=lambda r: r[:2])[:k] for b in best]
        rows = [(i, x, d, v.tolist()) for i, b in enumerate(best) for d, x, v in b]
        names_ = ["query_id", "id", "distance", "v"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], names=names_)

    return run


def window(points: DataFrame, asked: DataFrame, through: list[Curve], ordered: list[np.ndarray], dim: int, k: int, recall: float) -> float:
    """The least share of the table, to either side of a query, that holds ``recall`` of the true neighbours of a bounded number of queries on one of the curves."""
    some = asked.orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(CALIBRATION).select("query_id", "v", "c").collect()
    q, names, tie = np.array([r["v"] for r in some], np.float64).reshape(-1, dim), np.array([r["query_id"] for r in some], np.int64), np.array([r["c"] for r in some], np.int64)
    by = W.partitionBy("query_id").orderBy("distance", "id")
    found = points.select("v", "ids").mapInArrow(_looked_up(q, names, dim, k), "query_id bigint, id bigint, distance double, v array<double>")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "v", F.xxhash64("v").alias("c")).collect()
    if not found:
        return 1.0
    of, v = np.array([r["query_id"] for r in found]), np.array([r["v"] for r in found], np.float64)
    c = np.array([r["c"] for r in found], np.int64)
    gaps = []
    for curve, order in zip(through, ordered, strict=True):
        place = lambda keys: np.searchsorted(order, keys) / max(len(order), 1)
        gaps.append(np.abs(place(curve.keys(q, tie))[of] - place(curve.keys(v, c))))
    return float(np.quantile(np.min(gaps, axis=0), recall, method="higher"))


def _placed(curve: Curve, edges: np.ndarray, dim: int):
    """Points with their keys and partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = curve.keys(_matrix(batch.column("v"), dim), batch.column("c").to_numpy())
            part = np.searchsorted(edges, key, side="right").astype(np.int32)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part), none, pa.array(key), none, none, batch.column("v"), batch.column("ids")], names=_MET)

    return run


_MET = ["part", "query_id", "key", "low", "high", "v", "ids"]


def _sent(curve: Curve, edges: np.ndarray, order: np.ndarray, steps: int, dim: int):
    """Queries, once for each partition that their windows touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = curve.keys(_matrix(batch.column("v"), dim), batch.column("c").to_numpy())
            a, b = np.searchsorted(order, key) - steps, np.searchsorted(order, key, side="right") + steps
            low = np.where(a > 0, order[np.clip(a, 0, len(order) - 1)], -1)
            high = np.where(b < len(order), order[np.clip(b, 0, len(order) - 1)], np.iinfo(np.int64).max)
            first, last = np.searchsorted(edges, low, side="right"), np.searchsorted(edges, high, side="right")
            times = last - first + 1
            row = np.repeat(np.arange(batch.num_rows), times)
            part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(row), 1 << 13):
                r = row[at : at + (1 << 13)]
                took = batch.select(["query_id", "v"]).take(pa.array(r))
                ids = pa.nulls(len(r), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part[at : at + (1 << 13)].astype(np.int32)), took.column(0), pa.array(key[r]), pa.array(low[r]), pa.array(high[r]), took.column(1), ids], names=_MET)

    return run


def _searched(dim: int, k: int):
    """Of one partition: its queries in curve order, some at a time, with the rows of their merged windows."""

    def run(rows: pa.Table) -> pa.Table:
        asked = rows.filter(rows["query_id"].is_valid()).combine_chunks()
        points = rows.filter(rows["query_id"].is_null()).sort_by("key").combine_chunks()
        if not asked.num_rows or not points.num_rows:
            return pa.Table.from_batches([_rows([])])
        asked = asked.sort_by("key").combine_chunks()
        key, v, ids = points["key"].to_numpy(), _matrix(points["v"].combine_chunks(), dim), _ids(points["ids"].combine_chunks())
        q, names = _matrix(asked["v"].combine_chunks(), dim), asked["query_id"].to_numpy()
        a, b = np.searchsorted(key, asked["low"].to_numpy()), np.searchsorted(key, asked["high"].to_numpy(), side="right")
        out = []
        for at in range(0, len(q), TOGETHER):
            s = slice(at, at + TOGETHER)
            first, last = int(a[s].min()), int(b[s].max())
            place = np.arange(first, last)
            allowed = (place >= a[s, None]) & (place < b[s, None])
            out += [(int(names[at + i]), x, d) for i, x, d in nearest(q[s], names[s], v[first:last], ids[first:last], allowed, k)]
        return pa.Table.from_batches([_rows(out)])

    return run


def _along(points: DataFrame, asked: DataFrame, curve: Curve, order: np.ndarray, n: int, share: float, dim: int, k: int) -> DataFrame:
    """What one curve's windows find."""
    part_rows = int(min(max(share * n / 2, PART_LEAST), PART_MOST))
    parts = max(1, -(-n // part_rows))
    edges = np.unique(order[np.arange(1, parts) * len(order) // parts])
    # to either side: the share, and as many sampled keys as stand for 4 k points
    steps = int(np.ceil(max(share, 4.0 * k / n) * len(order))) + 1
    kind = f"part int, query_id bigint, key bigint, low bigint, high bigint, v {dict(points.dtypes)['v']}, ids array<bigint>"
    met = points.select("c", "v", "ids").mapInArrow(_placed(curve, edges, dim), kind).unionByName(asked.select("query_id", "c", "v").mapInArrow(_sent(curve, edges, order, steps, dim), kind))
    return cut(met.groupBy("part").applyInArrow(_searched(dim, k), _FOUND), "curve-found")


def _points(rows: DataFrame, k: int) -> DataFrame:
    """(c, v, ids) of rows (id, v): a row per distinct vector with the k + 1 smallest of its ids, which are cut down before they are gathered."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    by = W.partitionBy("v", "salt").orderBy("id")
    least = rows.distinct().withColumn("salt", salt).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
    gathered = least.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    return gathered.select(F.xxhash64("v").alias("c"), "v", "ids")


def search(
    vectors: DataFrame, queries: Column, key: str = "vec_id", column: str = "embedding", k: int = K, recall: float = RECALL, count: int = CURVES, dims: int = DIMS
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row that ``queries`` (a condition on ``id``) holds for."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = cut(rows.where(ok), "curve-vectors")
    points = cut(_points(rows, k), "curve-points")
    asked = cut(rows.where(queries).distinct().select(F.col("id").alias("query_id"), "v", F.xxhash64("v").alias("c")), "curve-queries")
    free(rows)
    found = []
    for r in points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # a row per length
        dim, n = r["d"], r["n"]
        mine, of = points.where(F.size("v") == dim), asked.where(F.size("v") == dim)
        if of.isEmpty():
            continue
        most = min(SAMPLE, max(1000, SAMPLE_NUMBERS // max(dim, 1)))
        drawn = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, most / n)))
        chosen = (mine if n <= most else mine.where(drawn).limit(2 * most)).select("v", "c").toArrow().combine_chunks()
        sample, tie = _matrix(chosen["v"].combine_chunks(), dim), chosen["c"].to_numpy()
        through = curves(sample, count, dims)
        ordered = [np.sort(c.keys(sample, tie)) for c in through]
        share = window(mine, of, through, ordered, dim, k, recall)
        found += [_along(mine, of, c, order, n, share, dim, k) for c, order in zip(through, ordered, strict=True)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    merged = functools.reduce(DataFrame.unionByName, found).groupBy("query_id", "id").agg(F.min("distance").alias("score"))
    by = W.partitionBy("query_id").orderBy("score", "id")
    return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("id") % 100 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
