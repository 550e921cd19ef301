"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to unit length and rotated to the principal axes of all of them (their second moments are summed over
the whole table), so that leading dimensions tell most. They are dealt to tiles by recursive halving along the
axes, from cut points that are the same for every vector, until a tile has about ``TILE`` vectors.

Unit vectors of cosine t or more are at distance sqrt(2 - 2t) at most. A vector is therefore sent to another tile only
if it is that near to the tile's box (its ranges of the leading dimensions), and a vector of that tile meets it only
if the same holds the other way. There are at most 2 ** ``MOST_LEVELS`` tiles, so their boxes fit any task; a tile of more than
``TILE`` vectors, be it that the table is large or that very many vectors are alike, is dealt to parts by a hash, and parts meet
instead of tiles: no group of the comparison has more than about two parts' vectors.

Within a pair of parts, vectors are put in the order of further halvings, and blocks whose boxes are out of reach are skipped.
Products are accumulated over the leading dimensions first (as many as hold ``SHARES`` of the energy); the residual
product is at most that of the suffix norms, so pairs whose bound is below the threshold stop there, and only the others
get further dimensions. What remains is verified by cosines in double precision of the vectors as given.

Equal vectors are one class, compared once. A pair of parts yields, per vector, how many others it links with
(weighted by the sizes of their classes), and only as many links as connect the same vectors: rows grow with
vectors, never with pairs. No tile, partner or link is capped.

Vectors of each length are compared among themselves.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
kept; a null id takes part, but is its component's id only if all are null; rows that repeat an id and vector count as
vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, free, mix64
from tesserae.llm.components import components

THRESHOLD, TILE, BLOCK, MOST_LEVELS = 0.95, 8192, 256, 12
#: Parts of the energy that successive leading dimensions hold, and dimensions of a tile's box.
SHARES, LEADING = (0.2, 0.4, 0.7), 16
#: Slack for rounding in bounds, never in the verified cosine.
SLACK = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            u = _unit(_vectors(batch.column("v")))
            total += u.T @ u
            n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["k", "x"])

    return run


def axes(classes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The principal axes, most telling first, and the energy on each: dim x dim numbers, summed over all vectors."""
    sums = classes.select("v").mapInArrow(_moments(dim), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    m = np.zeros(dim * dim)
    for r in sums:
        m[r["k"]] = r["x"]
    energy, q = np.linalg.eigh(m.reshape(dim, dim))
    return np.ascontiguousarray(q[:, ::-1]), np.maximum(energy[::-1], 0)


def leading(energy: np.ndarray) -> list[int]:
    """How many leading dimensions hold each of ``SHARES`` of the energy."""
    held = np.cumsum(energy) / max(energy.sum(), 1e-300)
    return sorted({s for s in (int(np.searchsorted(held, share)) + 1 for share in SHARES) if s < len(energy)})


def halvings(classes: DataFrame, q: np.ndarray, n: int, tile: int, most: int = 20_000) -> list[np.ndarray]:
    """Cut points by level, from a bounded sample (it only balances tiles): level d halves along axis d."""
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(n / tile, 1))))))
    if not levels:
        return []
    part = classes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < F.lit(int(min(1.0, most / n) * 1_000_000))).limit(2 * most)
    found = [r["v"] for r in part.select("v").toLocalIterator()]
    u = _unit(np.array(found)) @ q if found else np.zeros((0, len(q)))
    node, cuts = np.zeros(len(u), np.int64), []
    for d in range(levels):
        x = u[:, d % u.shape[1]]
        order = np.lexsort((x, node))
        size = np.bincount(node, minlength=1 << d)
        first = np.cumsum(size) - size
        points = np.array([x[order[f + s // 2]] if s else 0.0 for f, s in zip(first, size, strict=True)])
        cuts.append(points)
        node = 2 * node + (x >= points[node])
    return cuts


def _tile_of(r: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    node = np.zeros(len(r), np.int64)
    for d, points in enumerate(cuts):
        node = 2 * node + (r[:, d % r.shape[1]] >= points[node])
    return node


def _placed(q: np.ndarray, cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _unit(_vectors(batch.column("v"))) @ q
            tile = _tile_of(r, cuts)
            box = pa.array(list(r[:, :LEADING]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), batch.column("v"), pa.array(tile), box], names=["c", "n", "v", "tile", "r"])

    return run


def _met(boxes: list, threshold: float, tile: int):
    """(a, b, side, c, n, v): each vector once for every pair of parts that it may have partners in. Part k of tile t is t << 24 | k."""
    tiles = np.array([r["tile"] for r in boxes], np.int64)
    low, high = (np.array([r[x] for r in boxes], np.float64).reshape(len(boxes), -1) for x in ("low", "high"))
    parts = np.array([-(-r["vectors"] // tile) for r in boxes], np.int64)
    reach = 2 - 2 * threshold + SLACK
    # every part of every tile, tile by tile
    owner = np.repeat(np.arange(len(tiles)), parts)
    part = (tiles[owner] << 24) + np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    step = max(1, (1 << 20) // max(len(owner), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.array(batch.column("r").flatten()).reshape(batch.num_rows, -1)
            at = np.searchsorted(tiles, batch.column("tile").to_numpy())
            mine = (tiles[at] << 24) + mix64(batch.column("c").to_numpy().view(np.uint64)) % parts[at].astype(np.uint64)
            mine = mine.astype(np.int64)
            for k in range(0, batch.num_rows, step):
                gap2 = np.zeros((len(r[k : k + step]), len(tiles)))
                for d in range(r.shape[1]):
                    x = r[k : k + step, d, None]
                    gap2 += np.square(np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0))
                row, to = np.nonzero((gap2 <= reach)[:, owner])
                row, other = row + k, part[to]
                a, b = np.minimum(mine[row], other), np.maximum(mine[row], other)
                side = (mine[row] > other).astype(np.int8)
                for e in range(0, len(row), 1 << 14):
                    f = slice(e, e + (1 << 14))
                    took = batch.select(["c", "n", "v"]).take(pa.array(row[f]))
                    yield pa.RecordBatch.from_arrays([pa.array(a[f]), pa.array(b[f]), pa.array(side[f]), *took.columns], names=["a", "b", "side", "c", "n", "v"])

    return run


def halved(r: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of the rows in which blocks of ``block`` are near each other: halves along one axis after the other."""
    order = np.arange(len(r))
    span, d = len(r), 0
    while span > block:
        for k in range(0, len(r), span):
            part = order[k : k + span]
            order[k : k + span] = part[np.argsort(r[part, d % r.shape[1]], kind="stable")]
        half = block  # the next span: the greatest block * 2 ** i below this one
        while half * 2 < span:
            half *= 2
        span, d = half, d + 1
    return order


def compare(
    x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float, same: bool, steps: list[int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of linked pairs (i, j) of unit vectors x and y, whose rotations are rx and ry; i < j if they are the same."""
    dim = x.shape[1]
    steps = [s for s in (8, 16, 32) if s < dim] if steps is None else steps
    tails = lambda r: [np.sqrt(np.maximum((r[:, s:] ** 2).sum(1), 0)) for s in steps]
    boxes = lambda r: (np.array([f(r[k : k + BLOCK], 0) for k in range(0, len(r), BLOCK)]) for f in (np.min, np.max))
    tx, ty = tails(rx), tails(ry)
    (low_x, high_x), (low_y, high_y) = boxes(rx), boxes(ry)
    for a in range(0, len(x), BLOCK):
        gap = np.maximum(np.maximum(low_y - high_x[a // BLOCK], low_x[a // BLOCK] - high_y), 0)
        near = np.flatnonzero((gap * gap).sum(1) <= 2 - 2 * threshold + SLACK) * BLOCK
        for b in near[near >= a].tolist() if same else near.tolist():
            p, q = rx[a : a + BLOCK], ry[b : b + BLOCK]
            i = j = None
            done = 0
            for k, s in enumerate(steps):
                if i is None:  # all pairs of the block
                    bound = p[:, :s] @ q[:, :s].T + tx[k][a : a + BLOCK, None] * ty[k][None, b : b + BLOCK]
                    i, j = np.nonzero(bound >= threshold - SLACK)
                    got = None
                elif len(i):
                    if got is None:
                        got = np.einsum("ij,ij->i", p[i, :done], q[j, :done])
                    got = got + np.einsum("ij,ij->i", p[i, done:s], q[j, done:s])
                    stay = got + tx[k][a + i] * ty[k][b + j] >= threshold - SLACK
                    i, j, got = i[stay], j[stay], got[stay]
                done = s
            if i is None:
                i, j = (g.ravel() for g in np.indices((len(p), len(q))))
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):
                f, g = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                true = np.einsum("ij,ij->i", x[f], y[g]) >= threshold
                yield f[true], g[true]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Adds each vector's links to ``counts``, and returns links enough to connect what the pairs connect."""
    top = np.arange(n)
    kept: list[tuple[int, int]] = []

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = int(top[k])
        return k

    for i, j in pairs:
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        for _ in range(n):  # drop pairs that are connected already, all at once, until none is left
            ri, rj = top[i], top[j]
            apart = ri != rj
            i, j = i[apart], j[apart]
            if not len(i):
                break
            for a, b in zip(i[:256].tolist(), j[:256].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    top[max(ra, rb)] = min(ra, rb)
                    kept.append((a, b))
            while True:
                up = top[top]
                if (up == top).all():
                    break
                top[:] = up
    return kept


_LINKS = "c bigint, links bigint, other bigint, is_link boolean"


def _links(q: np.ndarray, threshold: float, steps: list[int]):
    """Per pair of parts: how many links each class has, and, as rows of their own (is_link), links that connect what is linked."""

    def run(rows: pa.Table) -> pa.Table:
        whole = rows["a"][0] == rows["b"][0]
        side, ids, n = (rows[name].to_numpy() for name in ("side", "c", "n"))
        if not whole and side.min() == side.max():  # no vector of the other part came
            return pa.table({"c": ids[:0], "links": n[:0], "other": ids[:0], "is_link": np.zeros(0, bool)})
        v = _unit(_vectors(rows["v"].combine_chunks()))
        r = v @ q
        order = np.concatenate([(at := np.flatnonzero(side == k))[halved(r[at])] for k in (0, 1)])
        v, r, ids, n = v[order], r[order], ids[order], n[order]
        counts = np.zeros(len(v), np.int64)
        m = int((side == 0).sum())
        if whole:
            pairs = compare(v, v, r, r, threshold, True, steps)
        else:
            pairs = ((i, j + m) for i, j in compare(v[:m], v[m:], r[:m], r[m:], threshold, False, steps))
        kept = _forest(len(v), pairs, counts, n)
        some = np.flatnonzero(counts)
        a = np.array([k[0] for k in kept], np.int64)
        b = np.array([k[1] for k in kept], np.int64)
        other = pa.array(np.concatenate([ids[some], ids[b]]))
        is_link = np.concatenate([np.zeros(len(some), bool), np.ones(len(a), bool)])
        links = np.concatenate([counts[some], np.zeros(len(a), np.int64)])
        return pa.Table.from_arrays([pa.array(np.concatenate([ids[some], ids[a]])), pa.array(links), other, pa.array(is_link)], names=["c", "links", "other", "is_link"])

    return run


def links(classes: DataFrame, dim: int, n: int, threshold: float, tile: int) -> DataFrame:
    """The links among ``n`` classes (c, n, v) of vectors of one length, as ``_links`` gives them."""
    q, energy = axes(classes, dim)
    cuts = halvings(classes, q, n, tile)
    kinds = dict(classes.dtypes)
    placed = cut(classes.select("c", "n", "v").mapInArrow(_placed(q, cuts), f"c bigint, n bigint, v {kinds['v']}, tile bigint, r array<double>"), "vector-tiles")
    lead = range(min(LEADING, dim))
    boxes = placed.groupBy("tile").agg(
        F.array(*[F.min(F.col("r")[k]) for k in lead]).alias("low"), F.array(*[F.max(F.col("r")[k]) for k in lead]).alias("high"), F.count("*").alias("vectors")
    )
    boxes = boxes.orderBy("tile").collect()  # at most 2 ** MOST_LEVELS rows
    met = placed.mapInArrow(_met(boxes, threshold, tile), f"a bigint, b bigint, side tinyint, c bigint, n bigint, v {kinds['v']}")
    found = cut(met.groupBy("a", "b").applyInArrow(_links(q, threshold, leading(energy)), _LINKS), "vector-links")
    free(placed)
    return found


def near_dedup(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept), a row per input row."""
    rows = vectors.select(F.col(key).alias("id"), F.col(column).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.withColumn("ok", F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    # rows find their classes by two hashes; classes are numbered, so that no two can be taken for one
    rows = cut(rows.withColumns({f"h{k}": F.when(F.col("ok"), F.xxhash64(F.lit(k), "v")) for k in (1, 2)}), "vectors")
    classes = rows.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    linked = classes.sparkSession.createDataFrame([], _LINKS)
    for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # a row per length
        linked = linked.unionByName(links(classes.where(F.size("v") == r["d"]), r["d"], r["n"], threshold, tile))
    counts = linked.where("NOT is_link").groupBy("c").agg(F.sum("links").alias("links"))
    edges = linked.where("is_link").select("c", "other")
    named = components(edges).join(classes.select(F.col("c").alias("node"), "first"), "node")
    least = cut(named.groupBy("root").agg(F.min("first").alias("least")), "vector-least")
    named = named.join(least, "root").select(F.col("node").alias("m"), "least")
    known = classes.select("c", "h1", "h2", "n", "first").join(counts, "c", "left").join(named, F.col("c") == F.col("m"), "left")
    known = cut(known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "vector-known")
    out = rows.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, min(reach.b) AS component_id, min(reach.b) = v.vec_id AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""
