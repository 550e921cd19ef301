"""Nearest neighbours by cosine: exact by default, approximate by partition on request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import vectors

#: Queries and rows that one task compares; queries that the reach of an approximate search is measured on.
QUERY_BLOCK, ROW_BLOCK, ASKED = 1024, 8192, 64


def top_k(rows: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score, distance, rank) of the k rows nearest to one vector. Ties go to the smaller key; zero vectors score 0."""
    if k < 1:
        raise ValueError("k must be positive")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(key, vectors.rounded(vectors.cosine(F.col(column), q)).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.select(key, "score", F.round(1 - F.col("score"), 6).alias("distance"), F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank"))


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(n, -1)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _search(ids: np.ndarray, queries: np.ndarray, k: int, tile: int = 2048):
    """The k best of each query in each task, kept while tiles of rows pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, name = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, tile):
                part = batch.slice(at, tile)
                found = np.round(queries @ _unit(part.column(1).flatten().to_numpy(zero_copy_only=False), part.num_rows).T, 6)
                score = np.concatenate([score, found], 1)
                name = np.concatenate([name, np.broadcast_to(part.column(0).to_numpy(), found.shape)], 1)
                order = np.lexsort((name, -score), axis=1)[:, :k]
                score, name = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
        n = score.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(name.ravel()), pa.array(score.ravel())], names=["query_id", "id", "score"])

    return run


def _best(k: int):
    """The k best rows of each query, of one block of queries and one of rows."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        asked = part.filter(pc.field("side") == 0).combine_chunks()
        rows = part.filter(pc.field("side") == 1).combine_chunks()
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        unit = lambda t: _unit(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), t.num_rows)
        score = np.round(unit(asked) @ unit(rows).T, 6)
        ids = np.broadcast_to(rows["id"].to_numpy(), score.shape)
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        n = order.shape[1]
        found = [np.repeat(asked["id"].to_numpy(), n), np.take_along_axis(ids, order, 1).ravel(), np.take_along_axis(score, order, 1).ravel()]
        return pa.table(dict(zip(("query_id", "id", "score"), found, strict=True)))

    return run


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", query_key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest of ``rows`` for each query, ids being longs.

    Up to ``QUERY_BLOCK`` queries are sent to all tasks, and rows stay where they are: each task keeps k of them per query. More
    queries, and the rows, are dealt to blocks by their ids, and each block of queries meets each block of rows in a task of its
    own; none of that goes through the driver.
    """
    side = lambda t, name, n: t.select(F.lit(n).alias("side"), F.col(name).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    few = side(queries, query_key, 0).limit(QUERY_BLOCK + 1).collect()
    if not few:
        return rows.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    if len(few) <= QUERY_BLOCK:
        vs = _unit(np.array([r["v"] for r in few]).ravel(), len(few))
        found = side(rows, key, 1).select("id", "v").mapInArrow(_search(np.array([r["id"] for r in few], np.int64), vs, k), "query_id bigint, id bigint, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    n_asked, n_rows = queries.count(), rows.count()
    a, b = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = side(queries, query_key, 0).select("*", dealt(a).alias("a"), every(b).alias("b"))
    right = side(rows, key, 1).select("*", every(a).alias("a"), dealt(b).alias("b"))
    # as many partitions as pairs of blocks: adaptive execution would put these small groups into few tasks
    met = left.unionByName(right).repartition(min(a * b, 100_000), "a", "b")
    found = met.groupBy("a", "b").applyInArrow(_best(k), "query_id bigint, id bigint, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _signatures(planes: np.ndarray):
    """(id, v, cell): each vector once for each table, with the number of the table and of the side of its planes that the vector is on."""
    tables, bits, _ = planes.shape
    weights, tags = 1 << np.arange(bits, dtype=np.int64), np.arange(tables, dtype=np.int64) << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.num_rows)
                codes = (np.einsum("nd,tbd->ntb", v, planes) >= 0) @ weights + tags
                row = np.repeat(np.arange(batch.num_rows), tables)
                took = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(codes.ravel())], names=["id", "v", "cell"])

    return run


def flips(cost: np.ndarray, most: float) -> list[int]:
    """All sets of bits whose costs sum to ``most`` or less, as numbers; the empty one first."""
    order = np.argsort(cost, kind="stable").tolist()
    out, ends = [(0, 0.0, 0)], 0
    while ends < len(out):  # a set is extended by dearer bits only, so each comes once
        mask, spent, begin = out[ends]
        ends += 1
        for j in range(begin, len(order)):
            if spent + cost[order[j]] > most:
                break
            out.append((mask | 1 << order[j], spent + cost[order[j]], j + 1))
    return [x[0] for x in out]


def _probes(planes: np.ndarray, most: float):
    """(id, v, cell): each query once for each bucket that it probes, those across planes that it is near to."""
    tables, bits, _ = planes.shape
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                v = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), 1)
                margin = np.einsum("nd,tbd->ntb", v, planes)[0]
                codes = (margin >= 0) @ weights
                cells = np.array([(t << bits) | (int(codes[t]) ^ f) for t in range(tables) for f in flips(margin[t] ** 2, most)], np.int64)
                for k in range(0, len(cells), 4096):
                    part = cells[k : k + 4096]
                    took = batch.take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(part)], names=["id", "v", "cell"])

    return run


def _in_buckets(k: int):
    """Of a run of buckets: the k best rows of each query among the buckets that it probes."""

    def run(part: pa.Table) -> pa.Table:
        cell, side, ids = (part[name].to_numpy() for name in ("cell", "side", "id"))
        unit = _unit(part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), part.num_rows)
        order = np.lexsort((side, cell))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            asked, rows = at[side[at] == 0], at[side[at] == 1]
            if len(asked) and len(rows):
                score = np.round(unit[asked] @ unit[rows].T, 6)
                best = np.lexsort((np.broadcast_to(ids[rows], score.shape), -score), axis=1)[:, :k]
                found.append((np.repeat(ids[asked], best.shape[1]), ids[rows][best].ravel(), np.take_along_axis(score, best, 1).ravel()))
        query, name, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((name, -score, query))  # a row is in one bucket of a table, so none comes twice
        first = np.searchsorted(query[order], query[order])
        kept = order[np.arange(len(order)) - first < k]
        return pa.table({"query_id": query[kept], "id": name[kept], "score": score[kept]})

    return run


def signature_bits(n: int, least: int = 4, bucket: int = 64) -> int:
    """Planes of a signature: enough that a bucket of ``n`` vectors that are alike in nothing has about ``bucket`` of them."""
    return max(least, int(np.ceil(np.log2(max(n, 1) / bucket))))


def _reach(rows: DataFrame, queries: DataFrame, planes: np.ndarray, k: int, recall: float) -> float:
    """The least cost of crossed planes within which ``recall`` of true neighbours is met in some table, measured on at most ``ASKED`` queries."""
    some = queries.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(ASKED).collect()
    if not some:
        return 0.0
    asked = _unit(np.array([r["v"] for r in some]).ravel(), len(some))
    found = rows.mapInArrow(_search(np.arange(len(some)), asked, k + 1), "query_id bigint, id bigint, score double")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k + 1)
    near = found.join(rows, "id").select("query_id", "id", "v").collect()  # ASKED * (k + 1) rows
    near = [r for r in near if r["id"] != some[r["query_id"]]["id"]]  # a query that is a row itself finds itself at no cost
    if not near:
        return 0.0
    of, v = np.array([r["query_id"] for r in near]), _unit(np.array([r["v"] for r in near]).ravel(), len(near))
    mine, its = np.einsum("nd,tbd->ntb", asked, planes)[of], np.einsum("nd,tbd->ntb", v, planes)
    cost = np.where((mine >= 0) != (its >= 0), mine**2, 0.0).sum(2).min(1)
    return float(np.quantile(cost, recall, method="higher")) * (1 + 1e-9)


def approximate_top_k(
    rows: DataFrame, queries: DataFrame, dim: int, k: int = 10, key: str = "vec_id", column: str = "embedding", tables: int = 8, bits: int | None = None, seed: int = 5, recall: float = 0.95
) -> DataFrame:
    """As ``batch_top_k``, comparing only vectors that meet in a bucket of one of ``tables`` tables of ``bits`` random planes.

    Signatures get longer with the table (``signature_bits``). A row is in one bucket of each table; a query probes its own and those across the planes
    that it is nearest to: all whose crossed planes cost no more (in squares of its distances to them) than what holds ``recall`` of the
    true neighbours of a bounded number of queries, which are looked up in one pass. So recall stays, whatever the table's size; what
    changes is how many buckets it takes. Neighbouring buckets of a table, about ``ROW_BLOCK`` rows of them, are met in one task, which keeps k rows
    a query; where there are more rows, they are dealt to parts.
    """
    bits = bits or signature_bits(rows.count())
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))
    side = lambda t: t.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.size("v") == dim)
    every, of = side(rows), side(queries)
    most = _reach(every, of, planes, k, recall)
    signed = every.mapInArrow(_signatures(planes), "id bigint, v array<double>, cell bigint")
    probes = of.mapInArrow(_probes(planes, most), "id bigint, v array<double>, cell bigint")
    run = F.shiftright("cell", min(bits, 7)).alias("run")  # 128 buckets of 64 rows
    signed, probes = signed.select("*", run), probes.select("*", run)
    hot = signed.groupBy("run").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    left = probes.join(hot, "run", "left").select(F.lit(0).alias("side"), "id", "v", "cell", "run", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = signed.join(hot, "run", "left").select(F.lit(1).alias("side"), "id", "v", "cell", "run", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    found = left.unionByName(right).groupBy("run", "part").applyInArrow(_in_buckets(k), "query_id bigint, id bigint, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
