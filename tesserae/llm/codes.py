"""Vector code compression: product quantisation in integers, fitted by Yinyang Lloyd rounds.

Components become integers, vectors are cut into parts, and each part position has a codebook that starts as the part of the vectors
with the smallest ids. A round assigns every part to the nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the floored mean of its parts.

Entries are clustered into groups once. Of each part, one lower bound per group is kept: no entry of the group, but for the
assigned one, is nearer. When entries move, the group's bound falls by the largest step of its entries. The distance to the
assigned entry is computed anew; a group is scanned only if its bound isn't above that distance. Bounds are floats that are
rounded down, distances are integers: they alone decide, ties included, so the result is that of a full scan.

A round is one pass over the rows, which writes codes and bounds beside the vectors, and a sum of components by entry
that each task adds up before the shuffle. What reaches the driver are the first vectors and the sums: as many numbers as the
codebooks have. A table of older bounds is deleted as soon as the next is written.

Vectors of each length have codebooks of their own.

Nulls and edge cases: vectors that are null or hold null or non-finite components are dropped; null ids come last, and of equal ids
the smaller vector comes first; with fewer vectors than entries the codebooks are shorter; parts are cut at k/4 of the
length, rounded down, so a length that 4 doesn't divide has parts of unequal length and an empty vector empty ones; integers beyond what keeps
squared distances in a long (2 ** 27 for 64 components) are held at that; a label's sum that exceeds a long is null; repeated
rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, free

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 1024, 4, 256, 4, 16
#: Rows that are worked on at once: their distances to all entries are held.
ROWS = 4096


def edges(dim: int, parts: int = PARTS) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x), held where squared distances would exceed a long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    most = 2.0 ** int((62 - math.log2(max(dim, 1))) / 2 - 1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, whole numbers: by products where doubles hold them exactly, else component by component."""
    width = x.shape[1]
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if most * most * max(width, 1) < 1 << 52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(width):
        out += np.square(x[:, j, None] - c[None, :, j])
    return out


def grouped(c: np.ndarray, groups: int, steps: int = 5) -> list[np.ndarray]:
    """Entries dealt to groups of near ones, ascending in each."""
    middle = c[:: max(1, len(c) // max(groups, 1))][:groups].astype(np.float64)
    for _ in range(steps):
        owner = np.square(c[:, None, :] - middle[None]).sum(2).argmin(1) if len(c) else np.zeros(0, int)
        middle = np.array([c[owner == g].mean(0) if (owner == g).any() else middle[g] for g in range(len(middle))]).reshape(middle.shape)
    return [at for g in range(len(middle)) if len(at := np.flatnonzero(owner == g))]


def first_scan(x: np.ndarray, c: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, bounds) from all distances."""
    d = distances(x, c)
    code = d.argmin(1)
    best = d[np.arange(len(x)), code]
    d = d.astype(np.float64)
    d[np.arange(len(x)), code] = np.inf
    return code, best, _below(np.stack([np.sqrt(d[:, g].min(1)) for g in groups], 1))


def _below(bounds: np.ndarray) -> np.ndarray:
    """As floats of 32 bits that are no greater than what they stand for."""
    return np.where(np.isfinite(bounds), bounds * (1 - 1e-6), np.finfo(np.float32).max).astype(np.float32)


def rescan(x: np.ndarray, c: np.ndarray, groups: list[np.ndarray], code: np.ndarray, bounds: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, squared distance, bounds, rows times groups scanned) after entries moved by ``drift`` (the largest step in each group) at most."""
    n = len(x)
    own = np.square(x - c[code]).sum(1)
    low = bounds.astype(np.float64) - drift[None, :] * (1 + 1e-9)
    open_ = low <= np.sqrt(own.astype(np.float64))[:, None] * (1 + 1e-9)
    best, at = own.copy(), code.copy()
    home = np.zeros(len(c), np.int64)
    for k, g in enumerate(groups):
        home[g] = k
    first = np.full((n, len(groups)), -1)
    least, second = np.full((n, len(groups)), np.inf), np.full((n, len(groups)), np.inf)
    for k, g in enumerate(groups):
        rows = np.flatnonzero(open_[:, k])
        if not len(rows):
            continue
        d = distances(x[rows], c[g])
        mine = home[code[rows]] == k
        big = np.iinfo(np.int64).max
        d[np.flatnonzero(mine), np.searchsorted(g, code[rows[mine]])] = big  # the assigned entry isn't its group's bound
        j = d.argmin(1)
        found, index = d[np.arange(len(rows)), j], g[j]
        better = (found < best[rows]) | (found == best[rows]) & (index < at[rows])
        best[rows[better]], at[rows[better]] = found[better], index[better]
        first[rows, k], least[rows, k] = index, np.where(found == big, np.inf, found)
        d[np.arange(len(rows)), j] = big
        rest = d.min(1)
        second[rows, k] = np.where(rest == big, np.inf, rest)
    # of a scanned group, the nearest entry that isn't assigned now; of others, the old bound less its drift
    low = np.where(open_, np.sqrt(np.where(first == at[:, None], second, least)), low)
    moved = np.flatnonzero(at != code)
    low[moved, home[code[moved]]] = np.minimum(low[moved, home[code[moved]]], np.sqrt(own[moved].astype(np.float64)))
    return at, best, _below(low), int(open_.sum())


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def _assigned(dim: int, books: list[np.ndarray], groups: list[list[np.ndarray]], drifts: list[np.ndarray] | None, last: bool):
    """Rows with their codes and bounds; in the last pass, codes and errors without the vectors."""
    at = edges(dim, len(books))
    starts = np.cumsum([0, *(len(g) for g in groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                n = batch.num_rows
                x = integers(batch.column("v"), dim)
                codes, bounds, error = np.zeros((n, len(books)), np.uint8), np.zeros((n, starts[-1]), np.float32), np.zeros(n, np.int64)
                if drifts is not None:
                    before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
                    held = batch.column("bounds").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                for p, c in enumerate(books):
                    mine = x[:, at[p] : at[p + 1]]
                    if drifts is None:
                        code, best, low = first_scan(mine, c, groups[p])
                    else:
                        code, best, low, _ = rescan(mine, c, groups[p], before[:, p], held[:, starts[p] : starts[p + 1]], drifts[p])
                    codes[:, p], bounds[:, starts[p] : starts[p + 1]] = code, low
                    error += best
                packed = pa.array([r.tobytes() for r in codes], pa.binary())
                columns = [batch.column("id"), batch.column("label")]
                if last:
                    yield pa.RecordBatch.from_arrays([*columns, packed, pa.array(error)], names=["id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, batch.column("v"), packed, _lists(bounds)], names=["id", "label", "v", "code", "bounds"])

    return run


def _sums(dim: int, sizes: list[int]):
    """(k, x): per task, the sums of components and the counts of rows by entry; k numbers them part by part, entry by entry, the count last."""
    at = edges(dim, len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((n, at[p + 1] - at[p] + 1), np.int64) for p, n in enumerate(sizes)]
        for batch in batches:
            x = integers(batch.column("v"), dim)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for p, total in enumerate(totals):
                np.add.at(total, codes[:, p], np.concatenate([x[:, at[p] : at[p + 1]], np.ones((len(x), 1), np.int64)], 1))
        flat = np.concatenate([t.ravel() for t in totals])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["k", "x"])

    return run


def updated(books: list[np.ndarray], sums: dict[int, int]) -> list[np.ndarray]:
    """Each entry's floored mean; entries without parts stay."""
    out, base = [], 0
    for c in books:
        width = c.shape[1] + 1
        total = np.array([sums.get(base + k, 0) for k in range(len(c) * width)], np.int64).reshape(len(c), width)
        n = total[:, -1:]
        out.append(np.where(n > 0, total[:, :-1] // np.maximum(n, 1), c))
        base += len(c) * width
    return out


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of rows (id, label, v) of one length, and the codebooks."""
    kinds, at = dict(rows.dtypes), edges(dim, parts)
    start = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    x = integers(pa.array(start, pa.list_(pa.float64())), dim)
    books = [x[:, at[p] : at[p + 1]] for p in range(parts)]
    near = [grouped(c, groups) for c in books]
    carried = f"id {kinds['id']}, label {kinds['label']}"
    state, drifts = rows, None
    for _ in range(rounds):
        older = state
        state = cut(state.mapInArrow(_assigned(dim, books, near, drifts, False), f"{carried}, v {kinds['v']}, code binary, bounds array<float>"), "code-bounds")
        if older is not rows:
            free(older)
        sums = state.select("v", "code").mapInArrow(_sums(dim, [len(c) for c in books]), "k int, x bigint").groupBy("k").agg(F.sum("x").alias("x"))
        new = updated(books, {r["k"]: r["x"] for r in sums.collect()})
        steps = [np.sqrt(np.square((a - b).astype(np.float64)).sum(1)) for a, b in zip(new, books, strict=True)]
        drifts = [np.array([s[g].max() for g in of]) for s, of in zip(steps, near, strict=True)]
        books = new
    out = cut(state.mapInArrow(_assigned(dim, books, near, drifts, True), f"{carried}, code binary, error bigint"), "codes")
    if state is not rows:
        free(state)
    return out, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in books for x in c.ravel().tolist()).encode()).hexdigest()


def decoded(codes: bytes, books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for: the middle of each integer's range."""
    return [(float(x) + 0.5) / SCALE for p, c in zip(codes, books, strict=True) for x in c[p]]


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", **options: int) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256), a row per vector that isn't dropped."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = cut(rows.where(F.coalesce(finite, F.lit(False))), "code-vectors")
    kinds = dict(rows.dtypes)
    coded = rows.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code binary, error bigint, codebooks_sha256 string")
    for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # a row per length
        part, books = fit(rows.where(F.size("v") == r["d"]), r["d"], **options)
        coded = coded.unionByName(part.withColumn("codebooks_sha256", F.lit(digest(books))))
    free(rows)
    sums = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")).withColumnRenamed("label", "_l"), "code-labels")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")), "left")
    return out.select(F.col("id").alias(key), F.col("label").alias(label), F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    out = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds in full, one after the other: all distances, each part's nearest entry, floored means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT id, place, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT p.id, p.place, b.e, list_dot_product(p.x, p.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(p.x, b.x) AS d FROM parts p JOIN b{k} b USING (place))
  GROUP BY id, place)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.place, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT place, e, list(floor(s / n) ORDER BY i) AS x FROM (
      SELECT p.place, a.e, i, sum(p.x[i]) AS s, count(*) AS n FROM parts p JOIN a{k} a USING (id, place), unnest(range(1, len(p.x) + 1)) AS u(i) GROUP BY p.place, a.e, i)
    GROUP BY place, e) m ON b.place = m.place AND b.e = m.e)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT id, k AS place, x[k * len(x) // {parts} + 1:(k + 1) * len(x) // {parts}] AS x FROM kept, unnest(range({parts})) AS t(k)),
b0 AS MATERIALIZED (SELECT place, id - 1 AS e, x FROM parts WHERE id <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY place) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT::VARCHAR), ','), ',' ORDER BY place, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""
