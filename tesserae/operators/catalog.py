"""The catalog's tables and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DOCUMENTS = "document_id long, content_id string, source string, title string, content_type string, metadata string, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id long, embedding_id string, document_id long, content string, content_type string, chunk_index int, metadata string, created_at timestamp"
CONTENT = "id string, storage_type string, original_path string, content_path string, display_name string, content_type string, file_size long, content_hash string, created_at timestamp"
MODES, MODEL_TYPES, STRATEGIES = ("text", "multimodal"), ("sentence-transformer", "clip"), ("cross-encoder", "text-derived", "metadata", "disabled")
CONTENT_TYPES, STORAGE = ("text", "image", "pdf", "docx"), ("filesystem", "content_dir")


def check(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def chunks_by_embedding_ids(chunks: DataFrame, documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with these embedding ids and their documents, in order of chunk index."""
    found = chunks.join(ids.select("embedding_id"), "embedding_id", "left_semi")
    return found.join(documents, "document_id").orderBy("chunk_index", "embedding_id")


def chunks_of_type(chunks: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    of = documents.select("document_id", "source", "title")
    return chunks.where(F.col("content_type") == kind).join(of, "document_id").orderBy("source", "chunk_index", "document_id")


def documents_of_type(documents: DataFrame, kind: str, newest: str, key: str) -> DataFrame:
    return documents.where(F.col("content_type") == kind).orderBy(F.desc(newest), key)


def type_statistics(rows: DataFrame, column: str = "content_type") -> DataFrame:
    """Counts by type, and their total in the row where the type is null and ``is_total`` is 1."""
    out = rows.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).cast("int").alias("is_total"))
    return out.select(column, "n", "is_total")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new`` whose key isn't there yet, the first by ``order`` for each key."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct(order)).alias("r")).select("r.*")
    return first.join(existing.select(key), key, "left_anti").select(*new.columns)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``. Aggregated before the shuffle, so a key with very many rows is no load."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("r")).select("r.*")


def replace(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` without the keys of ``new``, and ``new``: how a source that is taken in again replaces its rows."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(new)


def update(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with ``column`` replaced where ``changes`` has the key."""
    new = changes.select(key, F.col(column).alias("_new"))
    out = rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return out.select(*rows.columns)


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def missing(changes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys of ``changes`` that no row has."""
    return changes.select(key).distinct().join(rows.select(key), key, "left_anti")


def newest(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def chunk_counts(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))


def by_source(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents by source, either path separator."""
    same = lambda c: F.regexp_replace(c, r"\\", "/")
    return documents.withColumn("_s", same("source")).join(sources.select(same("source").alias("_s")).distinct(), "_s", "left_semi").drop("_s")


def has_rows(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def modality_counts(rows: DataFrame, kind: str = "content_type") -> DataFrame:
    k = F.col(kind)
    text = k.eqNullSafe("text") | k.startswith("text/") | k.isin("application/pdf", "pdf", "docx")
    image = k.startswith("image")
    return rows.agg(
        F.count_if(F.coalesce(text, F.lit(False))).alias("n_text"), F.count_if(F.coalesce(image, F.lit(False))).alias("n_image"),
        F.count_if(~F.coalesce(text | image, F.lit(False))).alias("n_other"),
    )


def _place(edges: Column, n: int, x: Column) -> Column:
    """How many of the n sorted edges are x or less, by halving."""
    steps = [F.lit(1 << k) for k in reversed(range(n.bit_length()))]
    sorted_edges = edges
    reached = lambda at, step: (at + step <= n) & (F.get(sorted_edges, at + step - 1) <= x)
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: at + F.when(F.coalesce(reached(at, step), F.lit(False)), step).otherwise(0))


def running(rows: DataFrame, size: str, by: list[str], order: list[str], ranges: int = 1024) -> DataFrame:
    """The input with ``before``: the sum of ``size`` over rows earlier in ``order``, within ``by``.

    Rows that are equal in ``order`` come in the order of a hash of all their columns, so the result doesn't depend on how they are read.

    One task per group (or one for all) would have to order a large one. Instead rows are cut into ranges of the full order, group and hash
    included, by edges from a bounded sample; ranges are summed, and rows are only ordered within theirs, however many share a value.
    """
    whole = F.xxhash64(*[F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes])
    full = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate([*by, *order])], whole.alias("tie"))
    keyed = rows.withColumn("_o", full)
    n = rows.count()
    wanted = 32 * ranges
    some = keyed.where(F.pmod(F.xxhash64("_o"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, wanted / max(n, 1))))).limit(2 * wanted).select("_o")
    each = F.greatest(F.lit(1), F.floor(F.size("s") / ranges)).cast("int")
    edges = some.agg(F.array_sort(F.collect_list("_o")).alias("s"))  # at most 2 * wanted short rows
    edges = edges.select(F.filter("s", lambda _, i: (i > 0) & (i % each == 0)).alias("_edges"))
    # one row, whose edges go to every task; at most about 2 * ranges of them
    placed = keyed.join(F.broadcast(edges)).withColumn("_r", _place(F.col("_edges"), 2 * ranges, F.col("_o"))).drop("_edges")
    group = F.struct(*[F.col(c).alias(f"g{k}") for k, c in enumerate(by)], F.lit(0).alias("all"))
    placed = placed.withColumn("_g", group)
    # a range may have rows of several groups: their sums are kept apart
    sums = placed.groupBy("_g", "_r").agg(F.sum(size).alias("_n")).select(F.col("_g").alias("_h"), F.col("_r").alias("_s"), "_n")
    ahead = W.partitionBy("_h").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    w = W.partitionBy("_r", "_g").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_i", F.coalesce(F.sum(size).over(w), F.lit(0)))
    out = inside.join(sums, (F.col("_r") == F.col("_s")) & F.col("_g").eqNullSafe(F.col("_h")))
    return out.withColumn("before", F.col("_b") + F.col("_i")).select(*rows.columns, "before")


def settings(changes: DataFrame, order: str) -> DataFrame:
    """A row with the last value of each column that isn't null, by ``order``: what partial updates leave behind. No row without changes."""
    names = [c for c in changes.columns if c != order]
    out = changes.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in names], F.count("*").alias("_n"))
    return out.where("_n > 0").drop("_n")


def merge(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with those values of ``changes`` (at most a row per key) that aren't null, and the keys that are new: a partial upsert."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in rows.columns if c != key])
    out = rows.join(new, F.col(key) == F.col("_k"), "full")
    return out.select(*[F.coalesce("_k", key).alias(key) if c == key else F.coalesce(f"_{c}", c).alias(c) for c in rows.columns])


def insert_new(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``new`` whose key is unique and not there yet; and the others, which an insert refuses. Rows without key are in neither.

    A key's only row is carried along with its count, so nothing is joined back to find it. The refused are those whose keys were not
    taken; that join has the key's hash beside it, so that both sides are dealt out anew and adaptive execution can split a key with very many rows.
    """
    alone = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*new.columns)).alias("_row")).where("_n = 1").select("_row.*")
    taken = alone.join(existing.select(key), key, "left_anti").select(*new.columns)
    keys = taken.select(F.col(key).alias("_k"), F.xxhash64(key).alias("_h"))
    told = new.where(F.col(key).isNotNull()).withColumn("_g", F.xxhash64(key))
    refused = told.join(keys, (F.col("_g") == F.col("_h")) & (F.col(key) == F.col("_k")), "left_anti").select(*new.columns)
    return taken, refused


def contents(rows: DataFrame, ids: DataFrame | None = None, content_hash: str | None = None, storage: str | None = None) -> DataFrame:
    """Content metadata by id, by digest or by where it is stored, the newest first."""
    out = rows.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else rows
    out = out.where(F.col("content_hash") == content_hash) if content_hash is not None else out
    out = out.where(F.col("storage_type") == check(storage, STORAGE, "storage type")) if storage is not None else out
    return out.orderBy(F.desc("created_at"), "id")


def known(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The keys asked for, each once, and whether a row has it."""
    there = rows.select(F.col(key).alias("_k")).distinct()
    return asked.select(key).distinct().join(there, F.col(key) == F.col("_k"), "left").select(key, F.col("_k").isNotNull().alias("exists"))
