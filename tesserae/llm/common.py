"""What the training-data operators share: word rules, scratch tables, Arrow text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word is a maximal run of characters outside this class.
SEPARATORS = "[\\x20\\x09-\\x0D]+"

#: Shuffle files go as soon as a job is done, and the driver keeps no long descriptions of the plans of many small jobs.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000"}
_made: dict[str, SparkSession] = {}


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) has a folder of
    its own; on a cluster executors would each write to their own disk, so that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/tesserae-scratch"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release_scratch)
    _made[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs neither recompute it nor depend on executors that ran it.

    The shuffle files of the job are deleted as soon as it is done, instead of when the driver collects its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Delete intermediate tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _made:
            _delete(path, _made.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str, keys: list[Column], within: list[str] | None = None, rows_each: int = 200_000) -> DataFrame:
    """``df`` with a column ``place``: 0, 1, 2, ... in the order of ``keys``, without gaps, within each value of columns ``within`` (sorted first).

    Rows are dealt to ranges of the order, as many as the table needs; a row's place is the one in its range after the
    rows of the ranges before, which are counted. Neither a group nor the table is ever in one task. Rows that tie are
    told apart by where they were found, so they too can be split; which of them comes first is left open.
    """
    within = within or []
    n = df.count()
    order = [*(F.col(c).asc_nulls_first() for c in within), *keys]
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranges = tagged.repartitionByRange(max(1, -(-n // rows_each)), *order, "_tie").sortWithinPartitions(*order, "_tie")
    rows = cut(ranges.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), name)
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part"), *(F.col(c).alias(f"_in_{c}") for c in within)).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = W.partitionBy(*(f"_in_{c}" for c in within)) if within else W.partitionBy(F.lit(0))  # a row per range (and group)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_low"))
    same = part == F.col("_part")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
    sizes = cut(sizes.drop("_n", "_low"), f"{name}-ranges")
    return rows.join(sizes, same).withColumn("place", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base", *(f"_in_{c}" for c in within))


def release_scratch() -> None:
    """Delete the intermediate tables of this driver; results that read them can't be run after that."""
    for path, spark in list(_made.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session ended before: what is left belongs to the folder's own clean-up
            pass
        _made.pop(path, None)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the n + 1 offsets into them. Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (one row at least), so that working arrays stay small."""
    if not batch.num_rows:
        return
    lengths = np.diff(text_bytes(batch.column(column))[1])
    group = np.cumsum(lengths) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def plain(batch: pa.RecordBatch, like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in like], schema=like)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only: 52 bits of an MD5 digest, which SQL engines agree on."""
    head = F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


#: The same in DuckDB; {} takes a string expression.
UNIT_DRAW_SQL = "((('0x' || substr(md5({}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
