"""The content store: identity by digest, deduplication, orphans, quota, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.catalog import running

MAX_FILE, MAX_STORE, WARN, REJECT = 50 << 20, 2 << 30, 75.0, 95.0
MB = 1024.0 * 1024.0


def content_id(content: Column) -> Column:
    return F.sha2(content, 256)


def identify(rows: DataFrame, content: str, key: str) -> DataFrame:
    """(key, content_id, size, was_deduped): the first row of each content by key is stored, the others find it there.

    Rows look for themselves among the first ones, by key: a content that very many rows have is a load on no task, since only
    its least key is ever brought together, and that is aggregated before the shuffle.
    """
    each = rows.select(key, content_id(F.col(content)).alias("content_id"), F.octet_length(F.col(content)).cast("long").alias("size"))
    first = each.groupBy("content_id").agg(F.min(key).alias("_first")).select(F.col("content_id").alias("_content"), "_first")
    # null keys are never the least: they are told apart from others only if a content has no other
    same = F.col(key).eqNullSafe(F.col("_first")) & (F.col("content_id") == F.col("_content"))
    return each.join(first, same, "left").select(key, "content_id", "size", F.col("_content").isNull().alias("was_deduped"))


def new_content(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What ``identify`` gave for ``incoming``, without contents that are stored already."""
    return incoming.where("NOT was_deduped").join(stored.select("content_id"), "content_id", "left_anti")


def dedup_report(identified: DataFrame) -> DataFrame:
    gone = F.col("was_deduped")
    return identified.agg(
        F.count_if(gone).alias("removed"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("freed"), F.count_if(~gone).alias("kept")
    )


def orphans(files: DataFrame, catalog: DataFrame, key: str = "content_id") -> DataFrame:
    return files.join(catalog.select(key), key, "left_anti")


def statistics(files: DataFrame, size: str = "size", most: int = MAX_STORE) -> DataFrame:
    total = F.coalesce(F.sum(size), F.lit(0))
    percent = F.round(100.0 * total / most, 2)
    return files.agg(
        F.count("*").alias("files"), total.alias("bytes"), F.round(total / MB, 2).alias("mb"),
        F.round(F.when(F.count("*") > 0, total / F.count("*")).otherwise(F.lit(0.0)), 2).alias("average"),
        percent.alias("used_percent"), F.greatest(F.lit(0), F.lit(most) - total).alias("left"), status(percent).alias("status"),
    )


def status(percent: Column) -> Column:
    return F.when(percent >= REJECT, "critical").when(percent >= WARN, "warning").when(percent >= 50, "notice").otherwise("ok")


def advice(percent: Column) -> Column:
    return (
        F.when(percent >= REJECT, "free space before anything else is taken in").when(percent >= WARN, "remove orphans and duplicates soon")
        .when(percent >= 50, "watch the store's growth").otherwise("nothing to do")
    )


def admit(incoming: DataFrame, size: str, order: str, used: int = 0, most: int = MAX_STORE, most_file: int = MAX_FILE) -> DataFrame:
    """The input with ``decision``: 'too large', 'rejected' (the store would be over 95 % with it), 'warning' (over 75 %) or 'accepted'.

    Files are projected in order, all before them counted.
    """
    out = running(incoming, size, [], [order])
    percent = 100.0 * (F.lit(used) + F.col("before") + F.col(size)) / most
    decision = F.when(F.col(size) > most_file, "too large").when(percent > REJECT, "rejected").when(percent > WARN, "warning").otherwise("accepted")
    return out.withColumn("decision", decision).drop("before")


def intact(rows: DataFrame, content: str, expected: str) -> DataFrame:
    return rows.withColumn("is_valid", content_id(F.col(content)) == F.lower(expected))


def fetch(asked: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """A row per id asked for: base64 of its content, or the error."""
    found = asked.join(stored.select(key, content), key, "left")
    return found.select(
        key, F.base64(F.col(content)).alias("data"), F.when(F.col(content).isNull(), F.lit("content not found")).alias("error")
    )


def verify(recorded: DataFrame, actual: DataFrame, tolerance: int = 1024) -> DataFrame:
    """Recorded (files, bytes) against the actual ones, each a single row."""
    r = recorded.select(F.col("files").alias("recorded_files"), F.col("bytes").alias("recorded_bytes"), F.lit(1).alias("_j"))
    both = r.join(actual.select("files", "bytes", F.lit(1).alias("_j")), "_j").drop("_j")
    same = (F.col("files") == F.col("recorded_files")) & (F.abs(F.col("bytes") - F.col("recorded_bytes")) <= tolerance)
    return both.withColumn("is_valid", same)


def repair(recorded: DataFrame, actual: DataFrame, tolerance: int = 1024) -> DataFrame:
    """The counts to record: the recorded ones where ``verify`` finds them right, else the actual ones."""
    told = verify(recorded, actual, tolerance)
    right = lambda name: F.when(F.col("is_valid"), F.col(f"recorded_{name}")).otherwise(F.col(name)).alias(name)
    return told.select(right("files"), right("bytes"), (~F.col("is_valid")).alias("repaired"))


def missing_files(recorded: DataFrame, files: DataFrame, key: str = "content_id") -> DataFrame:
    """Content that is recorded but whose file is gone."""
    return recorded.join(files.select(key), key, "left_anti")


def readable(size: Column) -> Column:
    """Bytes as '1.5 MB'."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        number = F.regexp_replace(F.round(size / 1024.0**k, 2).cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
        out = out.when((size < 1024 ** (k + 1)) | F.lit(k == 4), F.concat(number, F.lit(f" {unit}")))
    return out
