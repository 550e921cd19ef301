"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has 64 bits, the majority of its shingle hashes bit by bit. Equal fingerprints are one
class. Classes at ``RADIUS`` = 2 or fewer differing bits are found by splitting a fingerprint in two segments of
32 bits, A and B. Two fingerprints at distance 2 or less agree in A, or agree in B, or differ in one bit of each:

* A equal, B within 2: one of three parts of B is equal too; the table is keyed by A and that part.
* B equal, A within 2: the same with the segments exchanged.
* A within 1, B within 1: the ball of radius 1 around A is enumerated (only the side that holds the differing bit
  enumerates, clearing each of its set bits) and fetched together with an equal half of B.

Every fetched pair's complete distance is verified in the join. Keys have 42 bits or more, so a bucket is small
even if very many documents share a segment: classes hold one row however many copies they have, and a class has
at most 2,080 others within 2 bits. No bucket is capped.

Nulls and edge cases: null, empty and blank texts have fingerprint 0 and link like any others; a text of one or
two words is one shingle; a null doc_id takes part, but is never a component's smallest id unless all are null;
repeated rows give a row each; an empty table gives an empty result; clashing columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, pieces
from tesserae.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    found = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() takes \x20 and \x09-\x0D
    if not found:
        return []
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` hashes, the bits set in over half of each run; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    # eight counters of 8 bits share a number; runs are summed 255 at a time so that none overflows
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), parts)
    begin = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    at = np.cumsum(parts) - parts
    bits = np.zeros(len(n), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _ONES, begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(lanes, at, axis=0)
        over = (2 * sums > n[:, None]).astype(np.uint64)
        for byte in range(8):
            bits |= over[:, byte] << np.uint64(8 * byte + shift)
    out[full] = bits
    return out


def fingerprint_batch(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    each = [shingle_hashes(t, size) for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((h for hashes in each for h in hashes), np.uint64, int(counts.sum()))
    return majorities(flat, counts)


def fingerprints(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE, beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp): the fingerprint of each row's whole text as a signed long. Columns ``beside`` are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprint_batch(part.column("text").to_pylist(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(fp)], names=[*carried, "fp"])

    carried, kinds = [key, *beside], dict(docs.dtypes)
    return docs.select(*carried, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", fp bigint")


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1))


def _key(case: int, segment: Column, part: Column | None, part_bits: int) -> Column:
    """Segment (32 bits), part and case in one long."""
    return F.shiftleft(F.shiftleft(segment, part_bits).bitwiseOR(part), 4).bitwiseOR(F.lit(case).cast("long"))


def near_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints at distance 1 to ``RADIUS``. ``fps``: a row per distinct fp."""
    fp = F.col("fp")
    upper, lower = _bits(fp, 32, 32), _bits(fp, 0, 32)
    thirds = ((0, 11), (11, 11), (22, 10))
    same = [_key(1 + j, upper, _bits(lower, at, n), 11) for j, (at, n) in enumerate(thirds)]
    same += [_key(4 + j, lower, _bits(upper, at, n), 11) for j, (at, n) in enumerate(thirds)]
    halves = [(7 + j, _bits(lower, 16 * j, 16)) for j in range(2)]
    table = [*same, *(_key(case, upper, half, 16) for case, half in halves)]
    ball = [
        F.when(_bits(upper, bit, 1) == 1, _key(case, upper.bitwiseXOR(F.lit(1 << bit).cast("long")), half, 16))
        for bit in range(32) for case, half in halves
    ]
    probe = F.filter(F.array(*same, *ball), lambda x: x.isNotNull())
    left = fps.select(F.explode(probe).alias("key"), fp.alias("a"))
    right = fps.select(F.explode(F.array(*table)).alias("key2"), fp.alias("b"))
    ordered = (F.col("key").bitwiseAND(F.lit(15)) >= 7) | (F.col("a") < F.col("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = left.join(right, (F.col("key") == F.col("key2")) & ordered & close)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def leasts(fps: DataFrame, first: Column) -> DataFrame:
    """(c, least): for each distinct fingerprint c, the least ``first`` of all rows in its component."""
    classes = cut(fps.groupBy("fp").agg(F.min(first).alias("first")), "simhash-classes")
    linked = components(cut(near_pairs(classes.select("fp")), "simhash-pairs"))
    named = linked.join(classes.withColumnRenamed("fp", "node"), "node")
    least = cut(named.groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
    linked = cut(linked.join(least, "root").select(F.col("node").alias("fp"), "least"), "simhash-linked")
    return classes.join(linked, "fp", "left").select(F.col("fp").alias("c"), F.coalesce("least", "first").alias("least"))


def groups(fps: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id): each row's smallest reachable key."""
    return fps.join(leasts(fps, F.col(key)), F.col("fp") == F.col("c")).select(key, "fp", F.col("least").alias("component_id"))


def _name(key: Column, digest: Column) -> Column:
    """A document's key and digest as one text that is never null, so that grouping and joining by it share a shuffle."""
    return F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")), F.lit("/"), digest)


def near_dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The input with one document of each group, that of the smallest key (null only if all are null). Rows that repeat this key and text stay once.

    A document is told by its key and its text's digest: others of the same key, or without key, are documents of their own.
    """
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    told = docs.select(F.col(key).alias("k"), digest.alias("d"), "text")
    fps = cut(fingerprints(told, "k", beside=("d",)), "simhash-fingerprints")
    first = leasts(fps, F.struct(F.col("k").isNull().alias("none"), "k", "d")).select("least.k", "least.d").distinct()
    first = first.select(_name(F.col("k"), F.col("d")).alias("first"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), _name(F.col(key), digest).alias("name"))
    # repeated rows meet once, before the shuffle and after; the join has the same key, so texts are dealt out only once
    return rows.dropDuplicates(["name"]).join(first, F.col("name") == F.col("first"), "left_semi").select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = groups(cut(fingerprints(docs), "simhash-fingerprints"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
