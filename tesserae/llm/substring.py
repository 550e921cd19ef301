"""Substring dedup by level-wise doubling.

A word is removed if a window of ``WINDOW`` consecutive words that covers it also starts earlier in the corpus
(in a document of smaller id, or earlier in the same one). Windows are found level by level:

1. Windows of half the length are looked at first, and of these only anchors: in every full window, the half
   window with the least hash (the leftmost of equal ones). Equal full windows have equal anchors at the same
   place, so a full window can repeat only if its anchor does. Anchors are about a sixth of all positions.
2. Only where an anchor's hash occurs twice or more is the window extended to twice that length: the full windows
   that have this anchor. Their hashes are counted, and the first place of each that repeats is kept.
3. Windows that survive, other than first ones, cover the words to remove. Longer repeats are covered by their full
   windows, so no candidate is left to extend.

Half windows are compared by 64-bit hashes, where a collision only adds a candidate; full windows by BLAKE2b-128 digests of
their words themselves. Copies of whole texts are found beforehand by their digests: all their windows repeat, so
only the first needs these levels. Frequent hashes are counted before they are shuffled, and counts are written
before they are joined back to the places, so that no hash's places are gathered in one task: Spark splits the join.

Nulls and edge cases: a null text has no words; texts with fewer words than a window keep all; a null doc_id sorts
before all others. A document is a doc_id and a text: rows that repeat both are one document, each returned with its
removals; rows of one doc_id (or of none) with other texts are documents of their own, in the order of their digests. An
empty table gives an empty result; other columns pass through ``remove_repeats``, but for those named like the columns
it adds, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tesserae.llm.common import cut, free, mix64, numbered, pieces, plain, text_bytes

WINDOW = 20
#: The end of a run that covers a whole text of a window's length or more.
ALL = (1 << 31) - 1
#: Names of columns beside those of the input, which may have any others.
_DOC, _ID, _RUNS = "__removal_doc", "__removal_id", "__removal_runs"
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, extended as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse)]))
        return self.up[:n], self.down[:n]


_powers = _Powers(_BASE)


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: _Powers) -> np.ndarray:
    """The polynomial hash of each run values[first:last], by differences of prefix sums."""
    up, down = powers(len(values) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return (total[last] - total[first]) * down[first]


class Words:
    """The words of several texts: where each starts and ends in the joined bytes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        space = (data == 32) | ((data >= 9) & (data <= 13))
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~space
        starts_text = np.zeros(len(data) + 1, bool)
        starts_text[offsets[:-1]] = True
        begins = inside[1:-1] & (~inside[:-2] | starts_text[:-1])
        ends = inside[1:-1] & (~inside[2:] | starts_text[1:])
        self.data, self.start, self.end = data, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: equal words have equal ones, others may too."""
        return mix64(_sums(_TABLE[self.data], self.start, self.end, _powers) + (self.end - self.start).astype(np.uint64))

    def digests(self, start: np.ndarray, length: int) -> np.ndarray:
        """BLAKE2b-128 of ``length`` words from each place given (none beyond its text's end), joined by one space: two numbers a window."""
        size = self.end - self.start
        after = np.cumsum(size + 1)
        gap = np.ones(int(after[-1]) if len(after) else 0, bool)
        gap[after - 1] = False
        line = np.full(len(gap), 32, np.uint8)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        line[gap] = self.data[np.cumsum(inside[:-1]).astype(bool)]
        line = line.tobytes()
        begins, ends = (after - size - 1)[start], after[start + length - 1] - 1
        made = b"".join([hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        return np.frombuffer(made, np.int64).reshape(-1, 2)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, text): the first word of each window, and the text it is in."""
        fits = np.maximum(self.n - length + 1, 0)
        text = np.repeat(np.arange(len(fits)), fits)
        start = np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits) + self.first[:-1][text]
        return start, text


def window_hashes(hashes: np.ndarray, start: np.ndarray, length: int, powers: _Powers) -> np.ndarray:
    return mix64(_sums(hashes, start, start + length, powers))


def anchors(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, anchor, anchor_hash) of every window: the least half window in it, leftmost of equal ones."""
    start, text = words.windows(length)
    half = length // 2
    if not len(start):
        return start, text, start, np.zeros(0, np.uint64)
    every = np.arange(len(hashes) - half + 1)
    h = window_hashes(hashes, every, half, _powers)
    # least of the half + 1 (or + 2) candidates: by doubling, the earlier one wins ties
    span = length - half + 1
    best, reach = every.copy(), 1
    while reach < span:
        step = min(reach, span - reach)
        other = best[step:]
        mine = best[: len(other)]
        best = np.where(h[other] < h[mine], other, mine)
        reach += step
    at = best[start]
    return start, text, at, h[at]


_ANCHORS = pa.schema([("doc", pa.int64()), ("at", pa.int32()), ("h", pa.int64())])
_WINDOWS = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("at", pa.int32()), ("again", pa.bool_())])


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(*text_bytes(part.column("text")))
                _, text, at, h = anchors(words, words.hashes(), length)
                keep = np.ones(len(at), bool)
                keep[1:] = at[1:] != at[:-1]
                text, at, h = text[keep], at[keep], h[keep]
                ids = part.column("doc").take(pa.array(text))
                place = (at - words.first[:-1][text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array(h.view(np.int64))], schema=_ANCHORS)

    return run


def _starts(words: Words, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in texts, given as a list column, as word numbers; and the text of each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    return np.minimum(flat, words.n[text]) + words.first[:-1][text], text


def _window_rows(length: int):
    """The full windows whose anchor is listed in column ``places``: the digest of their words, their place, and whether the same window
    starts earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(*text_bytes(part.column("text")))
                hashes = words.hashes()
                start, text, at, _ = anchors(words, hashes, length)
                listed = np.zeros(len(hashes) + 1, bool)
                listed[_starts(words, part.column("places"))[0]] = True
                start, text = start[listed[at]], text[listed[at]]
                digest = words.digests(start, length)
                h, g = digest[:, 0], digest[:, 1]
                again = np.zeros(len(start), bool)
                order = np.lexsort((start, g, h, text))
                same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1])
                again[order[1:][same]] = True
                place = (start - words.first[:-1][text]).astype(np.int32)
                columns = [part.column("doc").take(pa.array(text)), pa.array(h), pa.array(g), pa.array(place), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, schema=_WINDOWS)

    return run


def _covered(words: Words, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _removal_rows(names: list[str], schema: pa.Schema, length: int):
    """Texts without the words of the runs in column ``_RUNS`` (of begin and end): what is kept is joined by one space, a text that keeps all is unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(*text_bytes(part.column("text")))
                runs = part.column(_RUNS)
                n = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(len(n)), n)
                flat = runs.flatten()
                short = words.n[text] < length
                begins, ends = (np.where(short, 0, 1) * np.minimum(flat.field(k).to_numpy(zero_copy_only=False), words.n[text]) + words.first[:-1][text] for k in (0, 1))
                gone = _covered(words, begins, ends)
                removed, kept, digests = [], [], []
                for k, whole in enumerate(part.column("text").to_pylist()):
                    a, b = words.first[k], words.first[k + 1]
                    line = (whole or "").encode().split()
                    count = int(gone[a:b].sum())
                    if count:
                        line = [w for w, out in zip(line, gone[a:b].tolist(), strict=True) if not out]
                    joined = b" ".join(line)
                    removed.append(count)
                    kept.append(joined.decode() if count else whole)
                    digests.append(hashlib.sha256(joined).hexdigest())
                made = {"n_words": pa.array(words.n.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "text": pa.array(kept, pa.string())}
                made |= {name: part.column(name) for name in names if name not in made}
                yield plain(pa.RecordBatch.from_pydict({f.name: made[f.name] for f in schema}), schema)

    return run


def identified(docs: DataFrame, name: str = _DOC) -> DataFrame:
    """``docs`` with a number for each document, in the order of doc_id (null first), then of the text's digest.

    Where every doc_id has one text, the doc_id is that number. Otherwise the distinct pairs of doc_id and digest are numbered
    in order, and their numbers are joined back.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    told = docs.select(key.alias("k"), F.col("doc_id").isNull().alias("none"), digest.alias("x"))
    told = told.groupBy("k").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("none", "x") for f in (F.min, F.max)))
    if told.where("min_none <> max_none OR min_x <> max_x").isEmpty():
        return docs.withColumn(name, key)
    pairs = docs.select("doc_id", digest.alias("digest")).distinct()
    places = numbered(pairs, "substring-documents", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    places = cut(places.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"), F.col("place").alias(name)), "substring-numbers")
    return docs.join(places, F.col("doc_id").eqNullSafe(F.col("_i")) & (digest == F.col("_d"))).drop("_i", "_d")


def copies(docs: DataFrame) -> DataFrame:
    """(doc): documents whose text an earlier one has too. All their windows repeat, and none of them is a first one."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    each = cut(docs.where(F.octet_length("text") > 0).select("doc", digest.alias("digest")), "text-digests")
    first = each.groupBy("digest").agg(F.min("doc").alias("f"), F.max("doc").alias("l")).where("f < l").drop("l")
    # written first: a join straight after the aggregation would use its partitioning, and Spark could not split a frequent text's copies
    first = cut(first.select(F.col("digest").alias("digest2"), "f"), "first-texts")
    return each.join(first, F.col("digest") == F.col("digest2")).where("doc > f").select("doc").distinct()


def repeated_runs(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc, runs): for each document of ``docs`` (doc, text) with words to remove, the runs of words (begin, end) that later windows cover.

    Copies of whole texts are settled first; the other documents' windows are judged among themselves. Each step is a job of
    its own, whose shuffle files are deleted when it is done; tables of ids are written, so Spark knows from their size
    whether they can be sent to every task.
    """
    same = cut(copies(docs), "copies")
    fresh = docs.join(same, "doc", "left_anti")
    places = fresh.mapInArrow(_anchor_rows(length), "doc bigint, at int, h bigint")
    counted = cut(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("r")), "repeated-anchors")
    alive = places.join(counted, F.col("h") == F.col("r"), "left_semi")
    listed = cut(alive.groupBy("doc").agg(F.collect_list("at").alias("places")), "anchors")
    free(counted)
    windows = docs.join(listed, "doc").select("doc", "text", "places")
    windows = windows.mapInArrow(_window_rows(length), "doc bigint, h bigint, g bigint, at int, again boolean")
    first = windows.where("NOT again").groupBy("h", "g").agg(F.min("doc").alias("d2"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select(F.col("h").alias("h2"), F.col("g").alias("g2"), "d2"), "first-windows")
    later = windows.join(first, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left").where("again OR doc > d2")
    runs = later.select("doc", "at").groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("s")).select("doc", _merged("s", length).alias("runs"))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.lit(ALL).alias("end")))
    return runs.unionByName(same.select("doc", whole.alias("runs")))


def _merged(column: str, length: int):
    """Sorted window places as disjoint runs of words: a run begins where a gap precedes and ends where one follows."""
    begins = F.expr(f"filter({column}, (x, i) -> i = 0 OR x - {column}[i - 1] > {length})")
    ends = F.expr(f"transform(filter({column}, (x, i) -> i = size({column}) - 1 OR {column}[i + 1] - x > {length}), x -> x + {length})")
    return F.arrays_zip(begins.alias("begin"), ends.alias("end"))


def remove_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """The input with the texts' repeats removed, and n_words, n_removed and kept_sha256 (of the kept words)."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    known = identified(docs.select(*names))
    runs = cut(repeated_runs(known.select(F.col(_DOC).alias("doc"), "text"), length), "runs").select(F.col("doc").alias(_ID), F.col("runs").alias(_RUNS))
    both = known.join(runs, F.col(_DOC) == F.col(_ID), "left").drop(_ID, _DOC)
    out = T.StructType([*docs.select(*names).schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return both.mapInArrow(_removal_rows(names, to_arrow_schema(out), length), out)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM w),
win AS (
  SELECT *, string_agg(x, ' ') OVER ahead AS s, count(*) OVER ahead = 20 AS whole FROM each
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
seen AS (SELECT doc_id, k, x, whole AND row_number() OVER (PARTITION BY whole, s ORDER BY doc_id, k) > 1 AS again FROM win),
gone AS (SELECT doc_id, k, x, max(again::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM seen),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
