"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / quality``; a smaller key is sampled earlier, so documents of
higher quality weight come first more often. A source's target is met by complete epochs (every document once
per epoch) and then by the documents with the smallest keys, up to the words that are left: the sizes are
prefix-summed in key order. The prefix sum never gathers a source in one task: key ranges are summed first, and
only the one range that holds the budget's edge is ordered row by row. Ranges are those of the key's logarithm, ``RANGES`` to
a doubling: a weight only shifts it, so whatever the weights are, a range holds less than one in 5,000 documents of a source.

Sources are numbered over ranges of their order, and targets are found by sums over all sources, round by round: sources
too may be many.

A document draws by its id and its text's digest, which also settle the order of equal keys: the mix is the same whatever the order in
which rows are read.

Nulls and edge cases: a null text has size 0 and takes 0 words; a null source is a source of its own, last in
order; documents without words have keys like others and never change a sum; rows without id, or of one id with other texts,
draw keys of their own; rows that repeat id and text have equal keys and are interchangeable: how many of them are taken is settled, not
which; an empty table gives an empty result. Other columns of the input pass through ``mix``
unchanged; the names of ``ADDED`` are replaced where they clash in ``decide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.llm.common import UNIT_DRAW_SQL, cut, numbered, unit_draw, word_count

MAX_EPOCHS = 3
#: Key ranges to each doubling of a key.
RANGES = 1024
ADDED = ("size", "source_size", "target", "copies", "taken")
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that aren't markup symbols. Empty and null texts weigh 0.1."""
    n = F.length(F.coalesce(text, F.lit("")))
    clean = F.length(F.translate(F.coalesce(text, F.lit("")), SYMBOLS, ""))
    return F.when(n > 0, F.lit(0.1) + F.lit(0.9) * clean / n).otherwise(F.lit(0.1))


def targets(sizes: DataFrame, cap: int = MAX_EPOCHS) -> DataFrame:
    """Words that each source shall give.

    ``sizes``: (source, source_size), a row per source. Weights are 1, 2, 3, repeating in code point order of
    the source, null last. All words are shared by weight; what exceeds ``cap`` times a source's size is shared
    anew by weight among the others until none is above.
    """
    s = numbered(sizes, "mix-sources", [F.col("source").asc_nulls_last()])
    s = cut(s.select("source", "source_size", (F.col("place") % 3 + 1).alias("weight"), (F.col("source_size") * cap).alias("cap")), "mix-weights")
    words = s.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:  # words of one weight: a round caps at least one source more, or is the last
        over = F.col("cap") <= F.col("weight") * F.lit(share)
        found = s.agg(F.sum(F.when(over, F.col("cap"))).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weights"), F.sum(F.when(over, 1).otherwise(0)).alias("n")).first()
        if found["n"] == capped or not found["weights"]:
            break
        capped, share = found["n"], (words - (found["given"] or 0)) / found["weights"]
    over = F.col("cap") <= F.col("weight") * F.lit(share)
    return s.select("source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def decide(docs: DataFrame, key: str = "doc_id", seed: str = "mix-1", beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, draw): how often each document goes into the mix. A row per input row.

    Columns ``beside`` of the input are carried along.
    """
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    draw = -F.log(unit_draw(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), digest)) / quality_weight(F.col("text"))
    sized = cut(docs.select(key, "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), digest.alias("_digest"), *beside), "mix-sizes")
    sized = sized.withColumn("range", F.floor(F.log2("draw") * RANGES).cast("int"))

    # tables by source are written, so their size decides whether joins send them to every task
    by_range = cut(sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = cut(goal.withColumnRenamed("source", "s"), "mix-goals")
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = by_range.withColumn("before", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    # of each source, where the last range that is taken whole ends; ranges after the edge's are not taken
    fits = before.join(goal, F.col("source").eqNullSafe(F.col("s")))
    fits = fits.where(F.col("before") < F.col("rest")).groupBy("s").agg(F.max_by(F.struct(F.col("range").alias("edge"), "before"), "range").alias("e"))
    fits = cut(fits.select(F.col("s").alias("t"), "e.edge", "e.before"), "mix-edges")
    goal = cut(goal.join(fits, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "mix-bounds")

    placed = sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_edge = F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
    whole = placed.where(~at_edge).withColumn("extra", F.when(F.col("range") < F.col("edge"), 1).otherwise(0))
    in_order = W.partitionBy("source").orderBy("draw", F.col(key).asc_nulls_first(), "_digest").rowsBetween(W.unboundedPreceding, -1)
    ahead_of_it = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2
    edge = placed.where(at_edge).withColumn("extra", F.when(ahead_of_it <= F.col("rest"), 1).otherwise(0))
    copies = (F.col("epochs") + F.col("extra")).cast("long")
    return whole.unionByName(edge).select(
        key, "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies"), (copies * F.col("size")).alias("taken"), "draw", *beside,
    )


def mix(docs: DataFrame, key: str = "doc_id", seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: each document as often as it was taken, with the input's columns.

    Decisions are joined by key, source and the text's digest. Of rows that repeat all three, the edge may take some once more than
    others: these rows (one group a source at most) are numbered over ranges of their order, and the first of them get the extra copy.
    """
    digest = F.md5(F.col("text").cast("binary"))
    told = docs.select(F.col(key).alias("k"), "source", "text", digest.alias("d"))
    chosen = decide(told, "k", seed, ("d",)).where("size > 0").groupBy("k", "source", "d").agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    chosen = chosen.where("all > 0").select("k", F.col("source").alias("s"), "d", F.floor(F.col("all") / F.col("rows")).alias("n"), (F.col("all") % F.col("rows")).alias("more"))
    chosen = cut(chosen, "mix-chosen")
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"))
    out = rows.join(chosen, F.col(f"row.{key}").eqNullSafe(F.col("k")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("d")))
    uneven = chosen.where("more > 0")
    if not uneven.isEmpty():
        tied = numbered(out.where("more > 0"), "mix-tied", [], ["k", "s", "d"])
        tied = tied.withColumn("n", F.col("n") + F.when(F.col("place") < F.col("more"), 1).otherwise(0))
        out = out.where("more = 0").unionByName(tied.select(*out.columns))
    return out.where("n > 0").select("row", F.explode(F.expr("sequence(1, n)"))).select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return decide(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP8_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    coalesce(md5(text), 'null') AS digest, -ln({UNIT_DRAW_SQL.format("'mix-1/' || coalesce(doc_id::VARCHAR, 'null') || '/' || coalesce(md5(text), 'null')")})
      / (CASE WHEN length(coalesce(text, '')) > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * length(translate(text, '#*$%&|<>', '')) / length(text) ELSE 0.1::DOUBLE END) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source),
-- the rounds of the rule as it is stated: share, cap, share the excess anew
rounds AS (
  SELECT 0 AS round, source, source_size, weight, FALSE AS capped, 0.0::DOUBLE AS target FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped OR share >= 3 * source_size, CASE WHEN capped OR share >= 3 * source_size THEN 3.0::DOUBLE * source_size ELSE share END
  FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE * weight / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) AS share FROM rounds WHERE round < 24)),
goal AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM rounds WHERE round = 24),
ordered AS (
  SELECT s.*, g.source_size, g.target, g.epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2 AS mid
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((epochs + CASE WHEN mid <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ordered
"""
