"""Vector queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import vectors as fn
from tesserae.operators import ann, knn

V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"


def table(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def first(rows: DataFrame) -> list[float]:
    return rows.where("vec_id = 0").select("embedding").first()[0]


def _against_first(function):
    def run(spark, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir)
        q = F.array(*[F.lit(float(x)) for x in first(rows)])
        return rows.select("vec_id", fn.rounded(function(F.col("embedding"), q)).alias("value"))

    return run


def magnitudes(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("vec_id", F.round(fn.magnitude(F.col("embedding")), 6).alias("value"))


def normalized(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("vec_id", F.transform(fn.normalized(F.col("embedding")), lambda x: fn.rounded(x)).alias("value"))


def validated(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("vec_id", fn.problem(F.col("embedding")).alias("problem"), fn.off_unit(F.col("embedding")).alias("off_unit"))


def knn_single(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir)
    return knn.top_k(rows, first(rows), 10)


def knn_filtered(spark, sf_dir: str) -> DataFrame:
    """The filter comes before the search."""
    rows = table(spark, sf_dir)
    return knn.top_k(rows.where("label = 3"), first(rows), 10)


def knn_batch(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir)
    return knn.batch_top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def knn_lsh(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir)
    return knn.approximate_top_k(rows, rows.where("vec_id % 100 = 0"), len(first(rows)), 10)


def ann_search(spark, sf_dir: str) -> DataFrame:
    """The exact join through the index: each query goes to its own cell and then to those that its bound leaves."""
    rows = table(spark, sf_dir)
    return ann.join(rows, rows.where("vec_id % 100 = 0"), ann.Quantiser.fit(rows))[0]


def ann_recall(spark, sf_dir: str) -> DataFrame:
    """Whether probing as many cells as the index was measured to need finds nine tenths of the true neighbours."""
    rows = table(spark, sf_dir)
    asked, quantiser = rows.where("vec_id % 100 = 0"), ann.Quantiser.fit(rows)
    return _reached(ann.batch(rows, asked, quantiser), ann.join(rows, asked, quantiser)[0])


def knn_lsh_recall(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir)
    return _reached(knn_lsh(spark, sf_dir), knn.batch_top_k(rows, rows.where("vec_id % 100 = 0"), 10))


def _reached(found: DataFrame, true: DataFrame) -> DataFrame:
    true = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return true.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def groups(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))


def compatible(spark, sf_dir: str) -> DataFrame:
    """Vectors whose length isn't that of the model."""
    rows = table(spark, sf_dir).withColumn("embedding", F.expr("slice(embedding, 1, size(embedding) - cast(vec_id % 3 as int))"))
    return rows.where(F.size("embedding") != 64).select("vec_id", F.size("embedding").alias("dim"))


QUERIES = {
    "vec_cosine": _against_first(fn.cosine), "vec_euclidean": _against_first(fn.euclidean), "vec_dot": _against_first(fn.dot), "vec_magnitude": magnitudes,
    "vec_normalize": normalized, "vec_validate": validated, "knn_single": knn_single, "knn_filtered": knn_filtered, "knn_batch": knn_batch,
    "knn_lsh": knn_lsh, "ann_search": ann_search, "ann_recall": ann_recall, "knn_lsh_recall": knn_lsh_recall,
    "vec_group_partition": groups, "vec_dimension_check": compatible,
}
_TOP = "SELECT vec_id, score, round(1 - score, 6) AS distance, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10"
ORACLE_SQL = {
    "vec_cosine": f"{V} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS value FROM v, q",
    "vec_euclidean": f"{V} SELECT vec_id, round(list_distance(e, q), 6) AS value FROM v, q",
    "vec_dot": f"{V} SELECT vec_id, round(list_dot_product(e, q), 6) AS value FROM v, q",
    "vec_magnitude": f"{V} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS value FROM v",
    "vec_normalize": f"{V} SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS value FROM v",
    "vec_validate": f"{V} SELECT vec_id, CASE WHEN len(e) = 0 THEN 'empty' WHEN len(list_filter(e, lambda x: NOT isfinite(x))) > 0 THEN 'not finite' WHEN len(list_filter(e, lambda x: x <> 0)) = 0 THEN 'all zero' WHEN sqrt(list_dot_product(e, e)) < 1e-6 THEN 'too short' END AS problem, abs(sqrt(list_dot_product(e, e)) - 1) > 0.01 AS off_unit FROM v",
    "knn_single": f"{V}, s AS (SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q) {_TOP}",
    "knn_filtered": f"{V}, s AS (SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE label = 3) {_TOP}",
    "knn_batch": f"{V}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10",
    "ann_recall": "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "vec_group_partition": "SELECT label, count(*) AS n, min(len(embedding))::INT AS least_dim, max(len(embedding))::INT AS most_dim FROM embeddings GROUP BY label",
    "vec_dimension_check": "SELECT vec_id, (len(embedding) - vec_id % 3)::INT AS dim FROM embeddings WHERE len(embedding) - vec_id % 3 <> 64",
}
ORACLE_SQL |= {"ann_search": ORACLE_SQL["knn_batch"], "knn_lsh_recall": ORACLE_SQL["ann_recall"]}
