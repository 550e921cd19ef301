"""Reranking of search results: (query_id, query, id, score, content, title, source, content_type) rows, and more columns kept as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import ranking, vectors
from tesserae.operators import embedding

STRATEGIES = ("lexical", "cross-encoder", "text-derived", "metadata", "disabled")
#: Scores of a model that are closer together than this tell nothing: the lexical score is used instead.
LEAST_SPREAD = 0.1


def ranked(results: DataFrame, score: str = "score", by: tuple[str, ...] = ("query_id",), tie: str = "id") -> DataFrame:
    """Adds rank (from 1) by descending score, and rounded_score for display."""
    order = W.partitionBy(*by).orderBy(F.desc(score), tie)
    return results.withColumn("rank", F.row_number().over(order)).withColumn("rounded_score", F.round(score, 2))


def lexical(results: DataFrame, effective: str = "content_type") -> DataFrame:
    """Text results get the lexical score and come first, in its order; others follow unchanged, in theirs."""
    text = F.col(effective).isin("text", "pdf", "docx") | F.col(effective).startswith("text/")
    new = F.round(ranking.lexical_score(F.col("score"), F.col("query"), F.col("content"), F.col("title"), F.col("source")), 6)
    out = results.withColumn("is_text", F.coalesce(text, F.lit(False))).withColumn("score", F.when(F.col("is_text"), new).otherwise(F.col("score")))
    order = W.partitionBy("query_id").orderBy(F.desc("is_text"), F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).drop("is_text")


def text_derived(results: DataFrame, caption: str = "caption") -> DataFrame:
    """Images are judged by their captions as if these were texts; their contents stay."""
    image = F.col("content_type").startswith("image")
    derived = results.withColumn("_original", F.col("content")).withColumn("_kind", F.when(image, "text").otherwise(F.col("content_type")))
    fallback = F.concat(F.lit("Image file: "), F.col("title"))
    derived = derived.withColumn("content", F.when(image, F.coalesce(caption, fallback)).otherwise(F.col("content")))
    return lexical(derived, "_kind").withColumn("content", F.col("_original")).drop("_original", "_kind")


def metadata(results: DataFrame) -> DataFrame:
    """By file name, content type and metadata; expects columns description, category, type, tags, width, height and file_size."""
    name = F.regexp_extract("source", r"([^/\\]*)$", 1)
    about = ranking.metadata_score(
        F.col("query"), [F.col(c) for c in ("title", "description", "category", "type")], F.col("tags"), F.col("width"), F.col("height"), F.col("file_size")
    )
    score = ranking.combined_score(F.col("score"), ranking.filename_score(F.col("query"), name), ranking.type_score(F.col("query"), F.col("content_type")), about)
    return ranked(results.withColumn("score", F.round(score, 6)))


def cross_encoder(results: DataFrame, logits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """By a model's logits (``logits`` adds a column logit). Queries whose scores spread too little are scored lexically; queries for which
    the model failed (a null logit) keep the order they came in."""
    scored = logits(results).withColumn("_p", F.round(ranking.sigmoid(F.col("logit")), 6))
    each = W.partitionBy("query_id")
    failed = F.max(F.col("logit").isNull()).over(each)
    spread = F.max("_p").over(each) - F.min("_p").over(each)
    new = ranking.lexical_score(F.col("score"), F.col("query"), F.col("content"), F.col("title"), F.col("source"))
    score = F.when(failed, F.col("score")).when(spread < LEAST_SPREAD, F.round(new, 6)).otherwise(F.col("_p"))
    return ranked(scored.withColumn("score", score).drop("_p", "logit"))


#: What each cross-modal search takes in.
PRESETS = {"images by text": ("image",), "texts by image": ("text",), "unified": ("text", "image")}


def preset(results: DataFrame, name: str, threshold: float = 0.0) -> DataFrame:
    """One of the usual cross-modal searches over results with a query_type and a similarity."""
    return cross_modal(results, threshold=threshold, include=PRESETS[name])


def semantic(results: DataFrame, embed, column: str = "content") -> DataFrame:
    """Adds ``similarity``, the cosine of the query's and the content's vectors, both embedded here; null where one can't be."""
    both = embedding.embed(embedding.embed(results, "query", embed, "_q"), column, embed, "_c")
    fine = vectors.problem(F.col("_q")).isNull() & vectors.problem(F.col("_c")).isNull()
    near = F.when(fine, vectors.rounded(vectors.cosine(F.col("_q"), F.col("_c"))))
    return both.withColumn("similarity", near).drop("_q", "_c", "_q_error", "_c_error")


def rerank(results: DataFrame, strategy: str, mode: str = "text", logits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "text-derived" and mode == "text" or strategy == "cross-encoder" and logits is None:
        raise ValueError(f"{strategy} is not available in {mode} mode" if mode == "text" and strategy == "text-derived" else "cross-encoder needs a scorer")
    run = {"lexical": lexical, "text-derived": text_derived, "metadata": metadata, "disabled": ranked}
    return cross_encoder(results, logits) if strategy == "cross-encoder" else run[strategy](results)


def cross_modal(results: DataFrame, similarity: str = "similarity", query_type: str = "query_type", threshold: float = 0.0, include: tuple[str, ...] = ()) -> DataFrame:
    """Results of another modality than the query's rank by their semantic similarity, others by score; ``threshold`` (0: off) drops the former below it."""
    out = results.where(F.col("content_type").isin(*include)) if include else results
    out = out.withColumn("is_cross_modal", F.col("content_type") != F.col(query_type)).withColumn("original_score", F.col("score"))
    out = out.withColumn(similarity, F.greatest(F.lit(0.0), F.col(similarity)))
    if threshold:
        out = out.where(~F.col("is_cross_modal") | (F.col(similarity) >= threshold))
    return ranked(out.withColumn("score", F.when(F.col("is_cross_modal"), F.coalesce(similarity, "score")).otherwise(F.col("score"))))


def analysis(results: DataFrame, similarity: str = "similarity") -> DataFrame:
    """A row per content type: results, cross-modal ones, and their mean similarity."""
    return results.groupBy("content_type").agg(
        F.count("*").alias("n"), F.count_if("is_cross_modal").alias("n_cross_modal"), F.round(F.avg(F.when(F.col("is_cross_modal"), F.col(similarity))), 6).alias("mean_similarity")
    )


def query_type(query) -> object:
    """image for a path with an image extension, else text."""
    return F.when(F.lower(query).rlike(r"\.(jpg|jpeg|png|gif|webp|bmp)$"), "image").otherwise("text")
