"""Queries over whole tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import chunking, embedding, knn
from tesserae.plans import catalog, library, texts, vectors

QUERIES = vectors.QUERIES | catalog.QUERIES | texts.QUERIES | library.QUERIES
ORACLE_SQL = vectors.ORACLE_SQL | catalog.ORACLE_SQL | texts.ORACLE_SQL | library.ORACLE_SQL


def flagship(spark, sf_dir: str, question: str = "what is the overview", k: int = 10) -> DataFrame:
    """Chunk, embed, search the nearest chunks, join their documents, rank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunks = chunking.chunk(docs, "doc_id").withColumn("chunk_key", F.concat_ws("-", "doc_id", "chunk_index"))
    vectors_ = embedding.embed(chunks, "content")
    best = knn.top_k(vectors_, embedding.hash_embed([question])[0].tolist(), k, "chunk_key")
    found = best.join(chunks, "chunk_key").join(docs.select("doc_id", "source", "lang"), "doc_id")
    return found.select("rank", "doc_id", "chunk_index", "score", "source", "lang", "content").orderBy("rank")
