"""Search for many queries at once, with an embedder, a search and a reranking that are chosen by name or passed in.

Strategies of one's own are registered by name and are functions of batches of results. Each query for which one fails is ranked by a
fallback instead, and the rows say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.operators import ann, embedding, knn, rerank
from tesserae.operators.registry import Category, EngineError

#: Scores of a batch of (query, content, title, source, content_type, score) rows, higher ones being better.
Scorer = Callable[[pd.DataFrame], Sequence[float]]
#: (rows, queries, k, key, query_key) to (query_id, id, score, rank).
Search = Callable[..., DataFrame]
SEEN = ("query", "content", "title", "source", "content_type", "score")
FALLBACKS = ("disabled", "lexical", "metadata")
#: Rows that a scorer gets at a time.
BATCH = 64


def _by_cells(rows: DataFrame, queries: DataFrame, k: int, key: str, query_key: str) -> DataFrame:
    return ann.join(rows, queries, ann.Quantiser.fit(rows), k, key, query_key)[0]


#: Both are exact; ``cells`` sends queries only to the cells that their bounds leave.
SEARCHES: dict[str, Search] = {"exact": knn.batch_top_k, "cells": _by_cells}
_registered: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    """Makes a strategy known by a name that none of the built-in ones has."""
    if name in rerank.STRATEGIES:
        raise EngineError(f"{name} is a built-in strategy", Category.CONFIGURATION)
    _registered[name] = scorer


def unregister(name: str) -> None:
    _registered.pop(name, None)


def strategies() -> list[str]:
    return [*rerank.STRATEGIES, *sorted(_registered)]


def scored(results: DataFrame, scorer: Scorer, column: str = "new_score") -> DataFrame:
    """The input with a score per row. A batch that fails, or has another number of scores, is tried row by row; a row that fails, or whose score is
    no finite number, has null."""

    def one(rows: pd.DataFrame) -> list[float | None]:
        found = [float(x) for x in scorer(rows)]
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} scores of {len(rows)} rows")
        return [x if abs(x) < float("inf") else None for x in found]

    def each(row: pd.DataFrame) -> float | None:
        try:
            return one(row)[0]
        except Exception:  # whatever a scorer raises is the row's, not the job's
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = part.select(list(SEEN)).to_pandas()
                try:
                    found = one(rows)
                except Exception:
                    found = [each(rows.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, column])

    return results.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in results.dtypes) + f", `{column}` double")


def reranked(results: DataFrame, scorer: Scorer, fallback: str = "disabled") -> DataFrame:
    """Results by a scorer's scores, rounded to 6 places; those of queries for which it fails in any row as ``fallback`` ranks them. ``used_fallback`` tells which."""
    if fallback not in FALLBACKS:
        raise EngineError(f"the fallback is one of {', '.join(FALLBACKS)}", Category.CONFIGURATION)
    plain = rerank.rerank(scored(results, scorer), fallback)
    tried = plain.withColumn("used_fallback", F.max(F.col("new_score").isNull()).over(W.partitionBy("query_id")))
    score = F.when(F.col("used_fallback"), F.col("score")).otherwise(F.round("new_score", 6))
    order = F.when(F.col("used_fallback"), F.col("rank")).otherwise(F.lit(0))
    out = tried.withColumn("score", score).withColumn("_order", order).drop("new_score")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("_order", F.desc("score"), "id"))
    return out.withColumn("rank", place).withColumn("rounded_score", F.round("score", 2)).drop("_order")


@dataclass(frozen=True)
class SearchPipeline:
    """What a search is made of. ``search`` and ``strategy`` are names (of ``SEARCHES``, of ``strategies()``) or functions.

    ``candidates`` results of each query are reranked and the best ``k`` are returned; ``threshold`` leaves out results of a lower similarity before that.
    """

    embed: embedding.Embed = embedding.hash_embed
    search: str | Search = "exact"
    strategy: str | Scorer = "lexical"
    fallback: str = "disabled"
    k: int = 10
    candidates: int | None = None
    threshold: float | None = None

    def __post_init__(self) -> None:
        if not callable(self.search) and self.search not in SEARCHES:
            raise EngineError(f"unknown search {self.search!r}; known are {', '.join(SEARCHES)}", Category.CONFIGURATION)
        if not callable(self.strategy) and self.strategy not in strategies():
            raise EngineError(f"unknown strategy {self.strategy!r}; known are {', '.join(strategies())}", Category.CONFIGURATION)
        if self.fallback not in FALLBACKS:
            raise EngineError(f"the fallback is one of {', '.join(FALLBACKS)}", Category.CONFIGURATION)
        if self.k < 1 or self.candidates is not None and self.candidates < self.k:
            raise EngineError("k must be positive, and candidates not fewer", Category.VALIDATION)

    def found(self, vectors: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) of the candidates. ``vectors``: id, embedding. ``queries``: query_id, query; blank ones, and those that can't be embedded, find nothing."""
        asked = embedding.embed(queries.where(F.trim("query") != ""), "query", self.embed, keep=False).where("embedding IS NOT NULL").select("query_id", "embedding")
        search = self.search if callable(self.search) else SEARCHES[self.search]
        out = search(vectors.where("embedding IS NOT NULL"), asked, self.candidates or self.k, "id", "query_id").select("query_id", "id", "score")
        return out if self.threshold is None else out.where(F.col("score") >= self.threshold)

    def run(self, vectors: DataFrame, contents: DataFrame, queries: DataFrame) -> DataFrame:
        """The best ``k`` results of each query, ranked, with their contents: ``contents`` has id, content, title, source and content_type."""
        rows = self.found(vectors, queries).join(contents, "id").join(queries.select("query_id", "query"), "query_id")
        scorer = self.strategy if callable(self.strategy) else _registered.get(self.strategy)
        if scorer is not None:
            out = reranked(rows, scorer, self.fallback)
        else:
            mode = "multimodal" if self.strategy == "text-derived" else "text"
            rows = rows.withColumn("caption", F.lit(None).cast("string")) if mode == "multimodal" and "caption" not in rows.columns else rows
            out = rerank.rerank(rows, self.strategy, mode).withColumn("used_fallback", F.lit(False))
        return out.where(F.col("rank") <= self.k)
