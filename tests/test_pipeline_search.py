"""Searches of chosen parts: registered strategies, their failures, and searches by name."""

import numpy as np
import pytest

from tesserae.operators import embedding, pipeline
from tesserae.operators.registry import EngineError


def tables(spark):
    said = ["spark joins tables", "spark plans joins", "cats sleep", "joins of tables in plans", "a cat and a table"]
    docs = [(i, t, f"t{i}", f"d/{i}.md", "image" if i == 2 else "text") for i, t in enumerate(said)]
    contents = spark.createDataFrame(docs, "id long, content string, title string, source string, content_type string")
    vectors = embedding.embed(contents.select("id", "content"), "content", keep=False).select("id", "embedding")
    asked = spark.createDataFrame([(1, "joins of tables"), (2, "cats"), (3, "  "), (4, "plans")], "query_id long, query string")
    return vectors, contents, asked


def test_scorers_fail_by_query(spark):
    vectors, contents, asked = tables(spark)

    def scorer(rows):
        if (rows["query"] == "cats").any():
            raise RuntimeError("no cats")
        return [float("nan") if q == "plans" and "plans" in c else float(len(c)) for q, c in zip(rows["query"], rows["content"], strict=True)]

    got = pipeline.SearchPipeline(strategy=scorer, k=2, candidates=4).run(vectors, contents, asked).orderBy("query_id", "rank").collect()
    plain = pipeline.SearchPipeline(strategy="disabled", k=2, candidates=4).run(vectors, contents, asked).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {1, 2, 4} and {(r["query_id"], r["used_fallback"]) for r in got} == {(1, False), (2, True), (4, True)}
    assert [(r["query_id"], r["id"], r["rank"], r["score"]) for r in got if r["query_id"] != 1] == [(r["query_id"], r["id"], r["rank"], r["score"]) for r in plain if r["query_id"] != 1]
    assert [(r["id"], r["score"]) for r in got if r["query_id"] == 1][0] == (3, 24.0)


def test_fallbacks_keep_their_order(spark):
    vectors, contents, asked = tables(spark)
    short = lambda rows: [1.0] * (len(rows) + 1)
    got = pipeline.SearchPipeline(strategy=short, fallback="lexical", k=5).run(vectors, contents, asked)
    want = pipeline.SearchPipeline(strategy="lexical", k=5).run(vectors, contents, asked)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 15
    assert rows(pipeline.SearchPipeline(search="cells", k=5).run(vectors, contents, asked)) == rows(want)
    assert pipeline.SearchPipeline(strategy="text-derived", k=1).run(vectors, contents, asked).count() == 3
    assert pipeline.SearchPipeline(strategy="disabled", threshold=0.2).run(vectors, contents, asked).where("score < 0.2").count() == 0


def test_failed_queries_and_empty_tables(spark):
    vectors, contents, asked = tables(spark)

    def strict(texts):
        if "cats" in texts:
            raise ValueError("no cats")
        return np.asarray(embedding.hash_embed(texts))

    chosen = pipeline.SearchPipeline(embed=strict, k=1)
    assert {r["query_id"] for r in chosen.run(vectors, contents, asked).collect()} == {1, 4}
    assert chosen.run(vectors, contents, asked.limit(0)).count() == 0 and chosen.run(vectors.limit(0), contents, asked).count() == 0


def test_names_and_numbers():
    pipeline.register("mine", lambda rows: [0.0] * len(rows))
    assert "mine" in pipeline.strategies() and pipeline.SearchPipeline(strategy="mine").strategy == "mine"
    pipeline.unregister("mine")
    for given in ({"strategy": "mine"}, {"search": "none"}, {"fallback": "mine"}, {"k": 0}, {"k": 5, "candidates": 4}):
        with pytest.raises(EngineError):
            pipeline.SearchPipeline(**given)
    with pytest.raises(EngineError):
        pipeline.register("lexical", lambda rows: [])
