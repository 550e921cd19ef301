"""What only larger tables hold: long texts, values near zero, many and large rows."""

import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae.functions import markup, wordpiece
from tesserae.operators import chunking, embedding, ingest


@pytest.fixture
def beside_sql(spark, tmp_path):
    """Whether a query's rows, written out as text, are those of its SQL on a given table."""

    def run(name: str, table: str, rows: list[tuple], schema: str) -> list[str]:
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
        at = [want.columns.index(c) for c in got.columns]
        said = sorted(str(list(r)) for r in got.collect())
        assert said == sorted(str([r[k] for k in at]) for r in want.fetchall())
        return said

    return run


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_discover_reasons_of_long_texts(beside_sql):
    """Lengths beyond an int."""
    rows = [(k, "x" * n, "en", "s", n) for k, n in ((0, 60_000), (11, 60_000), (13, 9), (22, 70_000), (33, 100), (44, 0), (77, 80_000))]
    assert sum("file too large" in r for r in beside_sql("discover_reasons", "documents", rows, DOCUMENTS)) == 3


@pytest.mark.parametrize("name", ["vec_normalize", "vec_cosine", "vec_dot", "vec_euclidean", "knn_single"])
def test_signs_of_values_near_zero(beside_sql, name):
    """What rounds to zero from below is -0.0, as it is in SQL."""
    rows = [(0, [1.0, 0.0], 0), (1, [-1e-8, 1.0], 1), (2, [1e-8, 1.0], 1), (3, [-0.0, 2.0], 1), (4, [-1.0, -3e-7], 1)]
    said = beside_sql(name, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert any("-0.0" in r for r in said) or name == "vec_euclidean"


def test_modes_that_leave_nothing(spark, beside_sql):
    """Blank texts, and texts of code alone: the query says what is left, and preprocess() puts a note there."""
    blank = ["", "  ", "\n\n\n", "```py\n1\n```", "```a```\n```b```\n"]
    rows = [(k, t, lang, "s", 0) for k, (t, lang) in enumerate((t, lang) for t in [*blank, "Plain.", None] for lang in ("en", "fr", "de", None))]
    beside_sql("preprocess_modes", "documents", rows, DOCUMENTS)
    left = spark.createDataFrame([(t,) for t in blank[3:]], "t string").select(*[f(F.col("t"), F.lit("markdown"), "strict").alias(f.__name__) for f in (markup.processed, markup.preprocess)]).collect()
    assert all(not r.processed.strip() and r.preprocess == "[content processed but empty]" for r in left)


def sent_to_python(df) -> int:
    """Bytes that a plan without exchanges gives to Python."""
    df.collect()
    left, total = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        plan = left.pop()
        metric = plan.metrics().get("pythonDataSent")
        total += metric.get().value() if metric.isDefined() else 0
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


@pytest.fixture(scope="module")
def long_texts(spark):
    """200 texts, 4 million characters; a diagram in each."""
    return spark.range(200).selectExpr("id", "concat('```mermaid\nA --> B\n```\n', repeat('plain words. ', 1500)) AS t").coalesce(1)


def test_python_gets_diagrams_without_the_texts_around_them(long_texts):
    out = long_texts.select(markup.diagrams_column(F.col("t")).alias("t"))
    assert sent_to_python(out) < 100_000
    assert {r.t for r in out.collect()} == {"A leads to B\n" + "plain words. " * 1500}


@pytest.mark.parametrize("mode", list(markup.MODES))
def test_python_gets_no_text_that_is_not_mdx(long_texts, mode):
    assert sent_to_python(long_texts.select(markup.preprocess(F.col("t"), F.lit("markdown"), mode).alias("t"))) < 100_000


def test_preparing_documents_sends_plain_ones_nowhere(long_texts):
    docs = long_texts.selectExpr("concat('d/', id, '.txt') AS source", "'' AS title", "t AS content", "'text' AS content_type")
    assert sent_to_python(ingest.prepared(docs, ingest.Config(preprocessing="balanced"))[0]) < 100_000


def test_preparing_documents_sends_no_images_text(spark):
    """An image's text stays as it is, so it isn't searched for diagrams."""
    docs = spark.range(200).coalesce(1).selectExpr("concat('d/', id, '.txt') AS source", "'' AS title", "concat('```mermaid\n', repeat('A --> B\n', 1500), '```') AS content", "if(id >= 0, 'image', 'text') AS content_type")
    clean = ingest.prepared(docs, ingest.Config(mode="multimodal", preprocessing="rich"))[0]
    assert sent_to_python(clean) < 100_000
    assert {r.content for r in clean.collect()} == {"```mermaid\n" + "A --> B\n" * 1500 + "```"}


def test_ingest_chunks_shuffles_nothing(spark):
    """Documents are read once and each is worked on alone, so the work grows as the input does."""
    plan = entry.queries()["ingest_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_diagrams_column_equals_the_plain_function(spark):
    texts = ["", "a", "```mermaid```", "```MerMaid\nA --> B```x```mermaid\nA --- B\n```", "```mermaid\nA --> B", "$1 \\ ```mermaid\nA[$1\\] --> B\n```\n\n\nz ```js\n```", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", markup.diagrams_column(F.col("t")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: None if t is None else markup.diagrams(t) for k, t in enumerate(texts)}


def test_chunks_carry_their_document_without_a_join(spark):
    """Documents are neither prepared again nor shuffled for what the chunker can carry."""
    docs = spark.createDataFrame([("d/1.txt", "t", "One. Two.", "text"), ("d/2.txt", "t", "x", "image")], "source string, title string, content string, content_type string")
    clean, unfit = ingest.prepared(docs, ingest.Config(mode="multimodal"))
    parts = ingest.chunked(clean, ingest.Config(mode="multimodal"))
    assert "Join" not in parts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.source, r.content, r.content_type) for r in parts.collect()) == [("d/1.txt", "One. Two.", "text"), ("d/2.txt", "x", "image")]
    plan = ingest.summary(clean, ingest.embedded(parts), unfit)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # chunked once, embedded once
    assert plan.first() == (2, 0, 2, 2, 0)


def test_functions_get_portions_by_bytes():
    rows = pa.record_batch([pa.array(["x" * n for n in (3, 3, 20, 1, 1, 1, 1, 0)] + [None])], ["t"])
    got = [p.column(0).to_pylist() for p in embedding.portions(rows, "t", 3, 6)]
    assert [len(p) for p in got] == [2, 1, 3, 3] and sum(got, []) == rows.column(0).to_pylist()


def test_words_of_a_long_text_are_counted_part_by_part(monkeypatch):
    text = "Ab cd, ef-ab " * 50 + "x" * 40
    whole = embedding.hash_embed([text, None, ""]).tolist()
    monkeypatch.setattr(embedding, "PART", 7)
    assert embedding._words(text) == {"ab": 100, "cd": 50, "ef": 50, "x" * 40: 1} and embedding.hash_embed([text, None, ""]).tolist() == whole


def test_embedding_holds_the_words_of_few_texts_at_a_time():
    """Of many texts with words of their own, a part is counted at a time, and no word is kept."""
    texts = [" ".join(f"w{k}x{j}" for j in range(20_000)) for k in range(10)]
    embedding.hash_embed(texts[:1])
    tracemalloc.start()
    try:
        made = embedding.hash_embed(texts)
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert made.shape == (10, 64) and kept < 1 << 20 and most < 20 << 20


def test_each_string_is_counted_once():
    """Sentences, paragraphs and chunks aren't counted again and again, and words are cut up for many texts at once."""
    asked = Counter()

    def count(text: str) -> int:
        asked[text] += 1
        return len(text.split())

    count.overhead = 0
    text = "\n\n".join(f"Some {k} words are here. And {k} more of them. " * (k % 7) for k in range(60))
    made = chunking.counted_chunks(text, chunking.ChunkConfig(20, 6), count)
    assert max(asked.values()) == 1 and all(n == len(c.split()) for c, n in made) and len(made) > 20
    counter = wordpiece.WordPiece(["a", "##b", "c"])
    counter.prepare(["ab c.", None, "ab, é", "x" * 200])
    calls = []
    counter.pieces = lambda said: calls.append(said)
    assert counter("ab c.") == 6 and not calls
