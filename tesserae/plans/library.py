"""Queries over the knowledge base's parts: settings, content rows, file readers, ingest, plug-ins, answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import image, mime, text
from tesserae.operators import catalog, chunking, contents, embedding, ingest, knn, pipeline, prompt, registry, rerank, scratch, store
from tesserae.plans import texts
from tesserae.plans.catalog import files, read
from tesserae.sources import files as sources


def system_info_upsert(spark, sf_dir: str) -> DataFrame:
    """Partial settings, one change a document: what is left is the last value of each."""
    n = F.col("doc_id")
    changes = read(spark, sf_dir, "documents").select(
        n.alias("seq"), F.when(n % 3 == 0, F.col("lang")).alias("mode"), F.when(n % 4 == 1, F.col("source")).alias("model"), F.when(n % 5 == 2, F.col("n_chars")).alias("dim")
    )
    return catalog.settings(changes, "seq")


def catalog_merge(spark, sf_dir: str) -> DataFrame:
    changes = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") % 7).cast("long").alias("quality"), F.lit(None).cast("long").alias("toxic"))
    rows = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))
    return catalog.merge(rows, changes, "doc_id")


def content_rows(spark, sf_dir: str) -> DataFrame:
    where = F.when(F.col("doc_id") % 2 == 0, "filesystem").otherwise("content_dir")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), "doc_id").alias("id"), where.alias("storage_type"), store.content_id(F.encode("text", "UTF-8")).alias("content_hash"), F.col("doc_id").alias("created_at")
    )


def content_by_hash(spark, sf_dir: str) -> DataFrame:
    """All content rows that have the digest of the most frequent text."""
    rows = content_rows(spark, sf_dir)
    often = rows.groupBy("content_hash").count().orderBy(F.desc("count"), "content_hash").first()
    return catalog.contents(rows, content_hash=often["content_hash"]).select("id", "created_at")


def content_by_storage(spark, sf_dir: str) -> DataFrame:
    return catalog.contents(content_rows(spark, sf_dir), storage="content_dir").select("id", "created_at")


def content_by_id(spark, sf_dir: str) -> DataFrame:
    return catalog.contents(content_rows(spark, sf_dir), ids=read(spark, sf_dir, "labels").select(F.concat(F.lit("c"), "doc_id").alias("id"))).select("id", "storage_type")


def _inserted(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new = content_rows(spark, sf_dir).select("content_hash", "id")
    stored = read(spark, sf_dir, "documents").where("doc_id % 10 = 3").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    return catalog.insert_new(stored, new, "content_hash")


def content_insert(spark, sf_dir: str) -> DataFrame:
    return _inserted(spark, sf_dir)[0]


def content_refused(spark, sf_dir: str) -> DataFrame:
    return _inserted(spark, sf_dir)[1]


def content_directory(spark, sf_dir: str) -> DataFrame:
    """Pages written to a content directory and read back; one page in four arrives a second time, under another name."""
    page = files(spark, sf_dir).select(F.col("page_id").alias("key"), F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("name"), "content")
    again = page.where("key % 4 = 0").select(F.when(F.col("key") % 8 == 0, -F.col("key") - 1).otherwise(F.col("key") + 1).alias("key"), F.lit("again.HTM").alias("name"), "content")
    folder = scratch.folder(spark, "contents")
    contents.write(page.unionByName(again), folder)
    return store.intact(contents.read(contents.stored(spark, folder), folder), "content", "content_id").select("content_id", "file", "size", "is_valid")


def known_ids(spark, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("doc_id"))
    return catalog.known(asked, read(spark, sf_dir, "documents"), "doc_id")


def store_repair(spark, sf_dir: str) -> DataFrame:
    actual = files(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    near = store.repair(actual.select("files", (F.col("bytes") + 500).alias("bytes")), actual)
    far = store.repair(actual.select((F.col("files") + 1).alias("files"), "bytes"), actual)
    return near.unionByName(far)


def missing_files(spark, sf_dir: str) -> DataFrame:
    return store.missing_files(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents").where("lang <> 'es'"), "doc_id")


def size_readable(spark, sf_dir: str) -> DataFrame:
    size = F.col("n_chars").cast("long") * F.element_at(F.array(*[F.lit(1 << (10 * k)) for k in range(4)]), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", store.readable(size).alias("size"))


def operation_metrics(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "es", "read error").otherwise("read").alias("operation"), F.col("n_chars").cast("long").alias("duration_ms"),
        (F.col("doc_id") * 1000).alias("bytes"), (F.col("doc_id") % 3 == 0).alias("cache_hit"),
    )
    return registry.operation_metrics(rows)


def storage_paths(spark, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/in/").otherwise("/inside/"), "source", F.lit(".md"))
    return read(spark, sf_dir, "documents").select("doc_id", registry.storage_path(path, "/in").alias("path"))


def found_files(spark, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds, some of them not what their extension says."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".TXT", ".png", ".jpg", ".exe", ".gif", ".docx")]), (F.col("doc_id") % 7 + 1).cast("int"))
    first = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961")]), (F.col("doc_id") % 3 + 1).cast("int"))
    content = F.concat(first, F.encode("text", "UTF-8"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/d"), "doc_id", ext).alias("path"), content.alias("content"))
    return rows.withColumns({"ext": text.extension(F.col("path")), "length": F.octet_length("content").cast("long") * F.when(F.col("doc_id") % 11 == 0, 40_000).otherwise(1)})


def discover_reasons(spark, sf_dir: str) -> DataFrame:
    rows = found_files(spark, sf_dir)
    return rows.select("doc_id", "ext", sources.skip_reason("text").alias("text"), sources.skip_reason("multimodal").alias("multimodal"))


def image_documents(spark, sf_dir: str) -> DataFrame:
    """Images whose headers give a document's numbers as width and height."""
    wide = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide("n_chars"), wide("doc_id")))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("p/i"), "doc_id", F.lit(".png")).alias("display_name"), head.alias("content"))
    return sources.documents(sources.from_memory(rows)).select("source", "title", "content", "content_type", "error")


def _drawn(pages: DataFrame) -> DataFrame:
    """(display_name, content): each page's bytes as the grey pixels of a PNG of 64 columns, the last row filled up with black; all filters occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                said = [np.frombuffer(x or b"", np.uint8) for x in part.column(1).to_pylist()]
                pixels = [np.append(x, np.zeros(-len(x) % 64 if len(x) else 64, np.uint8)).reshape(-1, 64) for x in said]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([image.to_png(x, (2, 1, 0, 3, 4)) for x in pixels], pa.binary())], names=["display_name", "content"])

    named = pages.select(F.concat(F.lit("g/"), "page_id", F.lit(".png")).alias("display_name"), F.col("html").cast("binary").alias("html"))
    return named.mapInArrow(run, "display_name string, content binary")


def image_vectors(spark, sf_dir: str) -> DataFrame:
    """Vectors of the images that ``pages`` make, from their bytes; numbers in millionths."""
    path = scratch.folder(spark, "images")  # drawn once, read by column
    sources.documents(sources.from_memory(_drawn(read(spark, sf_dir, "pages"))), data=True).drop("error").write.parquet(path)
    docs = spark.read.parquet(path)
    config = ingest.Config(mode="multimodal")
    clean, _ = ingest.prepared(docs, config)
    made = ingest.embedded(ingest.chunked(clean, config), images=image.describe, data=clean)
    numbers = F.array_join(F.transform("embedding", lambda x: F.floor(x * 1e6 + 0.5)), ",")
    return made.select(F.regexp_extract("source", r"g/(\d+)", 1).cast("long").alias("page_id"), numbers.alias("numbers"), F.col("reason").isNull().alias("fine"))


def text_documents(spark, sf_dir: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("Preface\n #  On "), "source", F.lit("  \n"), "text"))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("t/d"), "doc_id", F.lit(".txt")).alias("display_name"), body.alias("content"))
    return sources.documents(sources.from_memory(rows)).select("source", "title", "content", "content_type", "error")


def mode_filter(spark, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "text/html", "image", "pdf", None, "audio")]), (F.col("doc_id") % 6 + 1).cast("int"))
    fit, unfit = sources.in_mode(read(spark, sf_dir, "documents").select("doc_id", kind.alias("content_type")), "text")
    return fit.withColumn("reason", F.lit(None).cast("string")).unionByName(unfit)


def embedding_kinds(spark, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/plain", "image/png", "application/pdf", "image")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", mime.embedding_kind(kind).alias("kind"))


def fence_aliases(spark, sf_dir: str) -> DataFrame:
    names = [*text.FENCE_ALIASES, "rust", " "]
    name = F.element_at(F.array(*[F.lit(f" {x.upper()} ") for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", text.fence_language(name).alias("name"))


def _by_lines(docs: DataFrame, config: ingest.Config) -> DataFrame:
    """A chunking strategy of its own: a chunk per line."""
    lines = F.posexplode(F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: ~text.blank(x)))
    return docs.select("document_id", "source", "content_type", lines.alias("chunk_index", "content")).withColumn("token_count", text.word_tokens(F.col("content")))


def _library(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "es", "image").otherwise("text").alias("content_type")
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("source"), F.col("source").alias("title"), F.col("text").alias("content"), kind)


def ingest_summary(spark, sf_dir: str) -> DataFrame:
    """With a chunk per line, and images left out in text mode."""
    config = ingest.Config(preprocessing="rich")
    clean, unfit = ingest.prepared(_library(spark, sf_dir), config)
    parts = ingest.chunked(clean, config, _by_lines)
    return ingest.summary(clean, ingest.embedded(parts), unfit)


def ingest_duplicates(spark, sf_dir: str) -> DataFrame:
    """``documents`` by their source, as if each were a version of one file: the last of each is taken, the others are reported."""
    docs = read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), F.lit("text").alias("content_type"), F.col("doc_id").alias("seq"))
    ready, _ = ingest.prepared(docs, ingest.Config(preprocessing="balanced"))
    lasts = ingest.last_of_each(ready, "seq")
    gone = ingest.superseded(lasts).groupBy("source").agg(F.count("*").alias("superseded"))
    return lasts.select("d.source", F.col("d.title").cast("long").alias("doc_id")).join(gone, "source", "left").select("source", "doc_id", F.coalesce("superseded", F.lit(0).cast("long")).alias("superseded"))


def ingest_chunks(spark, sf_dir: str) -> DataFrame:
    config = ingest.Config(mode="multimodal", preprocessing="rich")
    parts = ingest.chunked(ingest.prepared(_library(spark, sf_dir), config)[0], config, _by_lines)
    return parts.select("source", "chunk_index", "content", "content_type", F.col("embedding_id").startswith("image_").alias("of_image"), "token_count")


def embed_failures(spark, sf_dir: str) -> DataFrame:
    """A model that takes no text of over 2,000 characters."""

    def strict(batch: list[str]):
        if any(len(t) > 2000 for t in batch):
            raise ValueError("too long")
        return embedding.hash_embed(batch)

    made = embedding.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", strict)
    return made.select("doc_id", F.col("embedding").isNull().alias("failed"), F.col("embedding_error").alias("error"))


def word_chunks(spark, sf_dir: str) -> DataFrame:
    """Texts without sentence ends fall back to runs of words with an overlap."""
    plain = text.trim(F.regexp_replace("text", r"[.!?\s]+", " "))
    return chunking.chunk(read(spark, sf_dir, "documents").select("doc_id", plain.alias("text")), "doc_id", config=chunking.ChunkConfig(40, 10))


def paragraph_chunks(spark, sf_dir: str) -> DataFrame:
    """Lines as paragraphs, packed without overlap; a paragraph is never too long here."""
    spaced = F.regexp_replace(F.regexp_replace("text", r"[.!?]", ""), "\n", "\n \n")
    rows = read(spark, sf_dir, "documents").select("doc_id", spaced.alias("text"), F.when(F.col("lang") == "es", "image").otherwise("text").alias("kind"))
    return chunking.chunk(rows, "doc_id", config=chunking.ChunkConfig(1_000_000, 0), kind="kind")


def _asked_vector(spark, sf_dir: str) -> list[float]:
    first = read(spark, sf_dir, "benchmark").orderBy("item_id").first()
    return embedding.hash_embed([first["text"]])[0].tolist()


def search_with_vector(spark, sf_dir: str) -> DataFrame:
    """The documents of one type that are nearest to a vector at hand."""
    docs = read(spark, sf_dir, "documents")
    rows = embedding.embed(docs.where("lang = 'de'").select("doc_id", "text"), "text", keep=False)
    best = knn.top_k(rows, _asked_vector(spark, sf_dir), 7, "doc_id")
    return best.join(docs.select("doc_id", "source"), "doc_id").select("rank", "doc_id", "score", "distance", "source")


def rerank_fallback(spark, sf_dir: str) -> DataFrame:
    """A scorer that fails for every other query, whose results keep their order."""
    logit = F.when(F.col("query_id") % 2 == 0, F.log(F.length("content") + 1) - 7)
    return rerank.rerank(texts.results(spark, sf_dir), "cross-encoder", logits=lambda r: r.withColumn("logit", logit)).select("query_id", "id", "score", "rank")


def _near_in_length(rows: pd.DataFrame) -> list[float]:
    """A strategy of its own that takes no queries of an odd length."""
    if (rows["query"].str.len() % 2 == 1).any():
        raise ValueError("an odd query")
    return (1 / (1 + (rows["content"].str.len() - rows["query"].str.len()).abs())).tolist()


def search_plugged(spark, sf_dir: str) -> DataFrame:
    """A search with a registered strategy, which fails for some queries: their results keep their order."""
    pipeline.register("near in length", _near_in_length)
    chosen = pipeline.SearchPipeline(strategy="near in length", k=3, candidates=texts.K)
    vectors = texts.embedded(spark, sf_dir).select(F.col("doc_id").alias("id"), "embedding")
    contents_ = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("title"), "source", F.lit("text").alias("content_type"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return chosen.run(vectors, contents_, asked).select("query_id", "id", "score", "rank", "used_fallback")


def cross_modal_presets(spark, sf_dir: str) -> DataFrame:
    rows = texts.results(spark, sf_dir).withColumn("query_type", F.lit("text")).withColumn("similarity", F.round(F.col("score") * 0.9 + 0.05, 6))
    out = None
    for name in rerank.PRESETS:
        part = rerank.preset(rows, name, 0.2).select(F.lit(name).alias("preset"), "query_id", "id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def cross_modal_semantic(spark, sf_dir: str) -> DataFrame:
    """Similarities from vectors of query and content, both embedded here."""
    return rerank.semantic(texts.results(spark, sf_dir), embedding.hash_embed).select("query_id", "id", "similarity")


def answer_generate(spark, sf_dir: str) -> DataFrame:
    """Answers of a stand-in for a model, which tells its prompt's length."""
    rows = rerank.ranked(texts.results(spark, sf_dir))
    return prompt.generate(rows, lambda prompts: [f"This prompt has {len(p)} characters. And<|im_end|>more" for p in prompts]).select("query_id", "response", "included", "truncated", "tokens_used")


def prompt_attributed(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", prompt.prompt(F.col("source"), F.col("text"), "instruct", attribute=True).alias("prompt"))


QUERIES = {
    f.__name__: f
    for f in (
        system_info_upsert, catalog_merge, content_by_hash, content_by_storage, content_by_id, content_insert, content_refused, content_directory, known_ids, store_repair,
        missing_files, size_readable, operation_metrics, storage_paths, discover_reasons, image_documents, image_vectors, text_documents, mode_filter, embedding_kinds,
        fence_aliases, ingest_summary, ingest_duplicates, ingest_chunks, embed_failures, word_chunks, paragraph_chunks, search_with_vector, rerank_fallback, search_plugged,
        cross_modal_presets, cross_modal_semantic, answer_generate, prompt_attributed,
    )
}


def _pick(column: str, values: list) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{column} % {len(values)} + 1]"


_C = "WITH c AS (SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'filesystem' ELSE 'content_dir' END AS storage_type, sha256(text) AS content_hash, doc_id AS created_at FROM documents)"
_NEW = f"{_C}, n AS (SELECT content_hash, id, count(*) OVER (PARTITION BY content_hash) > 1 OR content_hash IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3) AS refused FROM c) SELECT content_hash, id FROM n WHERE"
_BYTES = "WITH f AS (SELECT count(*) AS n, sum(octet_length(encode(html)))::BIGINT AS b FROM pages)"
_F = f"WITH f AS (SELECT doc_id, lower({_pick('doc_id', ['.md', '.TXT', '.png', '.jpg', '.exe', '.gif', '.docx'])}) AS ext, {_pick('doc_id', ['.png', '.jpg', '.gif'])} AS signed, (octet_length(encode(text)) + [8, 4, 6][doc_id % 3 + 1]) * CASE WHEN doc_id % 11 = 0 THEN 40000 ELSE 1 END AS size FROM documents), k AS (SELECT *, ext IN ('.png', '.jpg', '.gif') AS image FROM f)"
_REASON = "CASE WHEN ext = '.exe' THEN 'unsupported extension' {0} WHEN size > CASE WHEN image THEN 52428800 ELSE 10485760 END THEN 'file too large' WHEN image AND ext <> signed THEN 'not the image that its extension says' END"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')"
_LIB = f"WITH l AS (SELECT doc_id, lang, CASE WHEN lang <> 'es' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN ['[content processed but empty]'] ELSE {_LINES} END AS l FROM documents)"
_PARAS = r"list_filter(list_transform(string_split(regexp_replace(text, '[.!?]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_NAMES = [*text.FENCE_ALIASES, "rust", " "]
_COSINE = "(SELECT query_id, r.id, coalesce(round(sum(q.x * d.x), 6), 0.0) AS s FROM r LEFT JOIN q ON q.id = r.query_id LEFT JOIN d ON d.id = r.id AND d.i = q.i GROUP BY ALL)"
_IMAGE = """WITH p AS (SELECT page_id, list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda x: ('0x' || x)::INT) AS p FROM pages),
s AS (SELECT page_id, p, greatest(1, ceil(len(p) / 64.0))::INT AS h FROM p), f AS (SELECT page_id, h, list_resize(p, 64 * h, 0) AS p FROM s),
i AS (SELECT page_id, h, p, unnest(range(64 * h)) AS i FROM f), n AS (SELECT page_id, h, p, i // 64 AS y, i % 64 AS x, i FROM i),
g AS (SELECT page_id, y * 4 // h * 4 + x // 16 AS cell, p[i + 1] AS v, abs(p[i + 1 + least(1, 63 - x)] - p[i + 1 - least(1, x)]) AS a, abs(p[i + 1 + 64 * least(1, h - 1 - y)] - p[i + 1 - 64 * least(1, y)]) AS b FROM n),
k AS (SELECT page_id, cell, v, a + b AS size, CASE WHEN a >= 2 * b THEN 1 WHEN b >= 2 * a THEN 2 ELSE 3 END AS kind FROM g),
t AS (SELECT page_id, cell, [sum(v + 1), coalesce(sum(size) FILTER (kind = 1), 0), coalesce(sum(size) FILTER (kind = 2), 0), coalesce(sum(size) FILTER (kind = 3), 0)] AS t FROM k GROUP BY ALL),
e AS (SELECT page_id, unnest(range(64)) AS j FROM pages), u AS (SELECT e.page_id, j, coalesce(t[j % 4 + 1], 0)::DOUBLE AS u FROM e LEFT JOIN t ON e.page_id = t.page_id AND j // 4 = cell),
l AS (SELECT page_id, sqrt(sum(u * u)) AS l FROM u GROUP BY page_id)
SELECT page_id, string_agg(floor(u / l * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT::VARCHAR, ',' ORDER BY j) AS numbers, TRUE AS fine FROM u JOIN l USING (page_id) GROUP BY page_id"""
_INSTRUCT = texts.instruct("context", "query")
ORACLE_SQL = {
    "system_info_upsert": "SELECT arg_max(lang, doc_id) FILTER (doc_id % 3 = 0) AS mode, arg_max(source, doc_id) FILTER (doc_id % 4 = 1) AS model, arg_max(n_chars, doc_id) FILTER (doc_id % 5 = 2) AS dim FROM documents",
    "catalog_merge": "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(d.n_chars % 7, l.quality)::BIGINT AS quality, l.toxic::BIGINT AS toxic FROM labels l FULL JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) d ON l.doc_id = d.doc_id",
    "content_by_hash": f"{_C} SELECT id, created_at FROM c WHERE content_hash = (SELECT content_hash FROM c GROUP BY content_hash ORDER BY count(*) DESC, content_hash LIMIT 1)",
    "content_by_storage": f"{_C} SELECT id, created_at FROM c WHERE storage_type = 'content_dir'",
    "content_by_id": f"{_C} SELECT id, storage_type FROM c WHERE created_at IN (SELECT doc_id FROM labels)",
    "content_insert": f"{_NEW} NOT refused",
    "content_refused": f"{_NEW} refused",
    "content_directory": "SELECT content_id, content_id || CASE WHEN min(key) < 0 THEN '.htm' ELSE '.html' END AS file, min(size) AS size, TRUE AS is_valid FROM (SELECT sha256(html) AS content_id, octet_length(encode(html))::BIGINT AS size, CASE WHEN page_id % 8 = 0 THEN -page_id - 1 ELSE page_id END AS key FROM pages WHERE html IS NOT NULL) GROUP BY content_id",
    "known_ids": "SELECT DISTINCT doc_id * 3 AS doc_id, doc_id * 3 IN (SELECT doc_id FROM documents) AS exists FROM documents",
    "store_repair": f"{_BYTES} SELECT n AS files, b + 500 AS bytes, FALSE AS repaired FROM f UNION ALL SELECT n, b, TRUE FROM f",
    "missing_files": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es')",
    "size_readable": r"WITH s AS (SELECT doc_id, n_chars::BIGINT * [1, 1024, 1048576, 1073741824][doc_id % 4 + 1] AS s FROM documents), u AS (SELECT *, CASE WHEN s < 1024 THEN 0 WHEN s < 1048576 THEN 1 WHEN s < 1073741824 THEN 2 WHEN s < 1099511627776 THEN 3 ELSE 4 END AS u FROM s) SELECT doc_id, CASE u WHEN 0 THEN s || ' B' ELSE regexp_replace(round(s / power(1024.0::DOUBLE, u), 2)::DECIMAL(20,2)::VARCHAR, '\.?0+$', '') || [' KB', ' MB', ' GB', ' TB'][u] END AS size FROM u",
    "operation_metrics": "SELECT count(*) AS operations, round(avg(n_chars), 2) AS average_ms, sum(doc_id * 1000)::BIGINT AS bytes, round(sum(doc_id * 1000)::DOUBLE / sum(n_chars) * 1000 / 1048576, 4) AS mb_per_s, round(100.0::DOUBLE * count(*) FILTER (doc_id % 3 = 0) / count(*), 2) AS cache_hit_percent, round(100.0::DOUBLE * count(*) FILTER (lang = 'es') / count(*), 2) AS error_percent FROM documents",
    "storage_paths": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.md' ELSE '/inside/' || source || '.md' END AS path FROM documents",
    "discover_reasons": f"{_F} SELECT doc_id, ext, {_REASON.format(chr(87) + 'HEN image THEN ' + repr('images need multimodal mode'))} AS text, {_REASON.format('')} AS multimodal FROM k",
    "image_documents": "SELECT 'p/i' || doc_id || '.png' AS source, 'i' || doc_id AS title, 'Image: i' || doc_id || chr(10) || 'Description: Image file: i' || doc_id || chr(10) || 'Dimensions: ' || n_chars || 'x' || doc_id || chr(10) || 'Format: PNG' AS content, 'image' AS content_type, NULL::VARCHAR AS error FROM documents",
    "image_vectors": _IMAGE,
    "text_documents": "WITH d AS (SELECT doc_id, doc_id % 5 = 0 AS blank, 't/d' || doc_id || '.txt' AS source, source AS s, text FROM documents) SELECT source, CASE WHEN blank THEN 'd' || doc_id ELSE 'On ' || s END AS title, CASE WHEN blank THEN ' ' || chr(10) ELSE 'Preface' || chr(10) || ' #  On ' || s || '  ' || chr(10) || text END AS content, 'text' AS content_type, CASE WHEN blank THEN 'no content in ' || source END AS error FROM d",
    "mode_filter": f"WITH k AS (SELECT doc_id, {_pick('doc_id', ['text', 'text/html', 'image', 'pdf', None, 'audio'])} AS content_type FROM documents) SELECT *, CASE WHEN content_type IN ('image', 'audio') OR content_type IS NULL THEN 'not taken in text mode: ' || coalesce(content_type, 'unknown') END AS reason FROM k",
    "embedding_kinds": "SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN 'image' ELSE 'text' END AS kind FROM documents",
    "fence_aliases": f"SELECT doc_id, {_pick('doc_id', [text.FENCE_ALIASES.get(x, x.strip()) for x in _NAMES])} AS name FROM documents",
    "ingest_summary": f"{_LIB}, c AS (SELECT unnest(l) AS x FROM l WHERE lang <> 'es') SELECT (SELECT count(*) FROM l WHERE lang <> 'es') AS documents, (SELECT count(*) FROM l WHERE lang = 'es') AS skipped, count(*) AS chunks, count(*) - count(*) FILTER (e) AS embeddings, count(*) FILTER (e) AS errors FROM (SELECT ({{}}) AS e FROM c)",
    "ingest_duplicates": "SELECT source, max(doc_id) AS doc_id, count(*) - 1 AS superseded FROM documents GROUP BY source",
    "ingest_chunks": f"{_LIB}, c AS (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM l) SELECT 'd/' || doc_id || '.txt' AS source, (i - 1)::INT AS chunk_index, l[i] AS content, CASE WHEN lang = 'es' THEN 'image' ELSE 'text' END AS content_type, lang = 'es' AS of_image, len(list_filter(regexp_split_to_array(l[i], '\\s+'), lambda w: w <> ''))::INT AS token_count FROM c",
    "embed_failures": "SELECT doc_id, length(text) > 2000 AS failed, CASE WHEN length(text) > 2000 THEN 'ValueError: too long' END AS error FROM documents",
    "word_chunks": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?\s]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + ceil(greatest(len(w) - 40, 0) / 30.0)::BIGINT END)) AS k FROM w)
SELECT doc_id, k::INT AS chunk_index, array_to_string(w[30 * k + 1 : 30 * k + 40], ' ') AS content, len(w[30 * k + 1 : 30 * k + 40])::INT AS token_count FROM c""",
    "paragraph_chunks": f"WITH p AS (SELECT doc_id, CASE WHEN lang = 'es' THEN replace(regexp_replace(text, '[.!?]', '', 'g'), chr(10), chr(10) || ' ' || chr(10)) ELSE array_to_string({_PARAS}, chr(10) || chr(10)) END AS content FROM documents) SELECT doc_id, 0 AS chunk_index, content, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::INT AS token_count FROM p WHERE content <> ''",
    "search_with_vector": f"{texts._SEARCH}, a AS (SELECT i, x FROM q WHERE id = (SELECT min(item_id) FROM benchmark)), t AS (SELECT doc_id, source, coalesce((SELECT round(sum(a.x * d.x), 6) FROM a JOIN d ON a.i = d.i WHERE d.id = doc_id), 0.0) AS score FROM documents WHERE lang = 'de') SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score, round(1 - score, 6) AS distance, source FROM t ORDER BY score DESC, doc_id LIMIT 7",
    "rerank_fallback": f"{texts._SEARCH}, p AS (SELECT *, round(1 / (1 + exp(-(ln(length(content) + 1) - 7))), 6) AS p FROM r), n AS (SELECT query_id, id, CASE WHEN query_id % 2 = 1 THEN score WHEN max(p) OVER (PARTITION BY query_id) - min(p) OVER (PARTITION BY query_id) < 0.1 THEN round(least(1.0::DOUBLE, score + {texts._bonus('content')}), 6) ELSE p END AS score FROM p) {texts._RANK}",
    "search_plugged": f"{texts._SEARCH}, p AS (SELECT query_id, id, length(query) % 2 = 1 AS odd, CASE WHEN length(query) % 2 = 1 THEN score ELSE round(1::DOUBLE / (1 + abs(length(content) - length(query))), 6) END AS score FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM p) SELECT query_id, id, score, rank, odd AS used_fallback FROM n WHERE rank <= 3",
    "cross_modal_presets": f"{texts._SEARCH}, m AS (SELECT query_id, id, content_type, CASE WHEN content_type = 'image' THEN greatest(0, round(score * 0.9::DOUBLE + 0.05::DOUBLE, 6)) ELSE score END AS score FROM r), k AS (SELECT unnest(['images by text', 'texts by image', 'unified']) AS preset), n AS (SELECT preset, query_id, id, score FROM m, k WHERE CASE preset WHEN 'images by text' THEN content_type = 'image' WHEN 'texts by image' THEN content_type = 'text' ELSE TRUE END AND (content_type <> 'image' OR score >= 0.2)) SELECT preset, query_id, id, score, row_number() OVER (PARTITION BY preset, query_id ORDER BY score DESC, id)::INT AS rank FROM n",
    "cross_modal_semantic": f"{texts._SEARCH} SELECT query_id, id, CASE WHEN id IN (SELECT id FROM d) AND query_id IN (SELECT id FROM q) THEN s END AS similarity FROM {_COSINE}",
    "answer_generate": texts._context("(2048 - 512 - 150 - ceil(length(query) / 4.0))", "r WHERE rank <= 3") + f", a AS (SELECT *, {_INSTRUCT} AS p FROM g) SELECT query_id, 'This prompt has ' || length(p) || ' characters.' AS response, included, truncated, (ceil(length(p) / 4.0) + ceil(length('This prompt has ' || length(p) || ' characters.') / 4.0))::BIGINT AS tokens_used FROM a",
    "prompt_attributed": f"SELECT doc_id, {texts.instruct('text', 'source', prompt.ATTRIBUTING_SYSTEM)} AS prompt FROM documents",
}
# a chunk without an embedding: none of its words has a place in the vector, or they cancel out
_ZERO = "NOT EXISTS (SELECT 1 FROM (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM (SELECT unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w) GROUP BY i) WHERE s <> 0)"
ORACLE_SQL["ingest_summary"] = ORACLE_SQL["ingest_summary"].format(_ZERO)
