"""Catalog and content store queries. ``documents`` stands for the catalog (lang for content type), its sentences for chunks, ``labels``
for what is stored already, ``pages`` for files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import mime, text
from tesserae.operators import catalog, store


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("content_type"), F.posexplode(text.sentences(F.col("text"))).alias("chunk_index", "content"))
    return rows.withColumn("embedding_id", text.embedding_id(F.col("content")))


def catalog_documents(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", F.concat("source", F.lit("-"), "doc_id").alias("title"), F.col("lang").alias("content_type"))


def files(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.octet_length("html").cast("long").alias("size"))


def doc_type_stats(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


def doc_totals_rollup(spark, sf_dir: str) -> DataFrame:
    return catalog.type_statistics(read(spark, sf_dir, "documents"), "lang")


def chunk_totals_rollup(spark, sf_dir: str) -> DataFrame:
    return catalog.type_statistics(chunks(spark, sf_dir))


def table_counts(spark, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n")
    return d.unionByName(chunks(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit("chunks").alias("name"), "n"))


def chunks_by_ids(spark, sf_dir: str) -> DataFrame:
    """The chunks whose sentence is one of ``benchmark``'s."""
    said = read(spark, sf_dir, "benchmark").select(F.explode(text.sentences(F.col("text"))).alias("s"))
    ids = said.select(text.embedding_id(F.col("s")).alias("embedding_id")).distinct()
    docs = catalog_documents(spark, sf_dir).drop("content_type")
    return catalog.chunks_by_embedding_ids(chunks(spark, sf_dir), docs, ids).select("document_id", "chunk_index", "embedding_id", "source", "title")


def chunks_by_type(spark, sf_dir: str) -> DataFrame:
    return catalog.chunks_of_type(chunks(spark, sf_dir), catalog_documents(spark, sf_dir), "es").select("document_id", "chunk_index", "source", "title", F.length("content").alias("n"))


def docs_recent(spark, sf_dir: str) -> DataFrame:
    """Documents of one type; the id stands for the time they came."""
    return catalog.documents_of_type(catalog_documents(spark, sf_dir), "de", "document_id", "source").select("document_id", "source", "title")


def docs_newest(spark, sf_dir: str) -> DataFrame:
    return catalog.newest(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 5)


def docs_distinct_source(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("source").distinct().orderBy("source")


def docs_by_source(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in\\"), "source").alias("source"))
    asked = read(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.max("source")).alias("source"))
    return catalog.by_source(docs, asked).select("doc_id")


def chunk_count_per_doc(spark, sf_dir: str) -> DataFrame:
    return catalog.chunk_counts(chunks(spark, sf_dir))


def chunk_scan(spark, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("embedding_id", "content", "document_id", "chunk_index").orderBy("document_id", "chunk_index")


def modality_counts(spark, sf_dir: str) -> DataFrame:
    return catalog.modality_counts(read(spark, sf_dir, "documents").select(F.when(F.col("lang") == "es", "image/png").when(F.col("lang") == "fr", "audio/wav").otherwise("text").alias("content_type")))


def doc_insert_if_absent(spark, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return catalog.insert_if_absent(read(spark, sf_dir, "labels"), new, "doc_id", "n_chars")


def chunk_last_wins(spark, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("embedding_id", "document_id", "chunk_index", (F.col("document_id") * 100000 + F.col("chunk_index")).alias("seq"))
    return catalog.last_wins(rows, "embedding_id", "seq").drop("seq")


def doc_metadata_update(spark, sf_dir: str) -> DataFrame:
    changes = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("metadata"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("metadata"))
    return catalog.update(rows, changes, "doc_id", "metadata")


def content_delete(spark, sf_dir: str) -> DataFrame:
    return catalog.delete(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


def identified(spark, sf_dir: str) -> DataFrame:
    return store.identify(read(spark, sf_dir, "documents").withColumn("text", F.encode("text", "UTF-8")), "text", "doc_id")


def content_hash(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", store.content_id(F.encode("text", "UTF-8")).alias("content_id"))


def content_dedup_report(spark, sf_dir: str) -> DataFrame:
    return store.dedup_report(identified(spark, sf_dir))


def content_new(spark, sf_dir: str) -> DataFrame:
    """What ``conversations`` doesn't hold already."""
    known = read(spark, sf_dir, "conversations").select(store.content_id(F.encode("text", "UTF-8")).alias("content_id"))
    return store.new_content(identified(spark, sf_dir), known).select("doc_id", "content_id", "size")


def memory_ingest(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.encode("text", "UTF-8").alias("content"))
    return store.identify(rows, "content", "id")


def content_integrity(spark, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("expected", F.upper(F.sha2("content", 256)))
    return store.intact(rows, "content", "expected").select("page_id", "is_valid")


def orphan_cleanup(spark, sf_dir: str) -> DataFrame:
    return store.orphans(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels"), "doc_id")


def storage_stats(spark, sf_dir: str) -> DataFrame:
    return store.statistics(files(spark, sf_dir), most=64 << 20)


def storage_recommendation(spark, sf_dir: str) -> DataFrame:
    return store.statistics(files(spark, sf_dir), most=1 << 20).select("used_percent", "status", store.advice(F.col("used_percent")).alias("advice"))


def quota_admission(spark, sf_dir: str) -> DataFrame:
    return store.admit(files(spark, sf_dir).select("page_id", "size"), "size", "page_id", most=1 << 20, most_file=20_000)


def store_verify(spark, sf_dir: str) -> DataFrame:
    actual = files(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return store.verify(actual.select("files", (F.col("bytes") + 500).alias("bytes")), actual)


def content_base64(spark, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "labels").select("doc_id")
    return store.fetch(asked, read(spark, sf_dir, "documents").withColumn("text", F.encode("text", "UTF-8")), "doc_id", "text").withColumn("data", F.regexp_replace("data", "\r\n", ""))


def mime_magic(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("page_id", mime.by_magic(F.col("content")).alias("kind"))


def mime_extension(spark, sf_dir: str) -> DataFrame:
    ext = F.regexp_extract("url", r"(\.[A-Za-z0-9]+)$", 1)
    kind = mime.by_extension(ext)
    return read(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), kind.alias("kind"), mime.supported(kind).alias("supported"), mime.extension_of(kind).alias("back"))


def mime_detect(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("page_id", mime.detect(F.col("content"), F.lit("")).alias("kind"), mime.is_text(F.col("content")).alias("is_text"))


def size_parse(spark, sf_dir: str) -> DataFrame:
    size = F.concat((F.col("n_chars") / 4).cast("decimal(20,2)").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("", "B", " kb", "MB", " GB")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return read(spark, sf_dir, "documents").select("doc_id", mime.size_bytes(size).alias("n_bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_type_stats, doc_totals_rollup, chunk_totals_rollup, table_counts, chunks_by_ids, chunks_by_type, docs_recent, docs_newest, docs_distinct_source,
        docs_by_source, chunk_count_per_doc, chunk_scan, modality_counts, doc_insert_if_absent, chunk_last_wins, doc_metadata_update, content_delete,
        content_hash, content_dedup_report, content_new, memory_ingest, content_integrity, orphan_cleanup, storage_stats, storage_recommendation,
        quota_admission, store_verify, content_base64, mime_magic, mime_extension, mime_detect, size_parse,
    )
} | {"content_dedup": identified}

_S = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_CHUNKS = f"""WITH s AS (SELECT doc_id, lang, source, {_S} AS s FROM documents),
c AS (SELECT doc_id AS document_id, lang AS content_type, source, source || '-' || doc_id AS title, i - 1 AS chunk_index, s[i] AS content, substr(sha256(s[i]), 1, 32) AS embedding_id
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s))"""
_ID = "WITH d AS (SELECT {0} AS {1}, sha256({2}) AS content_id, octet_length(encode({2}))::BIGINT AS size FROM {3}), i AS (SELECT {1}, content_id, size, {1} <> min({1}) OVER (PARTITION BY content_id) AS was_deduped FROM d)"
_DOC = _ID.format("doc_id", "doc_id", "text", "documents")
_FILES = "WITH f AS (SELECT page_id, octet_length(encode(html))::BIGINT AS size FROM pages)"
_EXT = "regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1)"
_KINDS = "CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mime.BY_EXTENSION.items()) + f" ELSE '{mime.BINARY}' END"
_back: dict[str, str] = {}
for _k, _v in mime.BY_EXTENSION.items():
    _back.setdefault(_v, _k)
_HEAD = "lower(substr(html, 1, 32))"
_MAGIC = f"CASE WHEN html = '' THEN '{mime.BINARY}' WHEN {_HEAD} LIKE '%<svg%' THEN 'image/svg+xml' WHEN {_HEAD} LIKE '%<!doctype html%' OR {_HEAD} LIKE '%<html%' OR {_HEAD} LIKE '%<head%' THEN 'text/html' WHEN {_HEAD} LIKE '<?xml%' THEN 'application/xml' ELSE '{mime.BINARY}' END"
ORACLE_SQL = {
    "doc_type_stats": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "doc_totals_rollup": "SELECT lang, count(*) AS n, grouping(lang)::INT AS is_total FROM documents GROUP BY ROLLUP (lang)",
    "chunk_totals_rollup": f"{_CHUNKS} SELECT content_type, count(*) AS n, grouping(content_type)::INT AS is_total FROM c GROUP BY ROLLUP (content_type)",
    "table_counts": f"{_CHUNKS} SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM c",
    "chunks_by_ids": f"{_CHUNKS}, b AS (SELECT DISTINCT substr(sha256(x), 1, 32) AS embedding_id FROM (SELECT unnest({_S}) AS x FROM benchmark)) SELECT document_id, chunk_index::INT AS chunk_index, embedding_id, source, title FROM c WHERE embedding_id IN (SELECT embedding_id FROM b)",
    "chunks_by_type": f"{_CHUNKS} SELECT document_id, chunk_index::INT AS chunk_index, source, title, length(content)::INT AS n FROM c WHERE content_type = 'es'",
    "docs_recent": "SELECT doc_id AS document_id, source, source || '-' || doc_id AS title FROM documents WHERE lang = 'de' ORDER BY doc_id DESC",
    "docs_newest": "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 5",
    "docs_distinct_source": "SELECT DISTINCT source FROM documents ORDER BY source",
    "docs_by_source": "SELECT doc_id FROM documents WHERE source = (SELECT max(source) FROM documents)",
    "chunk_count_per_doc": f"{_CHUNKS} SELECT document_id, count(*) AS n_chunks FROM c GROUP BY document_id",
    "chunk_scan": f"{_CHUNKS} SELECT embedding_id, content, document_id, chunk_index::INT AS chunk_index FROM c",
    "modality_counts": "SELECT count(*) FILTER (lang NOT IN ('es', 'fr')) AS n_text, count(*) FILTER (lang = 'es') AS n_image, count(*) FILTER (lang = 'fr') AS n_other FROM documents",
    "doc_insert_if_absent": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "chunk_last_wins": f"{_CHUNKS} SELECT embedding_id, document_id, chunk_index::INT AS chunk_index FROM c QUALIFY row_number() OVER (PARTITION BY embedding_id ORDER BY document_id DESC, chunk_index DESC) = 1",
    "doc_metadata_update": "SELECT d.doc_id, coalesce('q' || l.quality, d.lang) AS metadata FROM documents d LEFT JOIN labels l USING (doc_id)",
    "content_delete": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "content_hash": "SELECT doc_id, sha256(text) AS content_id FROM documents",
    "content_dedup": f"{_DOC} SELECT * FROM i",
    "content_dedup_report": f"{_DOC} SELECT count(*) FILTER (was_deduped) AS removed, coalesce(sum(size) FILTER (was_deduped), 0)::BIGINT AS freed, count(*) FILTER (NOT was_deduped) AS kept FROM i",
    "content_new": f"{_DOC} SELECT doc_id, content_id, size FROM i WHERE NOT was_deduped AND content_id NOT IN (SELECT sha256(text) FROM conversations)",
    "memory_ingest": _ID.format("conv_id * 1000 + turn", "id", "text", "conversations") + " SELECT * FROM i",
    "content_integrity": "SELECT page_id, TRUE AS is_valid FROM pages",
    "orphan_cleanup": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "storage_stats": f"{_FILES} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) / 1048576.0::DOUBLE, 2) AS mb, round(sum(size)::DOUBLE / count(*), 2) AS average, round(100.0::DOUBLE * sum(size) / 67108864, 2) AS used_percent, greatest(0, 67108864 - sum(size))::BIGINT AS left, CASE WHEN used_percent >= 95 THEN 'critical' WHEN used_percent >= 75 THEN 'warning' WHEN used_percent >= 50 THEN 'notice' ELSE 'ok' END AS status FROM f",
    "storage_recommendation": f"{_FILES} SELECT round(100.0::DOUBLE * sum(size) / 1048576, 2) AS used_percent, CASE WHEN used_percent >= 95 THEN 'critical' WHEN used_percent >= 75 THEN 'warning' WHEN used_percent >= 50 THEN 'notice' ELSE 'ok' END AS status, CASE WHEN used_percent >= 95 THEN 'free space before anything else is taken in' WHEN used_percent >= 75 THEN 'remove orphans and duplicates soon' WHEN used_percent >= 50 THEN 'watch the store''s growth' ELSE 'nothing to do' END AS advice FROM f",
    "quota_admission": f"{_FILES}, p AS (SELECT page_id, size, 100.0::DOUBLE * sum(size) OVER (ORDER BY page_id) / 1048576 AS percent FROM f) SELECT page_id, size, CASE WHEN size > 20000 THEN 'too large' WHEN percent > 95 THEN 'rejected' WHEN percent > 75 THEN 'warning' ELSE 'accepted' END AS decision FROM p",
    "store_verify": f"{_FILES} SELECT count(*) AS recorded_files, (sum(size) + 500)::BIGINT AS recorded_bytes, count(*) AS files, sum(size)::BIGINT AS bytes, TRUE AS is_valid FROM f",
    "content_base64": "SELECT l.doc_id, base64(encode(d.text)) AS data, CASE WHEN d.text IS NULL THEN 'content not found' END AS error FROM labels l LEFT JOIN documents d USING (doc_id)",
    "mime_magic": f"SELECT page_id, {_MAGIC} AS kind FROM pages",
    "mime_extension": f"WITH p AS (SELECT page_id, {_EXT} AS ext FROM pages), k AS (SELECT *, {_KINDS} AS kind FROM p) SELECT page_id, ext, kind, kind IN ({', '.join(repr(x) for x in mime.SUPPORTED)}) AS supported, CASE kind {' '.join(f'WHEN {v!r} THEN {k!r}' for v, k in _back.items())} ELSE '.bin' END AS back FROM k",
    "mime_detect": f"SELECT page_id, CASE WHEN ({_MAGIC}) <> '{mime.BINARY}' THEN {_MAGIC} ELSE 'text/plain' END AS kind, TRUE AS is_text FROM pages",
    "size_parse": "SELECT doc_id, round((n_chars / 4.0::DOUBLE)::DECIMAL(20,2)::DOUBLE * [1, 1, 1024, 1048576, 1073741824][doc_id % 5 + 1])::BIGINT AS n_bytes FROM documents",
}
