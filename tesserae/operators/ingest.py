"""Taking documents in: preprocess, chunk, embed; and a knowledge base of parquet tables that is added to, rebuilt and reset."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import markup, text, vectors
from tesserae.operators import ann, catalog, chunking, embedding, prompt
from tesserae.operators.registry import Category, EngineError
from tesserae.operators.tables import KEPT, Commit, LogTables
from tesserae.sources import files

Chunker = Callable[[DataFrame, "Config"], DataFrame]


@dataclass(frozen=True)
class Config:
    mode: str = "text"
    preprocessing: str = "balanced"
    chunks: chunking.ChunkConfig = field(default_factory=chunking.ChunkConfig)
    model: str = "word-hash-64"
    top_k: int = 10

    def __post_init__(self) -> None:
        catalog.check(self.mode, catalog.MODES, "mode")
        catalog.check(self.preprocessing, tuple(markup.MODES), "preprocessing")
        if self.top_k < 1:
            raise ValueError("top_k must be positive")


def standard_chunks(docs: DataFrame, config: Config) -> DataFrame:
    """(document_id, chunk_index, content, token_count, source, content_type) by sentences and paragraphs; images are one chunk."""
    return chunking.chunk(docs, "document_id", "content", config.chunks, "content_type", keep=("source", "content_type"))


def document_id(source: Column) -> Column:
    """128 bits of the source's digest, in hex."""
    return F.substring(F.sha2(source.cast("binary"), 256), 1, 32)


def prepared(docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(source, title, content, content_type) documents that the mode takes, preprocessed, with their ids; and the others, with reasons."""
    fit, unfit = files.in_mode(docs, config.mode)
    ids = fit.withColumn("document_id", document_id(F.col("source")))
    text_ = F.when(F.col("content_type") == "image", None).otherwise(F.col("content"))
    ids = ids.withColumn("_kind", text.language(text_, F.col("source")))  # told once
    ids = ids.withColumn("_needed", F.coalesce(text.needs_preprocessing(text_, F.col("_kind")), F.lit(False)))  # searched once, and not for images
    clean = F.when(F.col("content_type") == "image", F.col("content")).otherwise(markup.preprocess(F.col("content"), F.col("_kind"), config.preprocessing, F.col("_needed")))
    return ids.withColumn("content", clean).drop("_kind", "_needed"), unfit.select("source", "reason")


def last_of_each(ready: DataFrame, order: str | None = None) -> DataFrame:
    """(document_id, d, n): of documents of one id the last, by ``order`` if there is one, then by title and content; and how many there are.

    The document is carried through the aggregation, which is begun before the shuffle: an id with very many documents is no load.
    """
    kept = [c for c in ready.columns if c != order]
    last = F.max_by(F.struct(*kept), F.struct(*([order] if order else []), "title", "content"))
    return ready.groupBy("document_id").agg(last.alias("d"), F.count("*").alias("n"))


def superseded(lasts: DataFrame) -> DataFrame:
    """(source, reason): a row for each document that isn't its source's last."""
    more = lasts.where("n > 1").select("d.source", F.lit("a later document of this source is taken").alias("reason"), F.explode(F.expr("sequence(2, n)")).alias("k"))
    return more.drop("k")


def chunked(clean: DataFrame, config: Config, chunker: Chunker = standard_chunks) -> DataFrame:
    """(embedding_id, document_id, source, chunk_index, content, content_type, token_count). An id tells its content type where that isn't text."""
    parts = chunker(clean, config)
    if lacking := [c for c in ("source", "content_type") if c not in parts.columns]:  # documents are shuffled and prepared again only for a chunker that drops these
        parts = parts.join(clean.select("document_id", *lacking), "document_id")
    made = text.embedding_id(F.concat_ws("/", "document_id", "chunk_index", "content"))
    named = F.when(F.col("content_type") == "image", F.concat(F.lit("image_"), made)).otherwise(made)
    return parts.select(named.alias("embedding_id"), "document_id", "source", "chunk_index", "content", "content_type", "token_count")


def embedded(parts: DataFrame, embed: embedding.Embed = embedding.hash_embed, images: embedding.Embed | None = None, data: DataFrame | None = None) -> DataFrame:
    """(embedding_id, document_id, source, content_type, embedding, reason): a vector per chunk, or the reason why there is none.

    ``images`` embeds image chunks: from the bytes of their documents in ``data``, rows of (document_id, data), or where that isn't given from what
    the chunker left in ``content``; without ``images`` they are texts. Images without bytes have no vector.
    """
    kept = parts.select("embedding_id", "document_id", "source", "content_type", "content")
    made = embedding.embed(kept.where("content_type <> 'image'") if images else kept, "content", embed)
    if images:
        pictures, column = kept.where("content_type = 'image'"), "content"
        if data is not None:
            pictures, column = pictures.drop("content").join(data.select("document_id", "data").where("data IS NOT NULL"), "document_id", "left"), "data"
        seen = embedding.embed(pictures, column, images, batch=embedding.BATCHES["image"], keep=False)
        made = made.drop("content").unionByName(seen)
    bad = F.coalesce("embedding_error", vectors.problem(F.col("embedding")))
    return made.select("embedding_id", "document_id", "source", "content_type", F.when(bad.isNull(), F.col("embedding")).alias("embedding"), bad.alias("reason"))


def summary(documents: DataFrame, made: DataFrame, unfit: DataFrame) -> DataFrame:
    """A row of what an ingest did: documents taken, documents left out, chunks, embeddings and chunks without one.

    ``made`` has a row per chunk, so what is embedded is read once.
    """
    names = ("documents", "skipped", "chunks", "embeddings", "errors")
    count = lambda df, **what: df.agg(*[what.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    every, fine = F.count("*"), F.count("embedding")
    parts = [count(documents, documents=every), count(unfit, skipped=every), count(made, chunks=every, embeddings=fine, errors=every - fine)]
    return functools.reduce(DataFrame.unionByName, parts).agg(*[F.sum(n).alias(n) for n in names])


SYSTEM = "mode string, model string, dim int, preprocessing string, chunk_size int, chunk_overlap int, top_k int, rerank string"


class KnowledgeBase:
    """Tables documents, chunks and vectors under a path. Taking a source in again replaces its rows.

    The tables are those of ``tables``: writers commit without overwriting each other, readers see whole commits, small commits
    are merged, and a table is one scan. A document's rows are those of its newest commit. ``build_index`` deals vectors to
    cells, and later commits follow it; a search then reads the cells that it probes.
    Settings are stored too: a base that is opened without any has those it was last written with.
    """

    NAMES = ("documents", "chunks", "vectors")
    PARTITIONS = {"vectors": ["content_type", "cell"]}

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = LogTables(spark, path, self.PARTITIONS)
        self.config = config or self._stored() or Config()

    # versions

    def _exists(self, path: str) -> bool:
        store, where = self.tables._at(path)
        return store.exists(where)

    def _live(self) -> list[int]:
        return [c.version for c in self.tables.live()]

    def _current(self, name: str, commits: list[Commit]) -> DataFrame:
        """The rows that some commits leave, those of documents that came again in a newer one left out."""
        return self._newest(self.tables.scan(name, commits), commits)

    def _newest(self, rows: DataFrame, commits: list[Commit]) -> DataFrame:
        if len(commits) > 1:  # ids that came again are few or many, Spark sees from the aggregate
            newest = self.tables.scan("documents", commits).groupBy("document_id").agg(F.max("at").alias("newest"), F.count("*").alias("n")).where("n > 1")
            rows = rows.join(newest.select("document_id", "newest"), "document_id", "left").where("newest IS NULL OR at = newest").drop("newest")
        return rows.drop("at", "commit")

    def table(self, name: str) -> DataFrame | None:
        """The rows of documents' newest versions; null if nothing was written yet."""
        live = self.tables.live()
        if not live:
            return None
        rows = self._current(name, live)
        return rows.where("embedding IS NOT NULL").drop("cell") if name == "vectors" else rows

    def compact(self) -> None:
        """One version of all that is current; the others are deleted."""
        live = self.tables.live()
        if len(live) > 1:
            index = {c.index for c in live}
            self._whole({name: self._current(name, live) for name in self.NAMES}, index.pop() if len(index) == 1 else None, live)

    def vacuum(self, seconds: float = KEPT) -> int:
        return self.tables.vacuum(seconds)

    def _whole(self, rows: dict[str, DataFrame], index: str | None = None, live: list[Commit] | None = None) -> None:
        live = self.tables.live() if live is None else live
        if "cell" not in rows["vectors"].columns:
            rows = rows | {"vectors": rows["vectors"].withColumn("cell", F.lit(None).cast("int"))}
        self.tables.replace(live, rows.get, "whole", max((c.level for c in live), default=0) + 1, index, list(rows))
        self.tables.vacuum(0)

    # the index

    def build_index(self, cells: int | None = None) -> ann.Quantiser:
        """Fits cells to the vectors and deals them out; vectors that are taken in later go to these cells too, until the index is built again."""
        live = self.tables.live()
        vectors_ = self._current("vectors", live).drop("cell") if live else None
        if vectors_ is None or not catalog.has_rows(vectors_.where("embedding IS NOT NULL")):
            raise EngineError("no vectors to build an index of", Category.INDEX)
        quantiser = ann.Quantiser.fit(vectors_, cells=cells)
        name = f"q{uuid.uuid4().hex}"
        self.tables._create(f"{self.path}/index/{name}.json", quantiser.dumps())
        rows = {n: self._current(n, live) for n in ("documents", "chunks")} | {"vectors": ann.with_cells(vectors_, quantiser)}
        self._whole(rows, name, live)
        return quantiser

    def index(self, commits: list[Commit] | None = None) -> tuple[str, ann.Quantiser] | None:
        """The newest index of the live commits, by name."""
        names = [c.index for c in (self.tables.live() if commits is None else commits) if c.index]
        if not names:
            return None
        return names[-1], ann.Quantiser.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/index/{names[-1]}.json").collect()))

    def probed(self, vector: list[float], content_type: str | None = None, recall: float = 0.95) -> DataFrame:
        """The vectors that an approximate search for one reads: the probed cells, and all of commits that know other cells or none."""
        live = self.tables.live()
        found = self.index(live)
        if found is None:
            raise EngineError("there is no index: build_index first", Category.INDEX)
        name, quantiser = found
        celled = [c.folder for c in live if c.index == name]
        cells = quantiser.cells_of(vector, quantiser.probes(recall))
        rows = self.tables.scan("vectors", live).where(F.col("cell").isNull() | F.col("cell").isin(cells) | ~F.col("commit").isin(celled)).where("embedding IS NOT NULL")
        rows = rows.where(F.col("content_type") == content_type) if content_type in catalog.CONTENT_TYPES else rows
        return self._newest(rows, live).drop("cell")

    # settings

    def system_info(self) -> DataFrame | None:
        """The stored settings, a row: of each, the last that was set."""
        if not self._exists(f"{self.path}/system"):
            return None
        return catalog.settings(self.spark.read.schema(f"seq long, {SYSTEM}").json(f"{self.path}/system"), "seq")

    def set_system_info(self, **changes: object) -> None:
        """Sets some of the settings and leaves the others as they are."""
        catalog.check(changes.get("mode", "text"), catalog.MODES, "mode")
        names = [part.split()[0] for part in SYSTEM.split(", ")]
        if unknown := set(changes) - set(names):
            raise EngineError(f"unknown settings {', '.join(sorted(unknown))}", Category.CONFIGURATION)
        row = self.spark.createDataFrame([(time.time_ns(), *(changes.get(n) for n in names))], f"seq long, {SYSTEM}")
        row.coalesce(1).write.mode("append").json(f"{self.path}/system")

    def _stored(self) -> Config | None:
        rows = self.system_info()
        found = rows.first() if rows is not None else None
        if found is None:
            return None
        given = {k: found[k] for k in ("mode", "preprocessing", "model", "top_k") if found[k] is not None}
        size, overlap = found["chunk_size"], found["chunk_overlap"]
        return replace(Config(**given), chunks=chunking.ChunkConfig(size, overlap) if size else chunking.ChunkConfig())

    def _remember(self, dim: int | None) -> None:
        c = asdict(self.config)
        rows = self.system_info()
        now = rows.first().asDict() if rows is not None else {}
        new = {"mode": c["mode"], "model": c["model"], "dim": dim, "preprocessing": c["preprocessing"], "chunk_size": c["chunks"]["size"], "chunk_overlap": c["chunks"]["overlap"], "top_k": c["top_k"]}
        if changed := {k: v for k, v in new.items() if v is not None and now.get(k) != v}:
            self.set_system_info(**changed)

    def has_data(self) -> bool:
        rows = self.table("documents")
        return rows is not None and catalog.has_rows(rows)

    def has_vectors(self) -> bool:
        rows = self.table("vectors")
        return rows is not None and catalog.has_rows(rows)

    def check_model(self, dim: int | None = None) -> None:
        rows = self.system_info()
        found = rows.first() if rows is not None else None
        if found and found["model"] and found["model"] != self.config.model and self.has_vectors():
            raise ValueError(f"vectors are of model {found['model']}, not {self.config.model}: rebuild first")
        if found and dim and found["dim"] and found["dim"] != dim:
            raise ValueError(f"vectors have {found['dim']} dimensions, not {dim}")

    # writing

    def ingest(
        self, docs: DataFrame, embed: embedding.Embed = embedding.hash_embed, chunker: Chunker = standard_chunks, images: embedding.Embed | None = None,
        order: str | None = None, batch: tuple[str, int] | None = None,
    ) -> DataFrame:
        """Adds documents; returns the skipped ones and the chunks without vectors, with reasons.

        Documents are read and preprocessed once, chunked once and embedded once: each step reads what the one before wrote. Of documents
        of one source the last is taken, by column ``order`` if there is one, then by title and content; the others are skipped.
        A column ``data`` holds the bytes of images, which ``images`` then gets; they aren't stored.
        ``batch``: a stream and the number of its batch; one that was taken in before is left alone.
        """
        self.check_model()
        none = self.spark.createDataFrame([], "source string, reason string")
        if self.tables.done(batch):
            return none
        found, folder = self.index(), self.tables.folder()
        ready, unfit = prepared(docs, self.config)
        ready = self.tables.put(folder, "sources", last_of_each(ready, order))
        unfit = self.tables.put(folder, "skipped", unfit.unionByName(superseded(ready)))
        clean = ready.select("d.*")
        data = clean.select("document_id", "data") if "data" in clean.columns else None
        put = {"skipped": unfit, "documents": self.tables.put(folder, "documents", clean.select("document_id", "source", "title", "content_type"))}
        put["chunks"] = parts = self.tables.put(folder, "chunks", chunked(clean, self.config, chunker))
        made = embedded(parts, embed, images, data)
        made = ann.with_cells(made, found[1]) if found else made.withColumn("cell", F.lit(None).cast("int"))
        put["vectors"] = made = self.tables.put(folder, "vectors", made)
        entry = self.tables.commit(folder, {name: df.schema for name, df in put.items()}, batch=batch, index=found[0] if found else None)
        self.tables.drop(folder, {"sources": None})
        if entry is None:
            return none
        first = made.where("embedding IS NOT NULL").select(F.size("embedding").alias("d")).first()
        self._remember(first["d"] if first else None)
        if self.tables.merge(self._current, self.NAMES):
            self.tables.vacuum()
        return unfit.unionByName(made.where("reason IS NOT NULL").select("source", "reason"))

    def last_ingest(self) -> DataFrame:
        """The summary row of the last ingest; its rows must be there still."""
        added = [c for c in self.tables.log() if c.kind == "add"]
        if not added:
            raise EngineError("nothing was taken in, or what was has been compacted", Category.DATABASE)
        one = lambda name: self.tables.scan(name, added[-1:])
        return summary(one("documents"), one("vectors"), one("skipped"))

    def rebuild(self, embed: embedding.Embed = embedding.hash_embed, images: embedding.Embed | None = None, data: DataFrame | None = None) -> None:
        """Vectors anew from the stored chunks, with the present model. ``data``: documents of images, with source and data, for ``images``."""
        chunks = self.table("chunks")
        data = None if data is None else data.select(document_id(F.col("source")).alias("document_id"), "data")
        self._whole({"documents": self.table("documents"), "chunks": chunks, "vectors": embedded(chunks, embed, images, data)})
        first = self.table("vectors").select(F.size("embedding").alias("d")).first()
        self._remember(first["d"] if first else None)

    def reset(self) -> dict[str, int]:
        """Empties all tables; returns how many rows each had."""
        if not self._live():
            return dict.fromkeys(self.NAMES, 0)
        old = {name: self.table(name) for name in self.NAMES}
        counts = {name: df.count() for name, df in old.items()}
        self._whole({name: df.limit(0) for name, df in old.items()})
        return counts

    # reading

    def search(
        self, query: str, k: int | None = None, content_type: str | None = None, rerank: str = "disabled", embed: embedding.Embed = embedding.hash_embed, approximate: bool = False
    ) -> DataFrame:
        """The nearest chunks and their documents; none for a blank query."""
        return self.search_vector(embed([query])[0].tolist() if query.strip() else None, query, k, content_type, rerank, approximate)

    def search_vector(
        self, vector: list[float] | None, query: str = "", k: int | None = None, content_type: str | None = None, rerank: str = "disabled", approximate: bool = False, recall: float = 0.95
    ) -> DataFrame:
        """The chunks nearest to a vector at hand, and their documents. The type filter prunes partitions before the search; vectors are searched without texts.

        ``approximate`` reads only the index's cells that hold ``recall`` of neighbours, as measured on a sample when it was built.
        """
        from tesserae.operators import knn, rerank as reranking

        rows = self.table("vectors")
        if rows is None or vector is None:
            return self.spark.createDataFrame([], "query_id int, query string, id string, score double, content string, title string, source string, content_type string, rank int, rounded_score double")
        self.check_model(len(vector))
        rows = rows.where(F.col("content_type") == content_type) if content_type in catalog.CONTENT_TYPES else rows
        rows = self.probed(vector, content_type, recall) if approximate else rows
        best = knn.top_k(rows, vector, k or self.config.top_k, "embedding_id").drop("rank", "distance")
        found = best.join(self.table("chunks").select("embedding_id", "document_id", "content"), "embedding_id").join(self.table("documents"), "document_id")
        found = found.select(
            F.lit(0).alias("query_id"), F.lit(query).alias("query"), F.col("embedding_id").alias("id"), F.greatest(F.lit(0.0), "score").alias("score"),
            "content", "title", "source", "content_type", F.lit(None).cast("string").alias("caption"),
        )
        return reranking.rerank(found, rerank, self.config.mode if rerank != "text-derived" else "multimodal")

    def answer(self, query: str, generator: prompt.Answer | None, k: int | None = None, content_type: str | None = None, rerank: str = "disabled", **options: object) -> tuple[DataFrame, DataFrame | None]:
        """Search results, and the answer that a generator gives from the best of them; no answer without a generator or results."""
        results = self.search(query, k, content_type, rerank)
        if generator is None or results.isEmpty():
            return results, None
        return results, prompt.generate(results, generator, **options)

    def stats(self) -> DataFrame:
        return catalog.type_statistics(self.table("chunks")).withColumn("model", F.lit(self.config.model))
