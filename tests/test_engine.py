"""Vectors, search, ranking, catalog, store, files, ingest and streaming."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import mime, ranking, vectors
from tesserae.operators import catalog, embedding, ingest, knn, prompt, rerank, store
from tesserae.sources import files
from tesserae.streaming import ingest_stream


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.cosine(a, b), vectors.euclidean(a, b), vectors.dot(a, b), vectors.magnitude(a), vectors.normalized(a)).collect()
    assert [*got[0][:4], *got[0][4]] == pytest.approx([0.96, 2**0.5, 24.0, 5.0, 0.6, 0.8]) and got[1][0] == 0.0 and got[1][4] == [0.0, 0.0]
    bad = spark.createDataFrame([(None,), ([],), ([float("nan")],), ([0.0],), ([1e-9],), ([1.0],)], "a array<double>")
    assert [r[0] for r in bad.select(vectors.problem(a)).collect()] == ["empty", "empty", "not finite", "all zero", "too short", None]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.dot(a, b)).collect()


def test_knn(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: np.lexsort((np.arange(500), -np.round(u @ u[i], 6)))[:7].tolist() for i in range(0, 500, 100)}
    one = knn.top_k(rows, v[100].tolist(), 7).collect()
    assert [r["vec_id"] for r in one] == want[100] and [r["rank"] for r in one] == list(range(1, 8))
    got: dict = {}
    for r in knn.batch_top_k(rows, rows.where("vec_id % 100 = 0"), 7).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(knn, "ROW_BLOCK", 90)
    blocks: dict = {}
    for r in knn.batch_top_k(rows, rows.where("vec_id % 100 = 0"), 7).orderBy("rank").collect():
        blocks.setdefault(r["query_id"], []).append(r["id"])
    assert blocks == want and knn.batch_top_k(rows, rows.limit(0), 7).collect() == []
    assert knn.signature_bits(500) == 4 and knn.signature_bits(1 << 30) == 24
    near = knn.approximate_top_k(rows, rows.where("vec_id % 100 = 0"), 16, 7).collect()
    assert np.mean([r["id"] in want[r["query_id"]] for r in near]) >= 0.9 and len(near) == 35
    assert len(knn.top_k(rows.limit(3), v[0].tolist(), 10).collect()) == 3
    with pytest.raises(ValueError):
        knn.top_k(rows, v[0].tolist(), 0)


def results(spark):
    rows = [(1, "what is spark", 10, 0.9, "Spark provides joins", "Introduction", "intro/a.md", "text"), (1, "what is spark", 11, 0.95, "other", "x", "b.md", "text"), (1, "what is spark", 12, 0.5, "pixels", "p", "c.png", "image")]
    return spark.createDataFrame(rows, "query_id int, query string, id int, score double, content string, title string, source string, content_type string")


def test_rerank(spark):
    got = rerank.rerank(results(spark), "lexical").orderBy("rank").collect()
    assert [r["id"] for r in got] == [10, 11, 12] and got[0]["score"] == 1.0 and got[2]["score"] == 0.5
    assert rerank.rerank(results(spark), "disabled").orderBy("rank").first()["id"] == 11
    flat = rerank.rerank(results(spark), "cross-encoder", logits=lambda r: r.withColumn("logit", F.lit(0.0)))
    assert flat.orderBy("rank").first()["id"] == 10
    shown = rerank.rerank(results(spark).withColumn("caption", F.lit("spark provides")), "text-derived", "multimodal").collect()
    assert {r["id"]: r["content"] for r in shown}[12] == "pixels" and {r["id"]: r["score"] for r in shown}[12] > 0.5
    with pytest.raises(ValueError):
        rerank.rerank(results(spark), "unknown")
    with pytest.raises(ValueError):
        rerank.rerank(results(spark), "cross-encoder")


def test_filename_score(spark):
    q = F.lit("architecture diagram")
    df = spark.createDataFrame([("architecture-diagram.png",), ("random-file.txt",)], "n string")
    a, b = (r[0] for r in df.select(ranking.filename_score(q, F.col("n"))).collect())
    assert a == pytest.approx(0.6 * 1.3 * 1.5) and b == 0.0
    kinds = df.limit(1).select(ranking.type_score(q, F.lit("image")), ranking.type_score(F.lit("a guide"), F.lit("pdf")), ranking.type_score(q, F.lit("odd"))).first()
    assert list(kinds) == pytest.approx([1.6, 1.62, 0.5])


def test_cross_modal(spark):
    rows = results(spark).withColumn("similarity", F.lit(0.7)).withColumn("query_type", F.lit("text"))
    got = rerank.cross_modal(rows, threshold=0.5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(11, 0.95), (10, 0.9), (12, 0.7)]
    assert rerank.cross_modal(rows, threshold=0.8).count() == 2 and rerank.cross_modal(rows, include=("image",)).count() == 1
    assert {r["content_type"]: r["n"] for r in rerank.analysis(rerank.cross_modal(rows)).collect()} == {"text": 2, "image": 1}


def test_context(spark):
    rows = spark.createDataFrame([(1, 1, "t", "a" * 100), (1, 2, "t", "b" * 100), (2, 1, "t", "c" * 1000)], "query_id int, rank int, title string, content string")
    got = {r["query_id"]: r for r in prompt.contexts(rows, F.lit(60)).collect()}
    assert got[1]["context"] == "[Document 1: t]\n" + "a" * 100 + "\n---\n[Document 2: t]\n" + "b" * 100 if got[1]["included"] == 2 else got[1]["truncated"]
    assert got[2]["context"].endswith("\n[Content truncated...]") and got[2]["truncated"] and got[2]["included"] == 1
    assert [r["included"] for r in prompt.contexts(rows, F.lit(10)).collect()] == [0, 0]
    answer = spark.createDataFrame([("It is so. And then it st",), ("No end",)], "a string").select(prompt.clean_answer(F.col("a"), prompt.STOPS["instruct"]))
    assert answer.collect()[1][0] == "No end"


def test_catalog(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, source string, v string")
    new = spark.createDataFrame([(2, "b", "z"), (3, "c", "w"), (3, "c", "q")], "k int, source string, v string")
    assert [tuple(r) for r in catalog.insert_if_absent(docs, new, "source", "v").collect()] == [(3, "c", "q")]
    assert sorted(tuple(r) for r in catalog.replace(docs, new, "k").collect()) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q"), (3, "c", "w")]
    assert [tuple(r) for r in catalog.last_wins(new, "k", "v").orderBy("k").collect()] == [(2, "b", "z"), (3, "c", "w")]
    assert [r["v"] for r in catalog.update(docs, new.limit(1), "k", "v").orderBy("k").collect()] == ["x", "z"] and catalog.missing(new, docs, "k").count() == 1
    with pytest.raises(ValueError):
        catalog.check("odd", catalog.MODES, "mode")


def test_running_without_a_group_needs_no_single_task(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), (F.col("id") % 13).alias("n"))
    got = catalog.running(df, "n", [], ["k"], 16).orderBy("k").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["n"]


def test_running_splits_rows_of_one_value(spark):
    df = spark.range(20_000).select("id", F.lit(7).alias("ts"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"), (F.col("id") % 13).alias("n"))
    for by in ([], ["g"]):
        got = catalog.running(df, "n", by, ["ts"], 64)
        tie = F.xxhash64("id", "ts", "g", "n")
        want = df.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        assert got.count() == 20_000 and got.exceptAll(want).count() == 0
        assert max(r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 12_000
    assert catalog.running(df.limit(0), "n", [], ["ts"]).collect() == [] and [r["before"] for r in catalog.running(df.limit(1), "n", ["g"], ["ts"]).collect()] == [0]


def largest_task(df, tmp_path):
    """The largest share of the rows that one output task has."""
    df.write.parquet(f"file://{tmp_path}/out")
    counts = [r[1] for r in df.sparkSession.read.parquet(f"file://{tmp_path}/out").groupBy("_metadata.file_path").count().collect()]
    return max(counts) / sum(counts), len(counts)


def test_a_content_of_half_the_rows_is_split(spark, tmp_path):
    options = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in options}
    rows = spark.range(120_000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("c"), "id")).alias("content"))
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        share, n = largest_task(store.identify(rows, "content", "id"), tmp_path / "a")
        assert share < 2.5 / n + 0.05
        taken, refused = catalog.insert_new(spark.createDataFrame([("c1",)], "content string"), rows, "content")
        share, n = largest_task(refused, tmp_path / "b")
        assert share < 0.4 and n > 2  # half of the rows have one key
        assert taken.count() == 59_999 and spark.read.parquet(f"file://{tmp_path}/b/out").count() == 60_001
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_store(spark):
    df = spark.createDataFrame([(2, b"x"), (1, b"x"), (3, b"y")], "k int, c binary")
    got = store.identify(df, "c", "k").orderBy("k").collect()
    assert [r["was_deduped"] for r in got] == [False, True, False] and got[0]["content_id"] == got[1]["content_id"]
    sized = spark.createDataFrame([(i, 30) for i in range(5)], "k int, size long")
    assert [r["decision"] for r in store.admit(sized, "size", "k", most=110).orderBy("k").collect()] == ["accepted", "accepted", "warning", "rejected", "rejected"]
    asked = spark.createDataFrame([(1,), (9,)], "k int")
    assert [r["error"] for r in store.fetch(asked, df, "k", "c").orderBy("k").collect()] == [None, "content not found"]
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 20,), (1536,)], "s long").select(store.readable(F.col("s"))).collect()
    assert [r[0] for r in sizes] == ["5 B", "2 KB", "3 MB", "1.5 KB"]


def test_mime(spark):
    heads = {b"%PDF-1": "application/pdf", b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff\xe0": "image/jpeg", b"GIF89a": "image/gif", b"RIFF1234WEBP": "image/webp", b"PK\x03\x04": "application/zip", b"BM12": "image/bmp", b"II*\x00": "image/tiff", b"<svg a>": "image/svg+xml", b"<!DOCTYPE html>": "text/html", b"<?xml v": "application/xml", b'{"a": 1}': "application/json", b"{no": mime.BINARY, b"": mime.BINARY}
    df = spark.createDataFrame([(k,) for k in heads], "c binary")
    assert [r[0] for r in df.select(mime.by_magic(F.col("c"))).collect()] == list(heads.values())
    texts = spark.createDataFrame([(b"plain text",), (b"\x00\x01\x02" * 9,)], "c binary").select(mime.detect(F.col("c"), F.lit(".zzz"))).collect()
    assert [r[0] for r in texts] == ["text/plain", mime.BINARY]
    sizes = spark.createDataFrame([("1.5 MB",), ("10",), ("2kb",), ("x",)], "s string").select(mime.size_bytes(F.col("s"))).collect()
    assert [r[0] for r in sizes] == [1572864, 10, 2048, None] and len(mime.SUPPORTED) == 30


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480)


def test_dimensions():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\x00" * 9
    assert files.dimensions(PNG) == (640, 480) and files.dimensions(jpeg) == (30, 20) and files.dimensions(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert files.dimensions(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6) and files.dimensions(b"no") is None and files.dimensions(PNG[:18]) is None
    bits = (99 - 1) | (77 - 1) << 14
    assert files.dimensions(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + bits.to_bytes(4, "little")) == (99, 77)
    assert files.docx_text(docx("a", "", "b")) == "a\n\nb" and files.docx_text(b"no zip") is None


def test_files_ingest_search_and_stream(spark, tmp_path):
    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    (top / "a.md").write_text("# Alpha\n\nspark joins tables quickly")
    (top / "sub" / "b.txt").write_text("bread and butter")
    (top / "c.png").write_bytes(PNG)
    (top / "d.png").write_bytes(b"not an image")
    (top / "e.exe").write_bytes(b"x")
    (top / "f.docx").write_bytes(docx("word document"))
    (top / "g.txt").write_text("  \n")
    found = files.discover(spark, f"file://{top}", mode="multimodal").cache()
    why = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in found.collect()}
    assert why["e.exe"] and why["d.png"] and not why["a.md"] and not why["c.png"]
    assert {r["path"].rsplit("/", 1)[1] for r in files.discover(spark, f"file://{top}", recursive=False).where("reason IS NULL").collect()} == {"a.md", "f.docx", "g.txt"}
    docs = files.documents(found).cache()
    by = {r["source"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert by["a.md"]["title"] == "Alpha" and by["b.txt"]["title"] == "b" and by["f.docx"]["content"] == "word document" and by["g.txt"]["error"]
    assert "Dimensions: 640x480" in by["c.png"]["content"] and "Format: PNG" in by["c.png"]["content"]

    base = ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb", ingest.Config(mode="multimodal"))
    assert not base.has_data()
    base.ingest(docs.where("error IS NULL").drop("error"))
    assert base.has_data() and base.table("documents").count() == 4
    hit = base.search("spark joins", 2, "text").orderBy("rank").first()
    assert hit["title"] == "Alpha" and base.search(" ").count() == 0
    assert {r["content_type"] for r in base.search("image file", 5, "image", "text-derived").collect()} == {"image"}
    again = spark.createDataFrame([(hit["source"], "New", "entirely new words", "text")], "source string, title string, content string, content_type string")
    base.ingest(again)
    assert base.table("documents").count() == 4 and base.search("spark joins", 1, "text").first()["score"] < hit["score"]
    assert tuple(base.last_ingest().first()) == (1, 0, 1, 1, 0)
    info = base.system_info().first()
    assert (info["mode"], info["dim"], info["model"], info["chunk_size"]) == ("multimodal", 64, "word-hash-64", 250)
    base.set_system_info(rerank="lexical")
    reopened = ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert reopened.config == base.config and reopened.system_info().first()["rerank"] == "lexical" and reopened.system_info().first()["dim"] == 64
    near = base.search_vector(embedding.hash_embed(["bread and butter"])[0].tolist(), k=1).first()
    assert near["title"] == "b" and near["rank"] == 1
    with pytest.raises(ValueError, match="dimensions"):
        base.search_vector([1.0, 2.0])
    said, answer = base.answer("bread butter", lambda prompts: [f"So it is. {len(prompts)}<|im_end|>x" for _ in prompts], k=2, chunks=1)
    got = answer.first()
    assert said.count() == 2 and got["response"] == "So it is." and got["included"] == 1 and "bread and butter" in got["prompt"] and got["error"] is None
    assert base.answer("bread", None)[1] is None

    def broken(prompts):
        raise RuntimeError("no model")

    assert base.answer("bread", broken, k=2)[1].first()["error"] == "RuntimeError: no model"
    before = sorted(map(str, base.table("chunks").collect()))
    base.compact()
    assert sorted(map(str, base.table("chunks").collect())) == before and base._live() == [3] and not (tmp_path / "kb" / "v1").exists()
    base.rebuild()
    assert base.table("vectors").count() == base.table("chunks").count()
    with pytest.raises(ValueError, match="rebuild"):
        ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb", ingest.Config(model="other")).check_model()

    live = ingest.KnowledgeBase(spark, f"file://{tmp_path}/live")
    ingest_stream(live, f"file://{top}", f"file://{tmp_path}/state").awaitTermination()
    assert live.table("documents").count() == 3
    (top / "h.txt").write_text("one more")
    ingest_stream(live, f"file://{top}", f"file://{tmp_path}/state").awaitTermination()
    assert live.table("documents").count() == 4
    assert base.reset()["documents"] == 4 and not base.has_data()


def test_embedding_errors_stay_with_their_rows(spark):
    def sometimes(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return embedding.hash_embed(texts)

    got = embedding.embed(spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "k int, t string"), "t", sometimes).orderBy("k").collect()
    assert got[0]["embedding"] and got[1]["embedding"] is None and "no" in got[1]["embedding_error"] and got[2]["embedding"] == [0.0] * 64


def test_partial_updates_and_refused_inserts(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, p string, q string")
    changes = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id int, p string, q string")
    assert sorted(map(str, (tuple(r) for r in catalog.merge(rows, changes, "id").collect()))) == sorted(map(str, [(1, "a", None), (2, "b", "y"), (3, "c", None)]))
    taken, refused = catalog.insert_new(rows, spark.createDataFrame([(2, "x", "x"), (4, "x", "x"), (5, "x", "x"), (5, "y", "y")], "id int, p string, q string"), "id")
    assert [r["id"] for r in taken.collect()] == [4] and sorted(r["id"] for r in refused.collect()) == [2, 5, 5]
    log = spark.createDataFrame([(1, "text", None), (2, None, 3), (3, "multimodal", None)], "seq int, mode string, top_k int")
    assert tuple(catalog.settings(log, "seq").first()) == ("multimodal", 3) and catalog.settings(log.limit(0), "seq").collect() == []


def test_registry(spark):
    from tesserae.operators import registry as r

    assert r.default_model("clip") == "Xenova/clip-vit-base-patch32" and r.models_for("image") == [m for m in r.MODELS if "clip" in m]
    assert r.models(spark).where("dim = 384").count() == 1 and r.similar("my-CLIP") == r.models_for("image") and r.generator(True).chunks == 5
    with pytest.raises(r.EngineError, match="similar"):
        r.model("clip-large")
    with pytest.raises(r.EngineError):
        r.check_mode("multimodal", "Xenova/all-mpnet-base-v2")
    assert r.check_mode("text", "Xenova/clip-vit-base-patch16") and not r.check_mode("text", "Xenova/all-mpnet-base-v2")
    assert not r.Reranking("disabled").enabled and r.Reranking("metadata", semantic=0.4).enabled
    for bad in ({"strategy": "odd"}, {"strategy": "lexical", "visual": 2}, {"strategy": "lexical", "fallback": "odd"}):
        with pytest.raises(r.EngineError):
            r.Reranking(**bad)
    for bad in (("", 1), ("x" * 501, 1), ("q", 0), ("q", 101), ("q", True)):
        with pytest.raises(r.EngineError):
            r.check_query(*bad)
    assert r.model_version("m", {"a": 1, "b": 2}) == r.model_version("m", {"b": 2, "a": 1}) != r.model_version("m", {})
    paths = spark.createDataFrame([("/in/a/b.md",), ("/other/c.md",)], "p string").select(r.storage_path(F.col("p"), "/in/a"))
    assert [x[0] for x in paths.collect()] == ["b.md", "/other/c.md"] and r.absolute_path("b.md", "/in/a") == "/in/a/b.md"
    rows = spark.createDataFrame([("hash", 100, 1 << 20, True), ("read error", 300, 0, False)], "operation string, duration_ms long, bytes long, cache_hit boolean")
    assert tuple(r.operation_metrics(rows).first()) == (2, 200.0, 1 << 20, 2.5, 50.0, 50.0)
    assert r.operation_metrics(rows.limit(0)).first()["operations"] == 0
    assert [x[0] for x in spark.createDataFrame([(15,), (1500,)], "m long").select(r.duration(F.col("m"))).collect()] == ["15ms", "1.5s"]
