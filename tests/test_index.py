"""The stored index, the exact join, and tables that several writers add to."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import ann, ingest, knn, tables
from tesserae.operators.registry import EngineError


def clustered(spark, n, dim=16, middles=50, spread=0.5, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(middles, dim)) * 2
    v = middle[np.arange(n) % middles] + rng.normal(size=(n, dim)) * spread
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(v), pa.list_(pa.float64()))})), v


@pytest.mark.parametrize("n", [2_000, 200_000])
def test_index_recall_and_how_much_it_probes(spark, n):
    rows, v = clustered(spark, n)
    quantiser = ann.Quantiser.fit(rows)
    assert ann.Quantiser.loads(quantiser.dumps()).probes() == quantiser.probes() <= len(quantiser.centroids) / 4
    asked = rows.where(F.col("vec_id") % (n // 40) == 0)
    got: dict = {}
    for r in ann.batch(rows, asked, quantiser).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: set(np.argsort(-(u @ u[i]), kind="stable")[:10].tolist()) for i in got}
    assert len(got) == 40 and sum(len(got[i] & want[i]) for i in got) >= 0.9 * 400
    one = ann.probed(ann.with_cells(rows, quantiser), quantiser, v[0].tolist())
    assert one.count() < n / 4


def test_join_is_exact_and_sends_queries_to_few_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)
    rows, _ = clustered(spark, 3000, middles=30)
    extra = spark.createDataFrame([(9000 + i, [0.0] * 16) for i in range(12)] + [(9100, None), (9101, [float("nan")] * 16), (9102, [1.0])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 50 = 0").unionByName(extra.where("vec_id IN (9000, 9100)"))
    quantiser = ann.Quantiser.fit(rows)
    got, went = ann.join(rows.unionByName(extra), asked, quantiser)
    fine = rows.unionByName(extra.where("vec_id < 9100"))
    want = knn.batch_top_k(fine, asked.where("vec_id < 9100"))
    assert sorted(map(tuple, got.select("query_id", "rank", "id", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "id", "score").collect()))
    assert went.agg(F.avg("cells")).first()[0] < len(quantiser.centroids) / 3
    few, _ = ann.join(rows.limit(4), asked.limit(2), quantiser)
    assert few.groupBy("query_id").count().where("count = 4").count() == 2
    assert ann.join(rows.limit(0), asked, quantiser)[0].collect() == []


def test_flips_are_all_sets_within_a_cost():
    cost = np.array([0.5, 0.1, 0.3, 0.9])
    got = knn.flips(cost, 0.85)
    want = [m for m in range(16) if sum(cost[j] for j in range(4) if m >> j & 1) <= 0.85]
    assert got[0] == 0 and sorted(got) == want and len(set(got)) == len(got)


@pytest.mark.parametrize(("n", "spread"), [(500, 3.0), (4_000, 1.5), (60_000, 0.4)])
def test_signatures_keep_their_recall_at_any_size(spark, n, spread):
    rows, v = clustered(spark, n, middles=50, spread=spread)
    asked = rows.where(F.col("vec_id") % (n // 25) == 3)
    got: dict = {}
    for r in knn.approximate_top_k(rows, asked, 16).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: set(np.lexsort((np.arange(n), -np.round(u @ u[i], 6)))[:10].tolist()) for i in got}
    assert len(got) == 25 and sum(len(got[i] & want[i]) for i in got) >= 0.9 * 250


def words(spark, n, tag):
    rows = [(f"{tag}/{i}.md", f"T{i}", f"{tag} text number{i} group{i % 7} " * 3, "text") for i in range(n)]
    return spark.createDataFrame(rows, "source string, title string, content string, content_type string")


def test_stored_index(spark, tmp_path):
    base = ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    with pytest.raises(EngineError, match="no vectors"):
        base.build_index()
    base.ingest(words(spark, 120, "one"))
    with pytest.raises(EngineError, match="build_index"):
        base.search("one text", approximate=True)
    base.build_index(cells=12)
    base.ingest(words(spark, 30, "two"))  # goes to the same cells
    name, quantiser = base.index()
    assert [c.index for c in base.tables.live()] == [name, name]
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    live = base.tables.live()
    every = base.tables.scan("vectors", live)
    cells = quantiser.cells_of([1.0] + [0.0] * 63, 2)
    assert files(every.where(F.col("cell").isin(cells))) < files(every) / 2
    probed = base.probed(every.select("embedding").first()[0], recall=0.9)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and probed.count() <= every.count()
    exact = [r["id"] for r in base.search("two text number3 group3", 10).orderBy("rank").collect()]
    near = [r["id"] for r in base.search("two text number3 group3", 10, approximate=True).orderBy("rank").collect()]
    assert near[0] == exact[0] and len(set(near) & set(exact)) >= 8
    base.ingest(words(spark, 5, "two"))  # sources that come again replace their rows, in the index too
    assert base.table("vectors").count() == 150 == base.probed([1.0] * 64, recall=1.0).count() or quantiser.probes(1.0) < 12
    base.rebuild()
    assert base.index() is None and base.table("vectors").count() == 150


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    a, b = (ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb") for _ in range(2))
    a.ingest(words(spark, 3, "first"))
    commit = tables.LogTables.commit

    def later(self, *args, **options):  # b commits while a is about to
        monkeypatch.setattr(tables.LogTables, "commit", commit)
        b.ingest(words(spark, 4, "b"))
        return commit(self, *args, **options)

    monkeypatch.setattr(tables.LogTables, "commit", later)
    a.ingest(words(spark, 5, "a"))
    assert a.table("documents").count() == 12 == b.table("documents").count() and a._live() == [1, 2, 3]

    create = tables.LogTables._create

    def taken(self, path, text):  # the version is taken between the reading of the log and the creation of the entry
        monkeypatch.setattr(tables.LogTables, "_create", create)
        b.ingest(words(spark, 2, "c"))
        return create(self, path, text)

    monkeypatch.setattr(tables.LogTables, "_create", taken)
    a.ingest(words(spark, 2, "d"))
    assert a.table("documents").count() == 16 and a._live() == [1, 2, 3, 4, 5]
    assert not a.tables._create(f"file://{tmp_path}/kb/log/{5:012d}.json", "other")

    def compacted(self, *args, **options):
        monkeypatch.setattr(tables.LogTables, "commit", commit)
        b.compact()
        return commit(self, *args, **options)

    monkeypatch.setattr(tables.LogTables, "commit", compacted)
    with pytest.raises(tables.Conflict):
        a.compact()
    assert a.table("documents").count() == 16 and len(a._live()) == 1


def test_a_batch_that_comes_again_is_not_written_twice(spark, tmp_path):
    base = ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    base.tables.fan = 3
    for n in range(4):
        base.ingest(words(spark, 2, f"b{n}"), batch=("stream", n))
    before, counts = base._live(), base.table("chunks").count()
    for n in (1, 3):
        base.ingest(words(spark, 2, f"again{n}"), batch=("stream", n))
    assert base._live() == before and base.table("chunks").count() == counts
    base.ingest(words(spark, 1, "other"), batch=("another", 0))
    base.compact()
    base.ingest(words(spark, 1, "again"), batch=("stream", 2))
    assert base.table("documents").count() == 9


def test_plans_stay_small_however_many_commits(spark, tmp_path):
    base = ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    base.tables.fan = 3
    sizes = []
    for n in range(10):
        base.ingest(words(spark, 1, f"w{n % 8}"))
        sizes.append(base.table("vectors")._jdf.queryExecution().analyzed().toString().count("Relation"))
    live = base.tables.live()
    assert len(live) <= 4 and max(sizes) <= 2 and [c.level for c in live] == sorted((c.level for c in live), reverse=True)
    assert base.table("documents").count() == 8 and len(base.tables.log()) > 10
    assert base.vacuum(0) > 0 and base.table("documents").count() == 8 and base.tables.log() == base.tables.live()
    base.ingest(words(spark, 1, "w9"))
    assert base.table("documents").count() == 9


def test_the_last_document_of_a_source_is_taken(spark, tmp_path):
    base = ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    rows = [("s", "t", "bbb", "text", 1), ("s", "t", "aaa", "text", 2), ("s", "t", "ccc", "text", 0), ("u", "t", "ddd", "text", 0), ("i", "t", "eee", "image", 0)]
    docs = spark.createDataFrame(rows, "source string, title string, content string, content_type string, seq int")
    skipped = base.ingest(docs, order="seq").collect()
    assert sorted(r["content"] for r in base.table("chunks").collect()) == ["aaa", "ddd"]
    assert sorted((r["source"], r["reason"].split()[0]) for r in skipped) == [("i", "not"), ("s", "a"), ("s", "a")]
    assert len(base.table("documents").first()["document_id"]) == 32
