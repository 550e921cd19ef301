"""The pipeline's stages, each against brute force on what it got."""

import math

import corpus_pipeline
from tesserae.llm.common import cut
from tests.llm import brute
from tests.llm.test_operators import awkward

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SF), f"test{k}")
        seen.append(docs)
        assert k == 4 or docs.columns == names
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen[:4]]

    for i, r in rows[0].items():
        n, _, _, _, repeated = brute.quality(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in rows[1]
    assert set(rows[1]) <= set(rows[0]) and all(rows[0][i] == r for i, r in rows[1].items())

    _, top = brute.fingerprint_groups([(i, r["text"]) for i, r in rows[1].items()])
    assert set(rows[2]) == set(top.values())

    for (i, _), (_, gone, kept) in brute.repeats([(i, r["text"]) for i, r in rows[2].items()]).items():
        r = rows[3][i]
        assert r["text"] == (" ".join(kept) if gone else rows[2][i]["text"]) and r["n_chars"] == (len(r["text"]) if gone else rows[2][i]["n_chars"])

    mixed = seen[4].collect()
    total = sum(len(brute.words(r["text"])) for r in rows[3].values())
    assert math.isclose(sum(len(brute.words(r["text"])) for r in mixed), total, rel_tol=0.15)
    assert {r["doc_id"] for r in mixed} <= set(rows[3])

    last = seen[5].collect()
    assert len(last) == len(mixed)
    want = sorted((r["doc_id"], brute.sha(r["text"])) for r in mixed)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in last) == want


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_awkward_rows(spark):
    rows = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in awkward()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {(r[0], r[1]) for r in rows}
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).collect() == []
        docs = cut(stage(spark, docs, SF), f"awkward{k}")
        assert k == 4 or docs.columns == names
        if k < 2:
            assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= texts
    assert docs.count() > 0
