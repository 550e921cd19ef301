"""Each operator against brute force on a small table with awkward rows."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import bpe, common, components, embed_dedup, langid, mixing, quality, sharding, simhash, substring, token_count, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, fp long, kept boolean, runs string, target double, d long, k long, row int, scale double, m0 double, f1 double, id string, n int"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdeghilmnorstu", k=rng.randint(2, 8))) for _ in range(n))


def awkward():
    rng = random.Random(3)
    base = sentence(rng, 120)
    shared = sentence(rng, 40)
    texts = [
        None, "", " \t\n\x0b ", "one", "two words", "A.\nB.\nA.\nA.", base, base, base.replace(" ", "\n"), base + " tail", "head " + base, shared, sentence(rng, 60) + " " + shared, shared + " " + shared,
        sentence(rng, 30_000), "x" * 50_000, "# * $ % & | < > " * 30, "é ü ñ 😀 ½   " * 20, "'s it's we'll   \n\n 　x", "same " * 400, base.upper(), "<|endoftext|> <s> \x00 ▁",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "c"][i % 4]) for i, t in enumerate(texts)]
    rows += [(None, "null id " + base, "en", "a"), (9, texts[9], "en", "a"), (9, texts[9], "en", "a")]
    rows += [(100 + i, sentence(rng, rng.randint(1, 90)), "en", "a") for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, True, "x", 0.5, 4, 5, 6, 7.0, 8.0, 9.0, "y", 3) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def unique(rows):
    return list({(r[0], r[1]): r for r in rows}.values())


# 1


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 5][1]) * (i + 1) + rng.normal(size=24) * 0.05).tolist()) for i in range(30)]
    rows += [(200 + i, rows[7][1]) for i in range(20)]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [math.nan] * 24), (304, [1.0] * 23 + [math.inf]), (305, [None] + [1.0] * 23), (306, [1.0] * 3), (307, [1e300] * 24), (308, [1e-300] * 24)]
    rows += [(400, [2.0, 0.0, 0.0]), (401, [1.0, 0.01, 0.0]), (402, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("c", F.lit(1)).withColumn("v", F.lit(2))
    want = brute.embedding_groups(rows)
    assert want[401][0] == 1
    for tile in (8, 4096):
        got = {r[0]: tuple(r)[1:] for r in embed_dedup.near_dedup(df, tile=tile).collect()}
        assert len(got) == len(rows) and got == want
    assert embed_dedup.near_dedup(df.limit(0)).collect() == []


def test_a_tile_of_very_many_like_vectors_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "MOST_LEVELS", 2)
    rng = np.random.default_rng(4)
    base = rng.normal(size=12)
    rows = [(i, (base + rng.normal(size=12) * 0.12).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=12).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.embedding_groups(rows)
    assert {r[0]: tuple(r)[1:] for r in embed_dedup.near_dedup(df, tile=20).collect()} == want


def test_halved_is_an_order():
    r = np.random.default_rng(1).normal(size=(1001, 3))
    assert sorted(embed_dedup.halved(r, 50)) == list(range(1001))


def test_suffix_bound_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40)) * np.geomspace(1, 0.05, 40)
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, 40)) * 0.03])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for t in (0.5, 0.95):
        got = {(int(i), int(j)) for a, b in embed_dedup.compare(x, x, x @ q, x @ q, t, True) for i, j in zip(a, b, strict=True)}
        s = x @ x.T
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= t}
        assert got == want
        order = embed_dedup.halved(x @ q, 64)
        got = {tuple(sorted((int(order[i]), int(order[j])))) for a, b in embed_dedup.compare(x[order], x[order], (x @ q)[order], (x @ q)[order], t, True, [3, 11]) for i, j in zip(a, b, strict=True)}
        assert got == want


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(200)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(90)] + [(500, k) for k in range(501, 700)] + [(7, 7)]
    want = brute.roots({x for p in pairs if p[0] != p[1] for x in p}, [p for p in pairs if p[0] != p[1]])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_hub_is_one_component_and_rounds_leave_one_table(spark):
    before = set(common._made)
    star = spark.range(1, 30_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = components.components(star.unionByName(spark.createDataFrame([(40_000, 40_001)], "a long, b long")))
    assert {r["root"]: r["n"] for r in got.groupBy("root").agg(F.count("*").alias("n")).collect()} == {0: 30_001, 40_000: 2}
    assert len(set(common._made) - before) == 1


# 2


def digests(want):
    return sorted(((i is not None, i, n, len(gone), brute.sha(" ".join(kept))) for (i, _), (n, gone, kept) in want), key=str)


def found(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()), key=str)


def test_substring(docs, rows, empty):
    got = substring.remove_repeats(docs).collect()
    want = brute.repeats([(r[0], r[1]) for r in rows])
    assert sorted(((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == digests([((r[0], 0), want[r[0], r[1] or ""]) for r in rows])
    assert all(r["h"] == 2 and r["runs"] == "x" for r in got)
    assert substring.remove_repeats(empty).collect() == []


def test_substring_within_and_across(spark):
    rng = random.Random(8)
    pool = [sentence(rng, 15) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(80)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == digests(brute.repeats(rows).items())


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_substring_of_null_and_shared_ids(spark, threshold):
    rng = random.Random(1)
    u, v, w = (sentence(rng, 80) for _ in range(3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)  # tables of ids sent to every task, or joined by a shuffle
    try:
        for rows in (
            [(1, u), (2, u), (3, "a b " + u)],
            [(None, v + " " + v), (None, u)],
            [(1, v), (5, u), (5, v)],
            [(None, u), (None, u), (-(1 << 63), u), (5, "x " + u), (5, w), (5, w), (5, None), (6, ""), (5, "")] + [(7, sentence(rng, 30) + " " + w) for _ in range(20)],
        ):
            want = brute.repeats(rows)
            assert found(spark.createDataFrame(rows, "doc_id long, text string")) == digests([((i, 0), want[i, t or ""]) for i, t in rows])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_substring_tells_words_of_equal_hash(spark):
    morse = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    rest = sentence(random.Random(2), 19)
    df = spark.createDataFrame([(1, morse + " " + rest), (2, other + " " + rest), (3, morse + "\n" + rest)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 20}


def test_numbered_rows_in_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("x"))
    got = common.numbered(df, "test-places", [F.col("x").asc_nulls_first()], ["g"], rows_each=300).collect()
    for g in range(7):
        mine = sorted(((r["place"], r["x"]) for r in got if r["g"] == g))
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted((x for _, x in mine), key=lambda x: (x is not None, x))
    assert sorted(r["place"] for r in common.numbered(df, "test-places", [F.col("x")], rows_each=700).collect()) == list(range(5000))
    assert common.numbered(df.limit(0), "test-places", [F.col("x")]).collect() == []


# 3


def test_language(spark):
    rng = random.Random(4)
    kinds = {"en": ["the", "thing", "with", "wherever"], "de": ["der", "über", "schön", "nicht"], "fr": ["être", "les", "où", "avec"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=rng.randint(1, 60))), k) for i in range(900) for k in [rng.choice(list(kinds))]]
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "123 !? 456", "de"), (None, "der über", "de"), (2003, "les où", None), (5, rows[5][1], rows[5][2])]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in by if i is not None) and not by[None]["held_out"]
    assert [by[i]["lang_pred"] for i in (2000, 2001, 2002)] == ["und"] * 3 and by[2003]["lang_pred"] == "fr" and by[None]["lang_pred"] == "de"
    held = [(r["lang_pred"], rows[r["doc_id"]][2]) for r in got if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0)).collect() == []


def test_language_sample_keeps_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 240)
    lang = F.when(F.col("id") < 100_000, F.concat(F.lit("l"), F.col("id") % 5)).otherwise("rare")
    docs = spark.range(100_150).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), lang.alias("lang"))
    _, labels = langid.sample(docs)
    assert {x: labels.count(x) for x in set(labels)} == {x: 40 for x in ("l0", "l1", "l2", "l3", "l4", "rare")}
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 1200)
    _, labels = langid.sample(docs)
    assert len(set(labels)) == 6 and min(map(labels.count, set(labels))) >= 16


def test_language_sample_survives_long_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 10_000)
    rows = [(i, ("ö" * 30_000 if i % 50 == 3 else f"text {i}"), ["en", "de"][i % 2]) for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, "ü" * 90_000, "long"), (501, "ü" * 90_000, "long"), (504, "ü" * 90_000, "long")], "doc_id long, text string, lang string")
    texts, labels = langid.sample(docs)
    assert len(texts) == docs.where(~langid.held_out()).count() and set(labels) == {"en", "de", "long"}
    assert sum(map(len, texts)) <= 10_000 and min(map(len, texts)) > 0
    whole = {t.encode() for _, t, _ in rows if len(t) < 100}
    assert all(t in whole or len(t) > 100 for t in texts)


def test_language_sample_survives_one_very_long_text(spark):
    rng = random.Random(4)
    kinds = {"en": "the thing with wherever", "de": "der über schön nicht"}
    rows = [(i, " ".join(rng.choices(kinds[k].split(), k=20)), k) for i in range(400) for k in [rng.choice(list(kinds))]]
    first = min((i for i in range(400) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(f"langid-1/{i}".encode()).hexdigest())
    rows[first] = (first, rows[first][1] + " x" * 9_000_000, rows[first][2])
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["doc_id"] != first]) > 0.98


def test_language_knows_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 50)
    rng = random.Random(7)
    words = {f"l{k:03}": [sentence(rng, 1) + chr(0x100 + k) * 3 for _ in range(4)] for k in range(230)}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(x for x in words for _ in range(8))]
    texts, labels = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(labels) == set(words)
    model = langid.train(texts, labels)
    assert model.weight is not None and len(model.languages) == 230 and model.table.nbytes <= 2 << 20


def test_language_logits_are_plain_averages():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", "Über  den\tWolken".encode(), b"THE end the END"]
    for languages in (3, 40):
        names = [f"l{k}" for k in range(languages)]
        model = langid.train([b"some text of no use"] * languages, names)
        model.table = rng.normal(size=model.table.shape).astype(np.float32)
        got = model.logits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        for k, t in enumerate(texts):
            t = bytes(x + 32 if 65 <= x <= 90 else 32 if 9 <= x <= 13 else x for x in t)
            rows = []
            for n in (2, 3, 4):
                for i in range(len(t) - n + 1):
                    x = int.from_bytes(bytes([n]) + t[i : i + n], "big")
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        x = (x ^ x >> shift) * factor % (1 << 64)
                    rows.append(model.table[(x ^ x >> 31) % langid.BUCKETS].astype(float))
            mean = np.mean(rows, 0) if rows else np.zeros(model.table.shape[1])
            assert np.allclose(got[k], (mean if model.weight is None else mean @ model.weight) + model.bias)


def test_language_model_is_a_function_of_its_sample():
    texts, labels = [b"the thing", b"der die das", b"the other", b"das sind"] * 20, ["en", "de", "en", "de"] * 20
    a, b = langid.train(texts, labels), langid.train(texts, labels)
    assert np.array_equal(a.table, b.table) and a.threshold == b.threshold


# 4


def test_simhash(docs, rows, empty):
    some = [r for r in unique(rows) if r[0] is not None]
    fp, top = brute.fingerprint_groups([(r[0], r[1]) for r in some])
    fps = simhash.fingerprints(docs)
    got = simhash.groups(fps).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == fp[r["doc_id"]] and r["component_id"] == top[r["doc_id"]]
    assert simhash.groups(simhash.fingerprints(empty)).collect() == []
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(top.values()))


def test_near_dedup_tells_documents_by_key_and_text(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (sentence(rng, 80) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, d), (None, d), (4, f), (None, None), (5, "")]
    got = [tuple(r) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (2, d), (2, e), (4, f), (5, "")], key=str)


def test_multi_index_finds_all_pairs(spark):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    values = set(seeds)
    for s in seeds:
        for _ in range(12):
            values.add(s ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(1, 4)))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b) for a in signed for b in signed if a < b and far(a, b) <= 2}


def test_majorities_of_many():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 255, 256, 1000, 2])
    h = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    got, at = simhash.majorities(h, counts), 0
    for g, n in zip(got.tolist(), counts.tolist(), strict=True):
        part = h[at : at + n].tolist()
        assert g == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n)
        at += n


# 5


def archived(path):
    """The header fields of a file's records, read as any reader would: member by member, from the start."""
    out, data = [], path.read_bytes()
    while data:
        member = zlib.decompressobj(31)
        head, _, block = member.decompress(data).partition(b"\r\n\r\n")
        data = member.unused_data
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1" and block.endswith(b"\r\n\r\n")
        out.append(dict(x.split(": ", 1) for x in lines) | {"block": len(block) - 4})
    return out


def test_warc(spark, tmp_path):
    page = "<html>" + "é" * 80 + "\r\n\r\nWARC/1.1</html>"
    rows = [(5, "http://a/5", page), (3, "http://a/3", page), (9, None, page), (1, "http://a/1", "short"), (2, "http://a/2\r\nX: y", "short"), (7, "u", None), (8, "u", ""), (None, "n", page), (3, "http://a/3", page), (11, "big", "z" * 300_000), (12, "urn:x-none", "a"), (13, "", "b"), (14, "http://é/\n", "c"), (3, "http://a/3", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0)).withColumn("payload_digest", F.lit("clash"))
    index = warc.write(warc.decide(pages), f"file://{tmp_path}/w", file_bytes=2000)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    got = warc.read(index, f"file://{tmp_path}/w").collect()
    want = sorted((i if i is not None else -1, len((h or "").encode()), brute.sha(h or ""), "revisit" if h == page and i != 3 else "response", 3 if h == page and i != 3 else None) for i, _, h in rows)
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(brute.sha(bytes(r["html"])) == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert sorted(str(r["url"]) for r in got) == sorted(str(u) for _, u, _ in rows) and {r["page_id"] for r in got if r["url"] is None} == {9}
    records = [x for name in {r["file"] for r in index.collect()} for x in archived(tmp_path / "w" / name)]
    assert sum(x["WARC-Type"] == "warcinfo" for x in records) == len({r["file"] for r in index.collect()}) and all(x["block"] == int(x["Content-Length"]) for x in records)
    ids = {x["WARC-Record-ID"]: x for x in records}
    assert len(ids) == len(records) - 1  # the one row that is repeated
    for x in records:
        if x["WARC-Type"] == "revisit":
            response = ids[x["WARC-Refers-To"]]
            assert response["WARC-Type"] == "response" and response["WARC-Payload-Digest"] == x["WARC-Payload-Digest"] and response["WARC-Target-URI"] == x["WARC-Refers-To-Target-URI"]
    some = warc.read(index.where("page_id IN (1, 11)"), f"file://{tmp_path}/w").collect()
    assert sorted(r["page_id"] for r in some) == [1, 11]
    assert warc.read(warc.write(warc.decide(pages.limit(0)), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").collect() == []


def test_ranges_coalesce():
    spans = [(0, 10), (10, 5), (40, 10), (500, 10), (505, 100)]
    reads = list(warc.ranges(spans, gap=30, most=100))
    assert [x[:2] for x in reads] == [(0, 50), (500, 10), (505, 100)] and [s for x in reads for s in x[2]] == spans


# 6


def test_byte_bpe(docs, rows, empty):
    import public_tokenizers
    import tiktoken

    path = bpe.default_path()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, path, with_ids=True).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = whole.encode_ordinary(text[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert r["decoded"] == text[r["doc_id"]] and r["decoded_sha256"] == brute.sha(text[r["doc_id"]])
    assert bpe.encode(empty, path).collect() == []


def test_pre_tokens_are_the_pattern_s():
    import public_tokenizers
    import regex

    rng = random.Random(2)
    letters = list(" \n\t'strevmld19!?é中　\xa0½_-😀\x1c\x85")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    slices, at = bpe.pre_tokens(texts)
    for k, t in enumerate(texts):
        assert slices[at[k] : at[k + 1]] == regex.findall(public_tokenizers.PATTERN, t.replace("\x1c", "!")) or "\x1c" in t


def test_long_and_short_merges_agree():
    c = bpe.codec(bpe.default_path())
    rng = random.Random(3)
    for _ in range(200):
        piece = "".join(rng.choices("abethinsor", k=rng.randint(2, 90))).encode()
        if piece not in c.ranks:
            assert c._merge_short(piece) == c._merge_long(piece)


# 7


def test_quality_base(docs, rows, empty):
    got = quality.judge(docs).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = brute.quality(text[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and (not failed or r["kept"] is False)
        assert r["h"] == 2
    assert quality.judge(empty).collect() == []


def reference_fit(x, digests):
    """The estimate of one group by the same rules, in numpy."""
    floors = np.diag(np.square(quality.FLOORS))

    def median(cells):
        cells = np.sort(cells)
        return cells[math.ceil(len(cells) * 0.5) - 1]

    def d2(m, cov):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)

    def moments(part):
        return part.mean(0), np.cov(part.T, bias=True) + floors

    cells = np.floor(x * quality.CELLS + 0.5)
    m = np.array([median(c) for c in cells.T])
    s = np.array([median(abs(c - k)) for c, k in zip(cells.T, m, strict=True)]) * 1.4826 / quality.CELLS
    starts = [(m / quality.CELLS, np.diag(s * s) + floors), moments(x)]
    for k in range(quality.DRAWN):
        places = range(3 * k * quality.EACH, 3 * (k + 1) * quality.EACH, 3)
        starts.append(moments(x[[min(range(len(x)), key=lambda i: (digests[i] * 2)[p : p + 32]) for p in places]]))
    ends = []
    for m, cov in starts:
        det = math.inf
        for _ in range(quality.STEPS):
            cell = np.floor(np.log1p(d2(m, cov)) * quality.DISTANCE_CELLS)
            new = moments(x[cell <= np.sort(cell)[math.ceil(len(cell) * quality.CORE) - 1]])
            if not np.linalg.slogdet(new[1])[1] < det - quality.FALL:
                break
            (m, cov), det = new, np.linalg.slogdet(new[1])[1]
        ends.append((det, m, cov))
    det, m, cov = min(ends, key=lambda e: round(e[0], 9))
    return m, cov, [e[0] for e in ends]


def test_quality_estimates(spark):
    rng = random.Random(9)
    clean = [sentence(rng, rng.randint(60, 300)) for _ in range(150)]
    junk = ["### ".join(sentence(rng, 80).split()) for _ in range(20)] + [" ".join(x * 5 for x in sentence(rng, 90).split()) for _ in range(10)]
    rows = [(i, t, None, "s") for i, t in enumerate(clean + junk)] + [(500 + i, t, "en", None) for i, t in enumerate(clean[:5] + junk[:1])]
    rows += [(600 + i, t, None, "few") for i, t in enumerate(clean[5:8] + junk[3:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.features(quality.statistics(df))
    fits = {(r["lang"], r["source"]): r for r in quality.fit(stats).collect()}
    assert set(fits) == {(None, "s"), ("en", None), (None, "few")}
    good = stats.where("NOT base_failed").orderBy("doc_id").collect()
    # a group of its own, one judged by its language's estimate, and one by that of the whole table
    for key, part in (((None, "s"), lambda r: r["source"] == "s"), ((None, "few"), lambda r: r["lang"] is None), (("en", None), lambda r: True)):
        mine = [r for r in good if part(r)]
        m, cov, ends = reference_fit(np.array([tuple(r[f] for f in quality.FEATURES) for r in mine]), [r["_digest"] for r in mine])
        fit = fits[key]
        assert np.allclose([fit[f"m{i}"] for i in range(4)], m)
        low = np.array([[fit[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        assert np.allclose(low @ low.T, cov)
        assert np.isclose(np.linalg.slogdet(low @ low.T)[1], min(ends))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[i]["kept"] for i in range(150)) and not any(got[i]["kept"] for i in range(150, 180)) and all(got[500 + i]["kept"] for i in range(5))
    assert not got[505]["kept"] and [got[600 + i]["kept"] for i in range(5)] == [True] * 3 + [False] * 2


def test_quality_estimates_too_many_to_send(spark, docs, monkeypatch):
    stats = common.cut(quality.features(quality.statistics(docs)), "quality-test")
    sent = {(r["lang"], r["source"]): r for r in quality.fit(stats).collect()}
    monkeypatch.setattr(quality, "MOST_SENT", -1)
    dealt = {(r["lang"], r["source"]): r for r in quality.fit(stats).collect()}
    assert sent.keys() == dealt.keys() and sent
    for k, r in sent.items():
        names = [c for c in r.asDict() if c not in quality.GROUP]
        assert np.allclose([r[c] for c in names], [dealt[k][c] for c in names], rtol=1e-9, atol=1e-12)


def test_quality_of_one_document_and_of_a_long_one(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, sentence(rng, 500_000), "en", "a")], "doc_id long, text string, lang string, source string")
    assert df.select(F.length("text")).first()[0] > 2_500_000
    r = quality.judge(df).first()
    assert r["kept"] and (r["n_words"], r["word_chars"]) == brute.quality(df.first()["text"])[:2]


# 8


def water(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        words = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        share = {s: words * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] for s in capped} | share
        capped |= over


def test_mixing(docs, rows, empty):
    got = mixing.decide(docs).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(brute.words(r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    want = water(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == len(brute.words({(x[0], x[3]): x[1] for x in rows}[r["doc_id"], r["source"]]))
    for s in size:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
        full = math.floor(want[s] / size[s])
        assert {r["taken"] // r["size"] for r in mine if r["size"]} <= {full, full + 1}
        inside = [r["draw"] for r in mine if r["size"] and r["taken"] // r["size"] == full + 1]
        assert all(r["draw"] >= max(inside, default=0) for r in mine if r["size"] and r["taken"] // r["size"] == full)
    assert sorted(map(str, mixing.decide(docs).collect())) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = lambda rows: {k: sum(n for x, n in rows if x == k) for k in {x for x, n in rows if n}}
    assert taken([((r["doc_id"], r["source"]), len(brute.words(r["text"]))) for r in mixed.collect()]) == taken([((r["doc_id"], r["source"]), r["taken"]) for r in got])
    assert mixing.decide(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_mix_gives_what_was_decided_of_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(7, "one two three", "a")] * 30 + [(7, "four five", "a")] * 5 + [(None, sentence(rng, rng.randint(1, 30)), "a") for _ in range(20)]
    rows += [(i, sentence(rng, rng.randint(1, 60)), "b") for i in range(60)] + [(i, "%" * rng.randint(1, 40) + " x", None) for i in range(60)] + [(500, "y " * 200_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = {}, {}
    for r in mixing.decide(df, beside=("text",)).collect():
        want[r["doc_id"], r["text"]] = want.get((r["doc_id"], r["text"]), 0) + r["copies"]
    for r in mixing.mix(df).collect():
        got[r["doc_id"], r["text"]] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_reruns_agree_on_rows_without_id_and_shared_ids(spark):
    rng = random.Random(11)
    rows = [(None, sentence(rng, rng.randint(1, 40)), "a") for _ in range(500)] + [(7, sentence(rng, rng.randint(1, 40)), "b") for _ in range(500)]
    rows += [(1000 + i, sentence(rng, rng.randint(1, 9)), "c") for i in range(20)]
    one = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), beside=("text",)).collect()
    rng.shuffle(rows)
    two = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), beside=("text",)).collect()
    taken = lambda of: sorted((str(r["doc_id"]), r["text"], r["taken"]) for r in of)
    assert taken(one) == taken(two) and len({r["draw"] for r in one}) == len(rows)


def test_key_ranges_stay_small_whatever_the_weights(spark):
    ids = spark.range(200_000)
    texts = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "##### x").when(F.col("id") % 8 > 0, "").otherwise("plain words").alias("text"))
    draw = -F.log(common.unit_draw(F.lit("mix-1"), F.col("doc_id").cast("string"))) / mixing.quality_weight(F.col("text"))
    cells = texts.groupBy(F.floor(F.log2(draw) * mixing.RANGES).alias("c")).count()
    assert cells.agg(F.max("count")).first()[0] < 200_000 / 5000 * 3


def test_targets_reshare(spark):
    sizes = {"a": 1, "b": 2, "c": 1000, None: 5, "d": 0}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


# 9


def test_sharding(spark, docs, rows, empty):
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key") and r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    many = sharding.assign(spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    counts = [r["n"] for r in many.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 8 and max(counts) < 1.15 * min(counts)
    assert 8000 / 9 * 0.85 < many.where("grown_shard = 8").count() < 8000 / 9 * 1.15
    assert sharding.assign(empty).collect() == []


def independent_descent(key, n, weights=None):
    """A descent in plain Python, from the least draws of subtrees."""

    def draw(s):
        u = (int(hashlib.md5(f"tree-2/s{s}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -math.log(u) / (weights or {}).get(s, 1)

    shards = list(range(n))
    for width in (4, 2, 1):
        parts = [shards[i : i + width] for i in range(0, len(shards), width)]
        shards = min(parts, key=lambda p: min(map(draw, p)))
    return shards[0]


def test_shards_are_those_of_a_plain_descent(docs):
    for r in sharding.assign(docs).collect():
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (independent_descent(key, 8), independent_descent(key, 9))
    heavy = {3: 5.0, 6: 0.5}
    got = docs.select("doc_id", sharding.descend(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sharding.tree(11), heavy).alias("s")).collect()
    assert all(r["s"] == independent_descent("null" if r["doc_id"] is None else r["doc_id"], 11, heavy) for r in got)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    key = F.col("id").cast("string")
    trees = [sharding.tree(n) for n in range(1, 21)]
    rows = [r["r"] for r in spark.range(4000).select(sharding.routes(key, trees).alias("r")).collect()]
    for n in range(1, 20):
        moved = [r[n] for r in rows if r[n] != r[n - 1]]
        assert set(moved) == {n} and abs(len(moved) - 4000 / (n + 1)) < 5 * math.sqrt(4000 / (n + 1))


def test_plan_of_many_shards_stays_small(spark):
    size = lambda n: len(sharding.descend(F.lit("x"), sharding.tree(n))._jc.toString())
    assert size(64) < 2.5 * size(32) < 6 * size(16)
    assert spark.range(200).select(sharding.descend(F.col("id").cast("string"), sharding.tree(64)).alias("s")).distinct().count() > 40


def test_weights_move_only_their_subtrees(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    a, b = sharding.tree(8), sharding.tree(8)
    b["g1"]["r2"] = [*b["g1"]["r2"], 8]
    moved = ids.select(sharding.descend(F.col("k"), a).alias("a"), sharding.descend(F.col("k"), b).alias("b")).where("a <> b").collect()
    assert moved and all(r["b"] == 8 for r in moved)
    both = ids.select(sharding.descend(F.col("k"), a).alias("a"), sharding.descend(F.col("k"), a, {5: 3.0}).alias("b"), sharding.descend(F.col("k"), a, {5: 0.3}).alias("c"))
    assert {r["b"] for r in both.where("a <> b").collect()} == {5} == {r["a"] for r in both.where("a <> c").collect()}


# 10


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = token_count.default_path()
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(docs, path).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        n = len(whole.encode(text[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 4096)
    assert token_count.count_tokens(empty, path).collect() == []


def test_ragged_and_long_merges_agree():
    c = token_count.counter(token_count.default_path())
    rng = random.Random(3)
    some = ["▁" + "".join(rng.choices("abethinsor▁", k=rng.randint(1, 60))) for _ in range(300)]
    assert c._count_ragged(some).tolist() == [c._count_long(x) for x in some]
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=token_count.default_path())
    texts = ["".join(rng.choices("abethinsor", k=rng.randint(200, 900))) for _ in range(40)] + [" " * 333 + "x", "the" * 500]
    assert c.counts(texts).tolist() == [len(x) for x in whole.encode(texts)]


def test_types_are_the_contract_s(docs):
    kinds = lambda df: {f.name: f.dataType for f in df.schema}
    assert kinds(sharding.assign(docs))["slot"] == T.LongType() and kinds(sharding.assign(docs))["shard"] == T.IntegerType()
    assert all(kinds(quality.statistics(docs))[c] == T.LongType() for c in quality.BASE)
    assert kinds(mixing.decide(docs))["taken"] == T.LongType() and kinds(mixing.decide(docs))["size"] == T.LongType()
