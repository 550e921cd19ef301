"""Archives in stores that Arrow doesn't know, and payloads that compress well."""

import gzip

from pyarrow import fs

from tesserae.llm import warc


def test_a_store_that_only_spark_knows(spark, tmp_path):
    (tmp_path / "there").mkdir()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.elsewhere.link./top", f"file://{tmp_path}/there")
    there = str(tmp_path / "there")
    open_with = lambda uri: (fs.LocalFileSystem(), uri.replace("viewfs://elsewhere/top", there))
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 20}</p>" * 40) for k in range(60)], "page_id long, url string, html string")
    index = warc.write(warc.decide(pages), "viewfs://elsewhere/top/w", open_with=open_with)
    got = {r.page_id: (r.record_type, r.refers_to, bytes(r.html) if r.html is not None else None) for r in warc.read(index, "viewfs://elsewhere/top/w", open_with).collect()}
    want = {k: ("response", None, f"<p>{k}</p>".encode() * 40) if k < 20 else ("revisit", k % 20, None) for k in range(60)}
    assert got == want


def test_names_that_are_no_uris(spark, tmp_path):
    folder = f"file://{tmp_path}/a b%20c"
    pages = spark.createDataFrame([(1, "http://h/1", "x" * 200)], "page_id long, url string, html string")
    assert [bytes(r.html) for r in warc.read(warc.write(warc.decide(pages), folder), folder).collect()] == [b"x" * 200]


def test_what_is_unpacked_is_bounded(spark, tmp_path):
    """200 pages of 1 MB of one letter are some 1 kB each in the archive, so one read covers them all."""
    folder = f"file://{tmp_path}/w"
    pages = spark.range(200).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat(repeat('a', 1000000), id) AS html")
    index = warc.write(warc.decide(pages.coalesce(1)), folder)
    rows = sorted((r.file, r.offset, r.length) for r in index.collect())
    name = rows[0][0]
    data = (tmp_path / "w" / name).read_bytes()
    spans = [(o, n) for f, o, n in rows if f == name]
    reads = list(warc.ranges(spans))
    assert len(reads) == 1 and len(spans) == 200
    held = [sum(len(x) for x in b.column("html").to_pylist()) for b in warc.unpacked(data, 0, spans)]
    assert sum(held) == sum(1_000_000 + len(str(k)) for k in range(200)) and max(held) < warc.UNPACKED + 1_000_100
    assert warc.read(index, folder).selectExpr("count(*)", "sum(length(html))", "count(DISTINCT page_id)").first()[:] == (200, sum(held), 200)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 201
