"""The content directory on disk: names, equal contents, replays, awkward rows."""

import hashlib
import os

import pytest
from pyarrow import fs

from tesserae.operators import contents, store
from tesserae.sources import locations
from tesserae.sources.locations import open_at


def rows(spark, values):
    return spark.createDataFrame(values, "key long, name string, content binary, extra int")


def names(folder):
    return sorted(f for top, _, found in os.walk(folder) for f in found if not f.endswith(".crc"))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_equal_contents_leave_one_file(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    given = rows(spark, [(k, f"f{k}.{'md' if k else 'TXT'}", b"same", 1) for k in range(400)]).repartition(16)
    out = contents.write(given, folder).collect()
    assert [tuple(r) for r in out] == [(sha(b"same"), sha(b"same") + ".txt", 4)]
    assert names(tmp_path / "store") == [sha(b"same") + ".txt"]


def test_awkward_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/a%20b c"
    given = rows(spark, [
        (None, "x.zz", b"one", 1), (5, "x.b", b"one", 1), (5, "x.a", b"one", 1), (1, None, b"", 1), (2, "gone.md", None, 1), (3, "../../evil.m d", b"two", 1),
        (4, "none", b"three", 1), (None, "only.Q", b"four", 1),
    ])
    want = {sha(b"one") + ".a", sha(b""), sha(b"two") + ".md", sha(b"three"), sha(b"four") + ".q"}
    assert {r.file for r in contents.write(given, folder).collect()} == want
    assert set(names(tmp_path / "a%20b c")) == want
    assert contents.write(given.where("false"), f"file://{tmp_path}/none").count() == 0


def test_replays_and_later_writes(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    first = rows(spark, [(k, "f.md", str(k % 50).encode() * 30, 1) for k in range(200)])
    a, b = contents.write(first, folder), contents.write(first, folder)
    assert sorted(a.collect()) == sorted(b.collect()) and len(names(tmp_path / "store")) == 50
    # a task that is run again after its file was put into place
    run = contents._place(f"{folder}/_staged-gone", folder, 2, open_at)
    batch = a.select("content_id", "file", "size").toArrow().to_batches()
    assert sum(x.num_rows for x in run(iter(batch))) == 50
    # a file cut short is not taken for the content
    broken = tmp_path / "store" / a.first().file[:2] / a.first().file
    broken.write_bytes(b"1")
    contents.write(first, folder)
    assert store.intact(contents.read(contents.stored(spark, folder), folder), "content", "content_id").where("NOT is_valid").count() == 0
    assert store.missing_files(a, contents.stored(spark, folder)).count() == 0
    assert not [x for x in os.listdir(tmp_path / "store") if x.startswith("_")]


def test_a_task_that_fails_is_run_again(spark, tmp_path):
    """The file system breaks while a file is written: nothing with a digest's name is left that isn't whole."""
    folder = str(tmp_path / "staged")

    class Breaking:
        def __init__(self, inner):
            self.inner, self.left = inner, 3

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, *names):
            self.left -= 1
            if self.left < 0:
                raise OSError("lost")
            self.inner.move(*names)

    table = rows(spark, [(k, "f.md", str(k).encode() * 100, 1) for k in range(6)]).selectExpr("key", "name AS ext", "content").toArrow().to_batches()
    with pytest.raises(OSError, match="lost"):
        list(contents._stage(folder, 2, lambda uri: (Breaking(fs.LocalFileSystem()), uri))(iter(table)))
    list(contents._stage(folder, 2, open_at)(iter(table)))
    whole = [n for n in names(folder) if not n.startswith(".")]
    assert whole == sorted(sha(str(k).encode() * 100) for k in range(6))


def test_remove(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    contents.write(rows(spark, [(k, "f.md", str(k).encode(), 1) for k in range(5)]), folder)
    known = spark.createDataFrame([(sha(b"1"),), (sha(b"4"),)], "content_id string")
    lost = store.orphans(contents.stored(spark, folder), known)
    assert [r.removed for r in contents.remove(lost, folder).collect()] == [True] * 3
    assert names(tmp_path / "store") == sorted(sha(x) + ".md" for x in (b"1", b"4"))
    other = spark.createDataFrame([("../../x",), (None,), (sha(b"0") + ".md",)], "file string")
    assert [r.removed for r in contents.remove(other, folder).collect()] == [False] * 3


def test_locations(tmp_path, monkeypatch):
    for uri in (f"{tmp_path}/x", f"file:{tmp_path}/x/", f"file://{tmp_path}/x"):
        store_, path = open_at(uri)
        assert isinstance(store_, fs.LocalFileSystem) and path == f"{tmp_path}/x"
    assert open_at("dbfs:/a/b")[1] == "/dbfs/a/b"
    with pytest.raises(ValueError, match="give a function"):
        open_at("gopher://x/y")
    class Asked:
        LocalFileSystem = fs.LocalFileSystem

        class FileSystem:
            from_uri = staticmethod(lambda uri: uri)

    monkeypatch.setattr(locations, "fs", Asked)
    assert open_at("s3a://bucket/a/") == "s3://bucket/a" and open_at("hdfs://name:8020/a") == "hdfs://name:8020/a"


def test_contents_are_read_by_name(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    made = contents.write(rows(spark, [(k, "f.md", str(k).encode() * 1000, 1) for k in range(9)] + [(9, "e", b"", 1)]), folder)
    gone = spark.createDataFrame([("0" * 64, "0" * 64 + ".md", 5)], made.schema)
    got = {r.content_id: r.content for r in contents.read(made.unionByName(gone), folder).collect()}
    assert got.pop("0" * 64) is None and {sha(bytes(c)) for c in got.values()} == set(got) and len(got) == 10
    assert contents.read(made.where("false"), folder).count() == 0 == contents.stored(spark, f"{folder}-none").count()
    assert sorted(contents.stored(spark, folder).collect()) == sorted(made.collect())
