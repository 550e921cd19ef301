"""Approximate neighbours, vector codes and fill-in-middle against plain restatements."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import codes, common, curves, fim

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, part string, code string, n string"


def odd_vectors(dim):
    """Vectors that take no part, or that are at the edge of what doubles hold."""
    return [None, [], [0.0] * dim, [math.nan] * dim, [1.0] * (dim - 1) + [math.inf], [None] + [1.0] * (dim - 1), [1.0] * 3, [1e300] * dim, [-1e-300] * dim]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", "z", "w") for i, v, label in rows], SCHEMA)


# 11


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 1), (2, 5), (3, 3), (4, 2), (5, 2), (8, 1)])
def test_hilbert_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = curves.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def neighbours(rows, k=10):
    """{query: [(id, distance)]} by all distances, of ids divisible by 100."""
    sets: dict = {}
    for i, v, _ in rows:
        if i is not None and usable(v):
            sets.setdefault((i, len(v)), []).append(np.asarray(v, float))
    out = {}
    for (q, dim), mine in sets.items():
        if q % 100 == 0:
            near = {}
            for (i, d), of in sets.items():
                if i != q and d == dim:
                    near[i] = min(float(curves.measured(a[None], b[None])[0]) for a in mine for b in of)
            out.setdefault(q, []).extend(near.items())
    return {q: sorted(near, key=lambda r: (r[1], r[0]))[:k] for q, near in out.items()}


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 16)) * 3
    rows = [(i, (middles[i % 12] + rng.normal(size=16)).tolist(), 0) for i in range(1500)]
    rows += [(2000 + i, rows[100][1], 0) for i in range(60)]  # copies of a query: the ten smallest ids are its neighbours
    rows += [(100, rows[100][1], 0), (None, rows[3][1], 0), (7, rows[8][1], 0), (7, rows[900][1], 0), (3000, [0.5, 1.0, 2.0], 0), (3001, [0.25, 1.0, 2.0], 0)]
    rows += [(4000 + 100 * k, v, 0) for k, v in enumerate(odd_vectors(16))]
    want = neighbours(rows)
    got = found(curves.search(frame(spark, rows), F.col("id") % 100 == 0))
    assert set(got) == {q for q in want if want[q]}
    hits = 0
    for q, near in got.items():
        assert [r[0] for r in near] == list(range(1, len(want[q]) + 1)) and q not in {r[1] for r in near}
        assert [r[1:] for r in near] == sorted((r[1:] for r in near), key=lambda r: (r[1], r[0]))
        hits += len({r[1] for r in near} & {i for i, _ in want[q]})
    assert hits >= 0.9 * sum(len(w) for w in want.values())
    assert [r[1] for r in got[100]] == [2000 + i for i in range(10)] and {r[2] for r in got[100]} == {0.0}
    assert [r[1] for r in got[3000]] == [3001, 4600] and got[3000][0][2] == 0.25


def test_few_vectors_find_all_others(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, rng.normal(size=2).tolist(), 0) for i in range(9)]
    got = found(curves.search(frame(spark, rows), F.col("id") % 100 == 0))
    assert {q: [(i, s) for _, i, s in near] for q, near in got.items()} == {q: [(i, pytest.approx(d)) for i, d in near] for q, near in neighbours(rows).items()}
    assert found(curves.search(frame(spark, rows[:1]), F.col("id") % 100 == 0)) == {}
    assert curves.search(frame(spark, rows).limit(0), F.col("id") % 100 == 0).collect() == []


def test_many_partitions_and_points_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(curves, "PART_LEAST", 50)
    monkeypatch.setattr(curves, "PART_MOST", 60)
    monkeypatch.setattr(curves, "SAMPLE", 400)
    rng = np.random.default_rng(5)
    rows = [(i, (1 + rng.normal(size=8) * 1e-9).tolist(), 0) for i in range(600)] + [(1000 + i, (rng.normal(size=8) * 5).tolist(), 0) for i in range(900)]
    want, got = neighbours(rows), found(curves.search(frame(spark, rows), F.col("id") % 100 == 0))
    assert sum(len({r[1] for r in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == 10 for q in want)


def test_recall_on_the_whole_table(spark):
    got = found(curves.op11(spark, "/root/testdata/sf0.01").withColumnRenamed("vec_id", "id"))
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = neighbours(rows)
    assert sum(len({r[1] for r in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


# 12


def floors(v):
    return [math.floor(1024 * x) for x in v]


def coded(rows, entries=256, rounds=4):
    """{row's place: (code, error)} and the codebooks, by plain loops over Python's own integers."""
    kept = sorted(((i, v) for i, v, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[[int(x) for x in floors(v)][p * len(v) // 4 : (p + 1) * len(v) // 4] for p in range(4)] for _, v in kept]
    books = [[x[p] for x in parts[:entries]] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(4)] for x in parts]

    for _ in range(rounds):
        best = assign()
        for p in range(4):
            for k in range(len(books[p])):
                mine = [x[p] for x, b in zip(parts, best, strict=True) if b[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    best = assign()
    out = sorted((str(i), str(v), "".join(f"{b[p][1]:02x}" for p in range(4)), sum(b[p][0] for p in range(4))) for (i, v), b in zip(kept, best, strict=True))
    return out, hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()


def test_codes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=10) * (1 + i % 3)).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(5, rows[5][1], 2), (5, rows[9][1], 2), (None, rows[17][1], 1), (None, [-0.5] * 10, None)]  # 10 components: parts of 2, 3, 2 and 3
    rows += [(9000 + i, [1.0, -1.0, i / 3.0], 3) for i in range(4)] + [(9100, [], 3), (9101, [], None)]
    odd = [(8000 + k, v, 7) for k, v in enumerate([None, [math.nan] * 10, [1.0] * 9 + [math.inf], [None] + [1.0] * 9])]
    got = codes.compress(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows)
    sums: dict = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    vectors: dict = {}
    for i, v, label in rows:
        vectors.setdefault(len(v), []).append((i, v, label))
    for dim, mine in vectors.items():
        want, sha = coded(mine)
        of = [r for r in got if r["codebooks_sha256"] == sha]
        assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in of) == sorted((i, c, e) for i, _, c, e in want), dim
    assert codes.compress(frame(spark, rows).limit(0)).collect() == []
    huge = codes.compress(frame(spark, [(i, [1e300 * (-1) ** (i * k) for k in range(8)], 1) for i in range(3)])).collect()
    assert [r["error"] for r in huge] == [0, 0, 0]


def test_bounds_change_nothing_and_spare_scans():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(200, 16))
    x = np.floor(1024 * (middles[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 16)) * 0.1)).astype(np.int64)
    x[:300] = x[300:600]  # equal entries: ties go to the lower index
    c = x[:256]
    groups = codes.grouped(c, 16)
    assert sorted(k for g in groups for k in g.tolist()) == list(range(256))
    code, best, low = codes.first_scan(x, c, groups)
    scanned = []
    for _ in range(4):
        n = np.bincount(code, minlength=256)
        new = np.array([x[code == k].sum(0) // n[k] if n[k] else c[k] for k in range(256)])
        step = np.sqrt(np.square((new - c).astype(float)).sum(1))
        c = new
        code, best, low, seen = codes.rescan(x, c, groups, code, low, np.array([step[g].max() for g in groups]))
        d = codes.distances(x, c)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        scanned.append(seen / (len(x) * len(groups)))
    assert scanned[-1] < 0.2


def test_distances_beyond_doubles():
    x = np.array([[1 << 27, -(1 << 27)], [3, 4]], np.int64)
    assert codes.distances(x, x[:, ::-1]).tolist() == [[1 << 57, (2**27 - 4) ** 2 + (2**27 + 3) ** 2], [(2**27 + 3) ** 2 + (2**27 - 4) ** 2, 2]]


# 13


def middle_filled(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    pieces = (None, None, None) if form == "plain" else (p, m, s)
    return (len(units), form, *pieces, {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form])


def test_fill_in_middle(spark):
    base = [None, "", " \n", "a\x01b \x02a \x02b\x01\x01 c\x02", "x <P> y", "<S>", "< <P x>S <M \U0001f600  z　k\xa0", "one", "word " * 30_000, "y" * 60_000, "\x00 nul \x85 next"]
    rows = [(i, base[i % len(base)]) for i in range(120)] + [(None, "q w e"), (3, "the same id"), (3, "the same id")]
    rows += [(1000 + i, f"a\x01{i} \x02 b\x02a  c\n\nd<{'S' if i % 2 else '<'} e>> <") for i in range(60)]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "doc_id long, text string, output string, form string, n int, prefix int")
    got = fim.restore(fim.transform(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) == middle_filled(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).collect() == []
    assert {r["form"] for r in fim.transform(df, rate=0).collect()} == {"plain"}


def test_scratch_of_rounds_is_deleted(spark):
    before = set(common._made)
    codes.compress(frame(spark, [(i, [float(i), 1.0, 2.0, 3.0], 1) for i in range(20)])).collect()
    assert sorted(p.split("tesserae-")[1].rsplit("-", 1)[0] for p in set(common._made) - before) == ["code-labels", "codes"]
