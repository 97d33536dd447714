import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours

SF = "/root/testdata/sf0.1"


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in (i for i in good if i % 20 == 0):
        ranked = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in ranked]
    return out


def case():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # many equal vectors, queries among them
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, rows[0][1]), (5, rows[5][1]), (2100, [1.0, 2.0])]
    return rows


def test_against_brute_force(spark):
    rows = case()
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, list string, score double")
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 6], 20)
    got: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9) and [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_ids_with_two_vectors(spark):
    """Of an id's different vectors one takes part, so ranks stay unique."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(i, rng.normal(size=4).tolist()) for i in (0, 7, 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).collect()
    assert len({(r.query_id, r.rank) for r in got}) == len({(r.query_id, r.vec_id) for r in got}) == len(got) == 3 * 20
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(r.query_id, r.rank, r.vec_id) for r in neighbours.search(table.repartition(5), F.col("vec_id") % 20 == 0).collect()}


def test_all_probes_are_exact_and_short_queries_look_further(spark, monkeypatch):
    """With every list and no test the search is exact; with one list of many, all k results still come."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12)) * 5
    rows = [(i, (centres[i % 40] + rng.normal(size=12)).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20)
    monkeypatch.setattr(neighbours, "VECTORS", 300)
    monkeypatch.setattr(neighbours, "MOST", 120)
    for how, least in (({"lists": 30, "probes": 30, "slack": float("inf")}, 1.0), ({"lists": 400, "probes": 1}, 0.0), ({}, 0.9)):
        got: dict = {}
        for r in neighbours.search(table, F.col("vec_id") % 20 == 0, **how).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}
        assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= least


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert neighbours.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert neighbours.search(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 33))
    for _ in range(20):
        q = rng.normal(size=33)
        far = ((x - q) ** 2).sum(axis=1)
        near = set(np.argsort(far)[:10].tolist())
        assert len(near & set(neighbours.scan(x, q[None], np.array([np.inf]), 10)[1].tolist())) >= 9


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, 20)
    got: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


@pytest.mark.parametrize("length", [1e5, 1e7, 1e200, 1e-200])
def test_odd_lengths(spark, length, monkeypatch):
    """One vector of another magnitude leaves recall as it is, is found where it belongs, and the scan keeps few pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    odd = rng.normal(size=16)
    with_odd = [*rows, (3001, (odd / np.linalg.norm(odd) * length).tolist()), (3020, (rng.normal(size=16) * length).tolist())]
    want = {q: {i for i, _ in own} for q, own in brute(with_odd, 20).items()}
    got: dict = {}
    for r in neighbours.search(spark.createDataFrame(with_odd, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.9
    assert all((3001 in got[q]) == (3001 in want[q]) for q in want)

    def kept(table: np.ndarray) -> int:
        index = neighbours.fit(np.array([v for _, v in rows]), float(neighbours.lengths(table).max()), len(table), 21, lists=1)
        reach = index.steps(table)[1]
        asked, total = index.ask(table[:150]), 0
        bounds = index.bounds(asked, 21)
        for one in np.unique(reach):
            closer = neighbours.to_distance(bounds, one)
            total += len(neighbours.scan(index.place(table[reach == one], reach[reach == one]), asked, closer, 21)[0])
        return total

    assert kept(np.array([v for _, v in with_odd])) <= 2 * kept(np.array([v for _, v in rows]))


def test_queries_in_chunks(spark, monkeypatch):
    """More queries than one task may hold are dealt out, with the same results; lengths over many magnitudes are exact."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20)
    how = {"lists": 6, "probes": 6, "slack": float("inf")}
    for queries in (50_000, 20):
        monkeypatch.setattr(neighbours, "QUERIES", queries)
        got: dict = {}
        for r in neighbours.search(table, F.col("vec_id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: [i for i, _ in own] for q, own in want.items()}
