import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import neighbours


def brute(rows, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            found = sorted((-float((q * v).sum()), j) for j, v in rows if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def recall(got, want):
    of = {}
    for r in got:
        of.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for i, w in want.items():
        g = sorted(of.get(i, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in g] == list(range(1, len(g) + 1))
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(g, g[1:]))
        hits += len({r.vec_id for r in g} & {j for j, _ in w})
        total += len(w)
    assert set(of) <= set(want)
    return hits / total


def test_op6_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = neighbours.op6_neighbours(spark, sf).collect()
    assert recall(got, brute(rows)) >= 0.9
    by = {i: np.array(v, float) for i, v in rows}
    for r in got[::37]:
        assert r.score == pytest.approx(float(by[r.query_id] @ by[r.vec_id]), abs=1e-12)


def test_op6_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_A_PIECE", 32)
    monkeypatch.setattr(neighbours, "QUERIES_A_PIECE", 4)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 3)).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0] * 8) for i in range(150)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [1.0] * 6), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (None, [1.0] * 8), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    want = brute([(i, None if v is None or len(v) != 8 else np.array(v, np.float32).tolist() if None not in v else v) for i, v in rows])
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).collect()
    assert recall(got, want) >= 0.9
    same = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 400)
    equal = [r for r in got if r.query_id == 400 and r.score == 8.0]
    assert len(same) == 20 and [r.vec_id for r in sorted(equal, key=lambda r: r["rank"])] == sorted(r.vec_id for r in equal)
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_op6_every_query_gets_its_rows(spark):
    rng = np.random.default_rng(3)
    tight = lambda c, n: [(c + rng.normal(size=8) * 1e-3).tolist() for _ in range(n)]
    vectors = [[1.0] * 8] * 3000 + [v for _ in range(8) for v in tight(rng.normal(size=8) * 5, 8)]
    order = rng.permutation(len(vectors))
    rows = [(int(5 * i), vectors[o]) for i, o in enumerate(order)] + [(0, [2.0] * 8), (0, [3.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids = [i for i, _ in rows]
    for some, n in ((df, 20), (df.where("vec_id < 90"), 19)):
        got = neighbours.search(some, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
        want = {i for i in ids if i % 20 == 0 and (n == 20 or i < 90)}
        assert {r.query_id for r in got} == want
        assert [r for r in got if r["count"] != n and r.query_id] == []
        assert n != 20 or [r["count"] for r in got if r.query_id == 0] == [60]  # three vectors under one id


def test_op6_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(6)
    vectors = [np.float32(rng.normal(size=8)).tolist() for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])] * 2 + [(20, vectors[20])] + [(7, vectors[7])] * 3 + [(40, [-x for x in vectors[40]])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    of = {}
    for r in got:
        of.setdefault(r.query_id, []).append(r)
    assert {i: len(g) for i, g in of.items()} == {i: 40 if i == 40 else 20 for i in range(0, 300, 20)}
    assert sorted(r["rank"] for r in of[40]) == sorted([*range(1, 21)] * 2)
    hits = 0
    for i in (0, 20, 60):
        q = np.array(vectors[i], float)
        want = sorted((-float(q @ np.array(v)), j) for j, v in rows if j != i)[:20]
        hits += sum(a == b.vec_id for (_, a), b in zip(want, sorted(of[i], key=lambda r: r["rank"])))
    assert hits >= 54
    assert neighbours.list_count(10**4) == 100 and neighbours.list_count(10**8) == 10**4
