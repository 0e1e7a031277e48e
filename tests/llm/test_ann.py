import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorespark.llm import ann
from lorespark.llm.queries import op6_ann


def exact(ids, x, q, own, k):
    s = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    s[ids == own] = -9
    first = np.lexsort((ids, -s))[:k]
    return ids[first], s[first]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), dtype=float)
    out = op6_ann(spark, f"/root/testdata/{sf}").toPandas()
    hit = 0
    queries = ids[ids % 50 == 0]
    for own in queries:
        mine = out[out.query_id == own].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        want, s = exact(ids, x, x[ids == own][0], own, 5)
        hit += len(set(want) & set(mine.vec_id))
        for v, c in zip(mine.vec_id, mine.score):
            a, b = x[ids == v][0], x[ids == own][0]
            assert c == pytest.approx((a @ b) / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    share = out.groupby("query_id").verified.first().mean() / len(ids)
    print("recall", hit / (5 * len(queries)), "verified", share)
    assert hit >= 0.95 * 5 * len(queries)
    assert share < 0.5  # vectors without structure: the k-th nearest is at three quarters of the median distance


def test_recall_across_cells(spark):
    """With shards of 100, 2000 vectors lie in 64 cells: near groups, which let most cells be left out, and scattered vectors."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([centres[rng.integers(40, size=1500)] + 0.1 * rng.standard_normal((1500, 24)), rng.standard_normal((500, 24))])
    ids = rng.permutation(2000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("id") % 50 == 0, 5, shard_rows=100, block_rows=7).toPandas()
    hit = sum(len(set(exact(ids, x, x[ids == own][0], own, 5)[0]) & set(out[out.query_id == own].vec_id)) for own in ids[ids % 50 == 0])
    share = out.groupby("query_id").verified.first().mean() / 2000
    print("recall", hit / 200, "verified", share)
    assert len(out) == 200 and hit >= 190 and share < 0.35


def test_plan_and_collisions():
    """The plan's shares of near and far vectors hold, and only vectors that collide often enough are verified."""
    arrays, least = ann.plan()
    rng = np.random.default_rng(3)
    d, n = 48, 20_000
    q = np.eye(d)[0]
    for distance, low, high in ((0.6, 0.95, 1.0), (0.6 * ann.RATIO, 0.03, 0.2), (1.4, 0.0, 0.001)):
        c = 1 - distance**2 / 2
        side = rng.standard_normal((n, d))
        side[:, 0] = 0
        x = np.append(c * q[None] + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True), -q[None], axis=0)
        index = ann.CollisionIndex(np.arange(n + 1), x)
        assert index.directions.shape[0] == arrays and index.least == least
        found = index.colliding(q @ index.directions.T, ann.REACH * 0.6)
        assert low <= len(found) / n <= high
        *_, verified = index.nearest(np.array([-1]), q[None], np.array([0.6]), 5)
        assert len(verified) == min(5, len(found)) and (verified == len(found)).all()


def test_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 1.0, 1.0]), (8, []), (9, [-1.0, 0.0]), (1, [2.0, 0.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    out = [tuple(r) for r in ann.nearest(df, F.col("id") % 50 == 0, 5).orderBy("rank").collect()]
    assert [(r[0], r[1], r[2]) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 9)]
    assert [r[3] for r in out] == pytest.approx([1, 1, -1])
    small = ann.nearest(df, F.col("id") % 50 == 0, 2, shard_rows=2, block_rows=1).orderBy("rank").collect()
    assert [r.vec_id for r in small] == [1, 2]
    assert ann.nearest(df.filter("false"), F.col("id") % 50 == 0).count() == 0


def test_copies(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(300)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, 5, shard_rows=64).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in out[:5]] == [1, 2, 3, 4, 5] and [r.vec_id for r in out[5:10]] == [0, 1, 2, 3, 4]
