import numpy as np
from pyspark.sql import functions as F

from lorespark.functions import vectors as V
from lorespark.operators import vector_index as X
from lorespark.plans.retrieval import knn

SF = "/root/testdata/sf0.1"


def grouped(n=4000, d=32, groups=60, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    return centres[rng.integers(groups, size=n)] + 0.25 * rng.standard_normal((n, d))


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(f"d{i // 10}", int(i), v.tolist()) for i, v in zip(ids, x)], "relpath string, id long, vector array<double>")


def recall(found, want):
    a, b = ({(r.query_id, r[1]) for r in df.collect()} for df in (found, want))
    return len(a & b) / len(b)


def test_grouped_vectors(spark, tmp_path):
    """High recall while few vectors are read; insertion, deletion and new centroids by commits."""
    x = grouped()
    rows = table(spark, x)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("v"))
    index = X.VectorIndex(spark, str(tmp_path / "i"))
    index.put(rows.filter("id < 3500"))
    index.put(rows.filter("id >= 3500"), spark.createDataFrame([("d0",), ("d1",)], "relpath string"))
    index.put(table(spark, -x[20:30], range(20, 30)))  # d2 changes
    now = rows.filter("id >= 30").unionByName(table(spark, -x[20:30], range(20, 30)))
    want = V.nearest(now, "id", "vector", asked, "query_id", "v", 10)
    one = asked.filter("query_id = 500")
    got, counts = index.search(one, 10, probes=6)
    assert counts["vectors"] == 3980 and counts["read"] < 0.35 * 3980
    got, counts = index.search(asked, 10, probes=6)
    print("grouped", recall(got, want))
    assert recall(got, want) >= 0.95 and {r.rank for r in got.collect()} == set(range(1, 11))
    assert not {r.id for r in got.collect()} & set(range(20))
    # exact similarities of what is found
    exact = {(r.query_id, r.id): r.similarity for r in want.collect()}
    assert all(abs(exact.get((r.query_id, r.id), r.similarity) - r.similarity) < 1e-9 for r in got.collect())
    index.store.compact()
    index.rebuild(cells=40)
    again, counts = index.search(asked, 10, probes=6)
    assert len(index.centres()) == 40 and counts["vectors"] == 3980 and recall(again, want) >= 0.95


def test_vectors_without_structure(spark):
    """All cells probed: what is lost is lost to codes alone. Half of them: what half of the vectors gives."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    centres = X.fit(e, "vec_id")
    coded = X.coded(e, centres, "vec_id").cache()
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("v"))
    want = knn(spark, SF).select("query_id", "vec_id")
    every, counts = X.search(coded, centres, asked, 10, probes=len(centres), id_col="vec_id")
    assert recall(every, want) >= 0.999 and counts["read"] == counts["vectors"]
    most, _ = X.search(coded, centres, asked, 10, probes=round(0.8 * len(centres)), id_col="vec_id")
    print("structureless, 0.8 of the cells:", recall(most, want))
    assert recall(most, want) >= 0.95


def test_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 0.0]), ("b", 3, None), ("b", 4, []), ("c", 5, [2.0, 0.0]), ("c", 6, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "relpath string, id long, vector array<double>")
    centres = X.fit(df.filter("size(vector) = 2"))
    q = spark.createDataFrame([(9, [3.0, 0.0]), (8, None), (7, [1.0, 1.0, 1.0])], "query_id long, v array<double>")
    got, _ = X.search(X.coded(df, centres), centres, q, 5)
    assert [(r.query_id, r.id, r.similarity) for r in got.orderBy("rank").collect()] == [(9, 1, 1.0), (9, 5, 1.0), (9, 2, 0.0)]
    none, counts = X.search(X.coded(df.filter("false"), centres), centres, q, 5)
    assert none.count() == 0 and counts == {"vectors": 0, "read": 0}
    assert X.fit(df.filter("false")).shape == (0, 0)
