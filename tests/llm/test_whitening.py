import numpy as np
import pytest

from plyforge.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, "x", "k") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def dense(df, n, k):
    p = df.toPandas()
    out = np.full((n, k), np.nan)
    out[p["vec_id"].to_numpy(int), p["component"].to_numpy(int) - 1] = p["whitened"]
    return p, out


def brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000
    c = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(c.T @ c / len(c))
    return c, values[::-1], turn[:, ::-1]


@pytest.mark.parametrize("d, options", [(6, {}), (40, {"components": 5, "block": 6, "basis": 18}), (40, {})])
def test_equals_numpy(spark, d, options):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((400, d)) * rng.uniform(0.2, 3, d)).astype(np.float32).tolist()
    k = min(d, options.get("components", 32))
    p, got = dense(whitening.whiten(table(spark, vectors), **options), 400, k)
    c, values, turn = brute(vectors)
    assert len(p) == 400 * k and set(p["n"]) == {400}
    for j in range(k):
        want = c @ turn[:, j] / np.sqrt(values[j])
        sign = np.sign(want @ got[:, j])
        assert np.abs(want * sign - got[:, j]).max() < 1e-8
    share = p.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values[:k] / values.sum(), rtol=1e-9)
    assert p["identity_error"].nunique() == 1 and p["identity_error"].iloc[0] < 1e-9
    assert np.abs(got.T @ got / 400 - np.eye(k)).max() < 1e-9
    x = (np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000).astype(object)
    exact = ((400 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert p.groupby("vec_id")["deviation"].first().tolist() == exact.tolist()


def test_nearly_equal_eigenvalues_take_more_passes_and_are_certified(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((3000, 30)).astype(np.float32).tolist()
    rows, d = whitening.whole_rows(table(spark, vectors), "vec_id", "embedding")
    model = whitening.fit(rows, d, components=4, block=5, basis=15)
    _, values, turn = brute(vectors)
    assert model.passes > 3 and np.allclose(model.values, values[:4], rtol=1e-11)
    assert np.allclose(np.abs((model.vectors * turn[:, :4]).sum(axis=0)), 1, atol=1e-10)
    with pytest.raises(RuntimeError, match="certified"):
        whitening.fit(rows, d, components=4, block=5, basis=15, most_passes=2)


def test_bad_rows_go_and_dependent_dimensions_are_null(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 2.0, 5.0], [2.0, 4.0, 5.0], [3.0, 6.0, 5.0], None, [1.0, None, 1.0], [inf, 1.0, 1.0], [nan, 1.0, 1.0], [], [1.0, 2.0], [2.0, 4.0, 5.0]]
    df = table(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, 8, None])
    got = whitening.whiten(df).toPandas()
    assert len(got) == 4 * 3 and set(got["n"]) == {4} and got["vec_id"].isna().sum() == 3
    first = got[got["component"] == 1]
    assert first["whitened"].notna().all() and first["explained"].iloc[0] == pytest.approx(1)
    rest = got[got["component"] > 1]
    assert rest["whitened"].isna().all() and (rest["explained"] == 0).all() and got["identity_error"].iloc[0] < 1e-12
    assert np.mean(first["whitened"] ** 2) == pytest.approx(1)


def test_one_row_and_no_rows(spark):
    one = whitening.whiten(table(spark, [[1.0, 2.0]])).toPandas()
    assert len(one) == 2 and one["whitened"].isna().all() and set(one["deviation"]) == {0} and set(one["explained"]) == {0.0}
    assert whitening.whiten(table(spark, [[1.0]]).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [None, [None]])).count() == 0


def test_deviations_past_64_bits_are_decimals(spark):
    got = whitening.whiten(table(spark, [[1e7, 0.0], [-1e7, 0.0]] * 3)).toPandas()
    x = [[640_000_000 + 1_000_000, 1_000_000], [-640_000_000 + 1_000_000, 1_000_000]] * 3
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((6 * v - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    assert want[0] > 1 << 63 and [int(v) for v in got.sort_values(["vec_id", "component"])["deviation"][::2]] == want


def test_query(spark):
    from plyforge.llm.queries import op13_embedding_whitening

    got = op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(got.dtypes)["deviation"] == "bigint"
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").toPandas()
    p = got.toPandas()
    c, values, turn = brute(np.stack(vectors["embedding"]).tolist())
    for j in (0, 15, 31):
        one = p[p["component"] == j + 1].sort_values("vec_id")["whitened"].to_numpy()
        want = c @ turn[:, j] / np.sqrt(values[j])
        assert np.abs(want * np.sign(want @ one) - one).max() < 1e-8
