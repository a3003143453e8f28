import numpy as np
import pytest

from thalassa.llm import whitening

DIR = "/root/testdata/sf0.01"


def brute(vectors):
    """n, eigenvalues and vectors of the covariance (float of exact sums), x and exact deviations of all rows."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * c - t for c, t in zip(r, s, strict=True)] for r in fit], float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    dev = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    return n, e[::-1], v[:, ::-1], [[c - t / n for c, t in zip(r, s, strict=True)] for r in x], dev


def test_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    n, e, v, centred, dev = brute([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in whitening.query(spark, DIR).collect()}
    assert len(got) == 16 * len(rows)
    for j in range(16):
        want = np.array(centred) @ v[:, j] / np.sqrt(e[j])
        have = np.array([got[r.vec_id, j + 1].whitened for r in rows])
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-9
    one = next(iter(got.values()))
    assert one.identity_error < 1e-9 and all(r.n == n for r in got.values())
    for r, d in zip(rows, dev, strict=True):
        assert all(got[r.vec_id, j + 1].deviation == d and got[r.vec_id, j + 1].explained == pytest.approx(e[j] / e.sum(), rel=1e-9) for j in range(16))


def test_cases(spark):
    """Nulls, non-finite entries, short and repeated vectors, and fewer components than 16."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), "a") for i in range(50)]
    rows += [(1, rows[3][1], "b"), (None, rows[3][1], "c"), (60, [1.0, 2.0], "d"), (61, [], "e")]
    bad = [(70, None, ""), (71, [1.0, None, 0.0, 0.0], ""), (72, [float("nan")] * 4, ""), (73, [float("-inf"), 0.0, 0.0, 0.0], "")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, x string").repartition(5)
    fit, out = whitening.whiten(table)
    n, e, v, centred, dev = brute([r[1] + [0.0] * (4 - len(r[1])) for r in rows])
    got = out.collect()
    assert fit.n == n == 52 and len(got) == len(rows) and np.allclose(fit.variances, e, rtol=1e-12) and fit.total == pytest.approx(e.sum())
    assert sorted(int(r.deviation) for r in got) == sorted(dev) and {len(r.w) for r in got} == {4}
    assert fit.identity_error < 1e-9


def test_dependent_dimensions(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (200, 3)) / 64
    rows = [(i, [*r.tolist(), 1.5, float(r[0]), float(2 * r[1])]) for i, r in enumerate(a)]
    fit, out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(fit.variances) == 3 and fit.identity_error < 1e-9 and out.count() == 200


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])] * 3, [(1, [])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.query(spark, str(tmp_path)).count() == 0


def test_large_sums():
    y = np.array([[2**40, -(2**40) - 1, 3], [2**61 - 1, 5, -7], [0, 0, 1]])
    assert whitening._squares(y) == [sum(int(v) ** 2 for v in r) for r in y]
    x = np.array([[2**40, 7], [1, 2]])
    s = np.array([2**70, 5], object)
    assert whitening._sent(x, 2**30, s).tolist() == [[2**70 - 2**70, 2**30 * 7 - 5], [2**30 - 2**70, 2**31 - 5]]
    assert whitening._squares(whitening._sent(x, 2**30, s)) == [sum(int(v) ** 2 for v in r) for r in [[0, 2**30 * 7 - 5], [2**30 - 2**70, 2**31 - 5]]]


def test_refused(spark):
    with pytest.raises(ValueError, match="quantised"):
        whitening.whiten(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"))
