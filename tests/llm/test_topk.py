import numpy as np
import pytest

from thalassa.llm import topk


def brute(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and np.isfinite(e).all()]
    out = []
    for a, (i, e) in enumerate(ok):
        if i % 100 == 0:
            s = sorted((-sum(p * q for p, q in zip(e, f)), j) for b, (j, f) in enumerate(ok) if a != b)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 60_000.0])
def test_ties_large_values_and_short_vectors(spark, scale):
    """With large components sums of products are beyond 2^53, where floating sums round."""
    rng = np.random.default_rng(2)
    rows = [(i, (scale * rng.normal(size=16)).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, [0.0] * 16), (7, rows[0][1][:3]), (None, rows[1][1]), (8, None)]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (5, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.exact_topk(d).collect()] == [(0, 1, 5, (3 * 1024) * 1024 + 1024 * 2 * 1024)]
    assert topk.exact_topk(d.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_topk(spark.createDataFrame([(0, [1e12]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
