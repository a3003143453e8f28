import numpy as np
import pytest

from thalassa.llm import rnn


def test_numeric_gradients():
    rng = np.random.default_rng(0)
    m = rnn.Gru(rng.integers(1, 50, rnn.VOCABULARY + 40))
    m.all, m.p = m.all.astype(np.float64), None
    ends = np.cumsum([int(np.prod(s)) for s in m.shapes.values()])
    m.p = {k: m.all[e - int(np.prod(s)) : e].reshape(s) for e, (k, s) in zip(ends, m.shapes.items())}
    y = rng.integers(0, rnn.VOCABULARY + 40, (5, 6))
    x = np.concatenate([np.zeros((5, 1), int), y[:, :-1]], 1)
    on = rng.random(y.shape) < 0.9
    h = rng.normal(0, 0.5, (5, rnn.HIDDEN))
    g = np.zeros(len(m.all))
    views = {k: g[e - int(np.prod(s)) : e].reshape(s) for e, (k, s) in zip(ends, m.shapes.items())}
    none = {k: np.zeros(s) for k, s in m.shapes.items()}
    m.backward(x, y, on, h, views)
    for k, e in zip(m.shapes, ends):
        lo = e - int(np.prod(m.shapes[k]))
        at = lo + np.argsort(-np.abs(g[lo:e]))[:4]
        for i in at:
            was, d = m.all[i], 1e-3
            m.all[i] = was + d
            up = m.backward(x, y, on, h, none)[0]
            m.all[i] = was - d
            down = m.backward(x, y, on, h, none)[0]
            m.all[i] = was
            assert g[i] == pytest.approx((up - down) / (2 * d), rel=2e-2, abs=2e-3), k


def test_padding_does_not_train():
    m, n = rnn.Gru(np.ones(rnn.VOCABULARY + 1)), rnn.Gru(np.ones(rnn.VOCABULARY + 1))
    x = np.array([[0, 5, 6]])
    y = np.array([[5, 6, 0]])
    g, f = ({k: np.zeros(s, np.float32) for k, s in m.shapes.items()} for _ in range(2))
    m.backward(x, y, np.ones((1, 3), bool), np.zeros((1, rnn.HIDDEN), np.float32), g)
    pad = np.zeros((1, 4), int)
    n.backward(np.append(x, pad, 1), np.append(y, pad, 1), np.arange(7)[None] < 3, np.zeros((1, rnn.HIDDEN), np.float32), f)
    assert all(np.allclose(g[k], f[k], atol=1e-5) for k in g)


def test_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "a b " * 40_000), (3, "a b " * 40_000)], "doc_id long, text string")
    got = rnn.score(d).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 4, 80_001, 80_001]
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert rnn.score(d.limit(0)).count() == 0


def test_counts_find_words_of_one_slot():
    rng = np.random.default_rng(1)
    w = np.unique(np.append(rng.integers(1, 1 << 63, 3000).astype(np.uint64), np.arange(1, 300, dtype=np.uint64)))  # 299 in the first slot
    counts = rnn.Counts(w, np.arange(len(w)) + 5, np.full(64, 1e6), np.full(64, 1e4))
    t = rng.permutation(np.concatenate([w, w[:400] + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)]))
    c, place = counts.look(t)
    have = dict(zip(counts.w.tolist(), zip(counts.c.tolist(), counts.place.tolist())))
    want = [have.get(x, (-1, rnn.VOCABULARY + int(rnn.bucket(np.array([x], np.uint64), 64)[0]))) for x in t.tolist()]
    assert list(zip(c.tolist(), place.tolist())) == want


@pytest.mark.parametrize("size", [0.1, 3, 30])
def test_outputs_of_small_and_large_weights(size):
    rng = np.random.default_rng(2)
    m = rnn.Gru(rng.integers(1, 50, rnn.VOCABULARY + 40))
    for k in ("wc", "ww"):
        m.p[k][:] = rng.normal(0, size, m.p[k].shape)
    h, y = rng.uniform(-1, 1, (40, rnn.HIDDEN)).astype(np.float32), rng.integers(0, rnn.VOCABULARY + 40, 40)
    grad = {k: np.zeros(s, np.float32) for k, s in m.shapes.items()}
    got, dh = m.outputs(h, y, grad)

    def plain(a, at):
        a = a - a.max(1, keepdims=True)
        return a[np.arange(len(a)), at] - np.log(np.exp(a).sum(1))

    wc, ww, h = m.p["wc"].astype(float), m.p["ww"].astype(float).reshape(m.classes, rnn.CLASS, -1), h.astype(float)
    inner = np.einsum("ij,ikj->ik", h, ww[y // rnn.CLASS]) + m.p["bw"].reshape(m.classes, -1)[y // rnn.CLASS]
    floor = np.log(1e-30)
    want = np.maximum(plain(h @ wc + m.p["bc"], y // rnn.CLASS), floor) + np.maximum(plain(inner, y % rnn.CLASS), floor)
    assert np.allclose(got, want, rtol=1e-4, atol=2e-3)
    assert np.isfinite(dh).all() and all(np.isfinite(g).all() for g in grad.values())


def test_outputs_of_few_long_texts_are_computed_together(monkeypatch):
    m = rnn.Gru(np.ones(rnn.VOCABULARY + 40))
    place = np.random.default_rng(3).integers(0, rnn.VOCABULARY + 40, 60_000).astype(np.int32)
    bounds = np.array([0, 25_000, 25_001, 40_000, 60_000])
    called, outputs = [], m.outputs
    monkeypatch.setattr(m, "outputs", lambda h, y: called.append(len(y)) or outputs(h, y))
    got = m.score(place, bounds)
    assert sum(called) == len(place)
    assert len(called) <= 5  # 782 windows
    for lo, hi in zip(bounds, bounds[1:]):
        assert np.allclose(m.score(place[lo:hi], np.array([0, hi - lo])), got[lo:hi], atol=1e-4)
