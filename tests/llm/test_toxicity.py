import numpy as np
import pytest

from thalassa.llm import toxicity


@pytest.fixture(scope="module")
def pairs(spark):
    """Texts of 30 words with `alpha`, `beta`, both or neither; toxic if they hold just one of them, so no word tells alone."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(2000):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join([f"f{j}" for j in rng.integers(0, 300, 30)] + ["alpha"] * int(a) + ["Beta"] * int(b)), int(a ^ b)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return d.drop("toxic").cache(), d.drop("text").cache(), {r[0]: r[2] for r in rows}


def test_learns_what_only_a_pair_tells(spark, pairs):
    docs, labels, toxic = pairs
    got = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.held_out()).where("held").collect()
    assert len(got) > 300
    assert np.mean([(r.toxic_score >= 0.5) == toxic[r.doc_id] for r in got]) > 0.9


def test_margins_brute():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.arange(0, 40, 2))
    m.w0, m.w, m.v = 0.3, rng.normal(size=20), rng.normal(size=(20, toxicity.RANK))
    rows = [np.unique(rng.integers(0, 40, n)) for n in (0, 1, 9, 30)]
    cut = np.append(0, np.cumsum([len(r) for r in rows]))
    share = [max(1, sum(i % 2 == 0 for i in r)) ** -toxicity.SHARE for r in rows]
    got = m.margins(*m.active(np.concatenate(rows), cut))
    for x, r, c in zip(got, rows, share):
        f = [i // 2 for i in r if i % 2 == 0]
        assert x == pytest.approx(0.3 + m.w[f].sum() + c * sum(m.v[i] @ m.v[j] for n, i in enumerate(f) for j in f[:n]))


def test_edges(spark, pairs):
    docs, labels, _ = pairs
    model = toxicity.fit(docs, labels)
    d = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (None, "alpha " * 50_000, 7.0), (3, "beta", 7.0), (3, "beta", 7.0)], "doc_id long, text string, toxic_score double")
    got = toxicity.score(d, model)
    assert got.columns == d.columns
    rows = got.collect()
    assert len(rows) == 5 and all(0 < r.toxic_score < 1 for r in rows)
    assert len({r.toxic_score for r in rows if r.doc_id in (1, 2)}) == len({r.toxic_score for r in rows if r.doc_id == 3}) == 1
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels) is None


def test_stage_keeps_columns(spark, pairs, tmp_path):
    docs, labels, toxic = pairs
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.stage(spark, docs.selectExpr("*", "1 AS toxic_score", "2 AS _toxic_score"), str(tmp_path))
    assert out.columns == ["doc_id", "text", "toxic_score", "_toxic_score"]
    assert np.mean([toxic[r.doc_id] for r in out.collect()]) < 0.1


def test_gradient_numeric():
    """One step of a batch goes down the gradient of its loss."""
    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(np.arange(12))
    m.w0, m.w, m.v = 0.1, rng.normal(size=12), rng.normal(size=(12, toxicity.RANK))
    rows = [np.sort(rng.permutation(12)[:n]) for n in (3, 5, 8)]
    i, cut, y = np.concatenate(rows), np.append(0, np.cumsum([3, 5, 8])), np.array([1.0, 0, 1])
    loss = lambda: float((np.logaddexp(0, m.margins(i, cut)) - y * m.margins(i, cut)).sum())
    want = np.zeros_like(m.v)
    for k in np.ndindex(*m.v.shape):
        kept = m.v[k]
        m.v[k] = kept + 1e-6
        up = loss()
        m.v[k] = kept - 1e-6
        want[k] = (up - loss()) / 2e-6
        m.v[k] = kept
    grown = np.ones(12), np.zeros_like(m.v), [1e-8]
    m._step(i, cut, y, np.arange(3), grown)
    assert np.allclose(np.sqrt(grown[1]), np.abs(want), atol=1e-6)


def test_factors_of_real_labels(spark):
    """On the given table factors take part in the model and lower its held-out loss."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert (model.v != 0).sum() > 1000 and np.abs(model.v).max() > 0.1
    held = docs.join(labels.groupBy("doc_id").agg({"toxic": "max"}), "doc_id").where(toxicity.held_out()).select("text", "max(toxic)").toArrow()
    x, cut = zip(*toxicity._buckets(held.column(0).combine_chunks()))
    y, full, plain = held.column(1).to_numpy().astype(float), [], []
    for i, c in zip(x, cut):
        full += model.margins(*model.active(i, c)).tolist()
    model.v = np.zeros_like(model.v)
    for i, c in zip(x, cut):
        plain += model.margins(*model.active(i, c)).tolist()
    loss = lambda m: float(np.mean(np.logaddexp(0, m) - y * m))
    assert loss(np.array(full)) < loss(np.array(plain)) and np.mean((np.array(full) >= 0) == y) > 0.96
