import numpy as np
import pytest

from thalassa.llm import jaccard, textnum


def near_copies(seed, groups, size, words=60):
    """Texts of which each group shares a base, with 0 to 4 words changed: similarities on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"w{g}x{i}" for i in rng.integers(0, 500, words)]
        for _ in range(size):
            t = list(base)
            for at in rng.integers(0, words, rng.integers(0, 4)):
                t[at] = f"z{rng.integers(0, 10**6)}"
            out.append(" ".join(t))
    return out


def brute(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                top[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [1 << 14, 20])
def test_near_copies_brute(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = list(enumerate(near_copies(3, 4, 80)))
    rows += [(1000, None), (1001, " \t"), (1002, "one two"), (1003, "ONE two"), (3, rows[3][1]), (1004, "long " * 30_000)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want
    assert 10 < len({c for _, _, c in want}) < 200


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(d).count() == 0
    assert jaccard.deduplicate(d).count() == 0


def test_deduplicate(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z"), (6, None, "n"), (6, None, "n"), (7, "A b c d e f g h", "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumnRenamed("_id", "_node")
    assert sorted(map(tuple, jaccard.deduplicate(d).collect()), key=str) == sorted([(3, a, "x"), (5, b, "z"), (6, None, "n"), (6, None, "n")], key=str)
    twin = spark.createDataFrame([(1, a), (1, a + " i")], "doc_id long, text string")
    assert jaccard.deduplicate(twin).count() == 1


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 62, n).astype(np.uint64)])) for n in rng.integers(0, 300, 40)]
    import pyarrow as pa

    maps = jaccard.Bitmaps(pa.array([jaccard.bitmap(x) for x in sets], pa.binary()))
    i, j = np.triu_indices(len(sets), 1)
    far = maps.difference(i, j)
    true = np.array([len(np.setxor1d(sets[p], sets[q])) for p, q in zip(i, j)])
    assert (far <= true).all() and (far > 0.4 * true).all()


def test_forest():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 50, 400)
    keep = jaccard.forest(a, b, rng.integers(0, 9, 400), 60)
    assert len(set(keep)) == len(keep) == len(set(a) | set(b)) - 1


def test_set_key_ignores_order():
    x = textnum.mix(np.arange(9, dtype=np.uint64))
    assert jaccard.set_key(x) == jaccard.set_key(x[::-1].copy()) != jaccard.set_key(x[:8])


def test_components_with_more_links(spark):
    from thalassa.llm.components import connected, extended

    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (230, 2))]
    of = lambda x: spark.createDataFrame(x, "a long, b long")
    whole = {r.node: r.c for r in connected(of(links)).collect()}
    parts = extended(extended(connected(of(links[:90])), of(links[90:150])), of(links[150:]))
    got = parts.collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.c for r in got} == whole
    assert extended(connected(of([])), of([])).count() == 0
