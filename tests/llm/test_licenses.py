import numpy as np
import pyarrow as pa

from thalassa.llm import licenses, textnum


def shingles(text):
    (data,) = textnum.slices(pa.array([text]))
    return textnum.shingles(*textnum.words(*data[1:]))[0]


def brute(index, s, containment=licenses.CONTAINMENT):
    """The templates that some window of their size contains enough of."""
    out = set()
    for t, x in enumerate(index.sets):
        for b in range(max(1, len(s) - len(x) + 1)):
            if len(np.intersect1d(s[b : b + len(x)], x)) >= containment * len(x) - 1e-9:
                out.add(t)
                break
    return out


def test_near_matches_brute():
    """Templates with words changed and fillers around, on both sides of the least containment."""
    rng = np.random.default_rng(0)
    index = licenses.Index(licenses.TEMPLATES)
    texts = [t for v in licenses.TEMPLATES.values() for t in v]
    wanted = missed = 0
    for _ in range(300):
        w = texts[rng.integers(len(texts))].split()
        for at in rng.integers(0, len(w), rng.integers(0, 1 + len(w) // 25)):
            w[at] = f"x{at}"
        fill = lambda: [f"f{i}" for i in rng.integers(0, 999, rng.integers(0, 60))]
        s = shingles(" ".join([*fill(), *w, *fill()]))
        want = brute(index, s)
        got = {t for t, *_ in index.scan(s)}
        assert got <= want
        wanted += len(want)
        missed += len(want - got)
    assert wanted > 200 and missed <= wanted * 0.01


def test_full_texts_and_places(spark):
    mit = licenses.TEMPLATES["MIT"][-1]
    bsd3 = licenses.TEMPLATES["BSD-3-Clause"][-1]
    d = spark.createDataFrame([(1, f"a b c {mit} d", 0), (2, f"{bsd3}\n\nand {mit}", 0), (3, None, 0), (4, "word " * 60_000 + mit, 0), (4, "word " * 60_000 + mit, 0)], "doc_id long, text string, licenses int")
    got = sorted((r.doc_id, [(x.name, x.first, x.last) for x in r.licenses]) for r in licenses.scan(d).collect())
    n, m = len(mit.split()), len(bsd3.split())
    assert got[0] == (1, [("MIT", 3, 3 + n - 1)])
    # a text that repeats shingles has more of them than its window, which holds all distinct ones
    assert [(x, a, 0) for x, a, _ in got[1][1]] == [("BSD-3-Clause", 0, 0), ("MIT", m + 1, 0)]
    assert got[1][1][0][2] in range(m - 10, m)
    assert got[2] == (3, [])
    assert got[3] == got[4] == (4, [("MIT", 60_000, 60_000 + n - 1)])
    assert licenses.scan(d.limit(0)).count() == 0


def test_band_probability():
    j = licenses.CONTAINMENT / (2 - licenses.CONTAINMENT)
    assert 1 - (1 - j**licenses.ROWS) ** licenses.BANDS > 0.9999
