"""Scans of series in one and in many parts against plain loops."""

import numpy as np
import pytest

from thalassa.operators import scans


def plain(b, a, x, settled):
    """A recursive filter, row by row."""
    n = max(len(a), len(b))
    b, a = np.append(b, np.zeros(n - len(b))), np.append(a, np.zeros(n - len(a)))
    gain = b.sum() / a.sum()
    old_x, old_y = [x[0] if settled else 0.0] * n, [x[0] * gain if settled else 0.0] * n
    out = []
    for v in x:
        old_x = [v, *old_x[:-1]]
        y = (b @ old_x - a[1:] @ np.array(old_y[: n - 1])) / a[0]
        old_y = [y, *old_y[:-1]]
        out.append(y)
    return np.array(out)


FILTERS = [([0.2, 0.2], [1, -0.6], False), ([0.9, -0.9], [1, -0.8], True), ([0.1, 0.2, 0.1], [1, -1.2, 0.5], True), ([0.5, 0.3, 0.1], [1], False)]


@pytest.mark.parametrize("b, a, settled", FILTERS)
def test_filter_by_blocks_and_parts(b, a, settled):
    x = np.random.default_rng(0).normal(size=2000).cumsum()
    f = scans.Recursive(b, a, settled)
    want = plain(np.array(b, float), np.array(a, float), x, settled)
    for cuts in ([], [1], [300, 301, 1555], list(range(50, 2000, 50))):
        state, got = f.none, []
        for part in np.split(x, cuts):
            got.append(f.run(part, state))
            state = f.join(state, f.of(part))
        assert np.allclose(np.concatenate(got), want, atol=1e-9)


def naive(x):
    """number, earlier, filled, cycles of a series of numbers and None."""
    out, last, count, prior = [], None, 0, None
    for i, v in enumerate(x):
        if v is not None:
            count += last is not None and last < 0 <= v
            last = v
        out.append((i + 1, prior, last, count))
        prior = v
    return out


@pytest.mark.parametrize("parts", ["1", "16"])
def test_scans_do_not_depend_on_parts(spark, parts):
    rng = np.random.default_rng(1)
    series = {"long": 3000, None: 40, "a": 1, "b": 300}
    rows = [(s, t, None if rng.random() < 0.2 else float(np.round(rng.normal(), 3)), "kept") for s, n in series.items() for t in range(n)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "s string, t int, v double, n string").repartition(5)
        for name, scan in (("num", scans.Number()), ("prior", scans.Earlier()), ("filled", scans.Earlier(skip=True)), ("cycle", scans.Cycles()), ("low", scans.Recursive([0.2], [1, -0.8]))):
            df = scans.scanned(df, ["s"], ["t"], "v", name, scan)
        got = {(r.s, r.t): r for r in df.collect()}
        both = scans.there_and_back(df, ["s"], ["t"], "filled", "both", [0.1, 0.1], [1, -0.8]).collect()
        assert scans.scanned(df.limit(0), ["s"], ["t"], "v", "x", scans.Number()).count() == 0
        alone = scans.scanned(spark.createDataFrame(rows, "s string, t int, v double, n string").where("s = 'long'"), [], ["t"], "v", "num", scans.Number()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert len(got) == len(rows) and all(r.n == "kept" for r in got.values()) and all(r.num == r.t + 1 for r in alone)
    for s, n in series.items():
        x = [got[s, t].v for t in range(n)]
        assert [(got[s, t].num, got[s, t].prior, got[s, t].filled, got[s, t].cycle) for t in range(n)] == naive(x)
        want = plain(np.array([0.2]), np.array([1, -0.8]), np.array([v or 0.0 for v in x]), False)
        assert all((v is None) == (got[s, t].low is None) and (v is None or abs(got[s, t].low - want[t]) < 1e-9) for t, v in enumerate(x))
    ends = {(r.s, r.t): r.both for r in both}
    x = np.array([got["b", t].filled or 0.0 for t in range(300)])
    there = plain(np.array([0.1, 0.1]), np.array([1, -0.8]), x, True)
    known = np.array([got["b", t].filled is not None for t in range(300)])
    if known.all():
        assert np.allclose([ends["b", t] for t in range(300)], plain(np.array([0.1, 0.1]), np.array([1, -0.8]), there[::-1], True)[::-1], atol=1e-9)
