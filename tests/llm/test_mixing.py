import math

import pytest

from thalassa.llm import mixing


def filled(sizes, share=1.5, weights=(3, 1, 2), copies=2):
    """Targets by rounds: those above copies times their source stop, the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        rate = rest / sum(w[s] for s in free)
        over = {s for s in free if rate * w[s] >= copies * sizes[s]}
        if not over:
            return out | {s: rate * w[s] for s in free}
        for s in over:
            out[s] = copies * sizes[s]
            rest -= out[s]
        free -= over
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 900, "c": 500, None: 30},
        {"a": 10**12, "b": 10**12, "c": 5 * 10**12, "d": 7},
        {"a": 1, "b": 10**6, "c": 2, "d": 3, "e": 10**5, "f": 4},
        {"a": 0, "b": 0},
        {"a": 5},
    ],
)
def test_targets_by_rounds(spark, sizes):
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = filled(sizes)
    for s in sizes:
        assert got[s] == (sizes[s], pytest.approx(want[s], rel=1e-12))


def test_many_sources(spark):
    sizes = {f"s{i:04d}": 1 + (i * 7919) % 1000 for i in range(700)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = filled(sizes)
    assert all(got[s] == pytest.approx(want[s], rel=1e-9) for s in sizes)


def test_edges(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, "x", 1), (3, " ", None, 1), (4, "d " * 50_000, None, 1), (None, "e f", "y", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mix_sources(d).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("x", "y", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - math.floor(mine[0].target)) <= 1
    assert mixing.mix_sources(d.limit(0)).count() == 0
    again = mixing.mix_sources(d.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.taken, r.mix_start) for r in got) == sorted((str(r.doc_id), r.taken, r.mix_start) for r in again)
