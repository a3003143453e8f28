import numpy as np
from pyspark.sql import functions as F

from thalassa.llm import leaks


def test_recall_at_the_least_similarity(spark):
    """Items of 50 words (46 shingles) with a run of words replaced at the end, so that 41 of 46 shingles stay: 41 / 51 = 0.80."""
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 50))) for i in range(400)]
    docs = []
    for i, t in items:
        w = t.split()
        docs.append((i, " ".join([f"a{i}b"] * 7 + w[:45] + [f"z{i}y{j}" for j in range(5)] + [f"c{i}d"] * 9)))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id and abs(r.similarity - 41 / 51) < 1e-9 for r in found)
    assert len(found) >= 398


def test_prints_tell_apart(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 46)
    rows = [(0, base.tolist())]
    rows += [(n, np.append(base[n:], rng.integers(-(2**62), 2**62, n)).tolist()) for n in (1, 5, 10, 46)]
    got = {r.n: r.f for r in spark.createDataFrame(rows, "n int, s array<long>").select("n", leaks.simhashes(F.col("s")).alias("f")).collect()}
    far = {n: np.mean([((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(got[0], got[n])]) for n in got}
    assert far[0] == 0 and far[1] < far[5] < far[10] < far[46]
    assert 24 < far[46] < 40 and far[5] < 14


def test_edges(spark):
    item = " ".join(f"i{j}" for j in range(20))
    docs = spark.createDataFrame([(None, item, 1, 2), (1, None, 1, 2), (2, "x " * 50_000 + item, 1, 2), (2, "x " * 50_000 + item, 1, 2), (3, "y " * 30, 1, 2)], "doc_id long, text string, _key int, item_id int")
    items = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    got = leaks.leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.first) for r in got) == [("2", 7, 50_000), ("2", 8, 50_000), ("None", 7, 0), ("None", 8, 0)]
    kept = leaks.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert leaks.leaks(docs.limit(0), items).count() == 0
