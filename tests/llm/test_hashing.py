import random
import re

import numpy as np
import pyarrow as pa

from thalassa.llm import jaccard, textnum

LINES = [None, "", "  \t", "Abc abc ABC x", "é Ünï ab\x0bcd", "longword" * 40 + " longword" * 3, "a"]


def test_words_hash_as_words():
    rng = random.Random(1)
    texts = LINES + ["".join(rng.choice("aB \n é") for _ in range(rng.randrange(60))) for _ in range(300)]
    seen = {}
    for lo, data, offsets in textnum.slices(pa.array(texts)):
        h, row, bounds = textnum.words(data, offsets)
        for i in range(len(offsets) - 1):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[lo + i] or "")
            found, mine = re.findall(r"[^\x20\x09-\x0D]+", lower), h[bounds[i] : bounds[i + 1]]
            assert len(found) == len(mine) and (row[bounds[i] : bounds[i + 1]] == i).all()
            assert all(seen.setdefault(w, x) == x for w, x in zip(found, mine))
    assert len(set(seen.values())) == len(seen)


def test_pairs_are_all_pairs_within_bounds(monkeypatch):
    rng = np.random.default_rng(0)
    rows = sorted({(int(rng.integers(0, 12)), int(rng.integers(1, 60)), int(v)) for v in rng.integers(0, 400, 900)})
    token, n, node = map(np.array, zip(*rows))
    pos, comp = np.minimum(rng.integers(0, 6, len(rows)), n - 1), node % 5
    want = {
        (min(node[i], node[j]), max(node[i], node[j]))
        for i in range(len(rows))
        for j in range(i)
        if token[i] == token[j] and comp[i] != comp[j] and n[j] * 100 >= n[i] * 80 and min(n[i] - pos[i], n[j] - pos[j]) >= -(-80 * (n[i] + n[j]) // 180)
    }
    table = pa.record_batch({"token": token, "block": np.zeros(len(rows), np.int32), "n": n.astype(np.int32), "pos": pos.astype(np.int32), "node": node, "comp": comp})
    for size in (1, 7, 1000):
        for block in (3, 1 << 20):
            monkeypatch.setattr(jaccard, "_BLOCK", block)
            out = jaccard._pairs(80, 100, False)(table.slice(k, size) for k in range(0, len(rows), size))
            assert {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())} == want
