import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from thalassa.llm import collocations

SCHEMA = "text string, lang string, chunk long, id string, words int"


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in cand.items():
            if 100 * inside[p] >= 80 * a:
                continue
            s, j = min((2_000_000 * a // (c[p[:j]] + c[p[j:]]), j) for j in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:j]], c[p[j:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(rng, n):
    """Texts of few words, so that phrases of all lengths, their parts and ties are frequent."""
    words = ["a", "B", "été", "d\x00e", " ", "日本", "x" * 30, "don't", "f", "g"]
    p = 1 / np.arange(1, 11)
    out = []
    for i in range(n):
        w = rng.choice(words, rng.integers(0, 60), p=p / p.sum())
        text = "".join(x + rng.choice([" ", "\t ", " ", ", ", ".", "\n", "\r\n"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for x in w)
        out.append((text, [None, "und", "en", ""][i % 4], 1, "z", 2))
    return out


@pytest.mark.parametrize("least", [5, 30])
def test_equal_to_brute_force(spark, least):
    rows = texts(np.random.default_rng(1), 400) + [(None, "en", None, None, None), ("", None, 1, "x", 1)] * 3
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least)
    assert sorted(tuple(r)[:-1] for r in got.collect()) == brute(rows, least)


def test_chunks_cut_at_pieces(spark, monkeypatch):
    """Long texts span chunks, and pieces without end stay whole."""
    rng = np.random.default_rng(2)
    rows = texts(rng, 300)
    rows = [(" ".join(r[0] for r in rows[i : i + 100]), "en", 0, "", 0) for i in range(0, 300, 100)] + [("red green blue " * 2000, "en", 0, "", 0), (".", "en", 0, "", 0)]
    stretches = [(rows[0][0] * 3).encode(), b"word " * 999, b"", b"a.b" * 500]
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK_BYTES", 512)
    column = pa.array([s.decode() for s in stretches] + [None])
    got = [(d.tobytes(), o.tolist()) for d, o in collocations._stretches(column)]
    assert b"".join(d for d, _ in got) == b"".join(stretches) and all(o[0] == 0 and o[-1] == len(d) for d, o in got)
    assert len(got) > 10
    words = [w for d, o in got for w in collocations._words(np.frombuffer(d, np.uint8), np.array(o))[0].to_pylist()]
    low = [w for s in stretches for w in re.split("[ \t.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in s.decode())) if w]
    assert words == low
    monkeypatch.undo()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r)[:-1] for r in got.collect()) == brute(rows)


def test_names_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    rows = texts(np.random.default_rng(3), 200)
    assert sorted(tuple(r)[:-1] for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_first_rows_and_ties(spark):
    rows = [(f"p{i} q{i}. " * 40, "en", 0, "", 0) for i in range(50)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), top=7).orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.score, r.a, r.n, r.cut) for r in got] == [(i + 1, p, 1_000_000, 40, 4000, 1) for i, p in enumerate(sorted(f"p{i} q{i}" for i in range(50))[:7])]


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None, 1, "", 1)], SCHEMA)).count() == 0
