import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from thalassa.llm import secrets  # noqa: E402

ENCODINGS = {
    "upper hex": "0123456789ABCDEF",
    "decimal": "0123456789",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
PLAIN = ["internationalisation-of-the-interoperability", "this_is_a_rather_long_name_of_a_variable", "Donaudampfschifffahrtsgesellschaftskapitaen", "00000000000000000000000000000000", "1234567890" * 4, "abcabcabcabc1abcabcabcabc1", "ABABABABABABABABABABABAB12", "see/the/path/of/the/file/in/the/folder"]


@pytest.mark.parametrize("name", ENCODINGS)
def test_random_tokens_are_found(spark, name):
    rng = np.random.default_rng(8)
    d = [(i, f"the key {''.join(rng.choice(list(ENCODINGS[name]), 64))} ends") for i in range(200)]
    d += [(1000 + i, f"plain {PLAIN[i % len(PLAIN)]} words") for i in range(200)]
    got = {r.doc_id: [x.k for x in r.secrets] for r in secrets.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    # digits alone are lower-case hex too
    assert sum(got[i] == [2 if name == "decimal" else 3] for i in range(200)) >= 180
    assert not any(3 in got[1000 + i] for i in range(200))


def test_random_digits(spark):
    rng = np.random.default_rng(5)
    d = [(i, "no " + "".join(rng.choice(list("0123456789"), 23))) for i in range(200)] + [(1000 + i, f"no {i:023d}") for i in range(200)]
    got = {r.doc_id: [x.k for x in r.secrets] for r in secrets.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert sum(got[i] == [3] for i in range(200)) >= 180
    assert not any(got[1000 + i] for i in range(200))


def test_battery_brute(spark):
    import math

    rng = np.random.default_rng(6)
    alphabet = ENCODINGS["base64"]
    tokens = ["".join(rng.choice(list(alphabet), n)) for n in (20, 33, 64, 200)] + ["see/the/path/of/the/file/in/the/folder2"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("b")).collect()
    for r in got:
        n, k = len(r.t), 64
        x = np.array([alphabet.index(c) + 1 for c in r.t], float)
        squares = sum(r.t.count(c) ** 2 for c in set(r.t))
        phi = lambda z: 1 / (1 + math.exp(-(1.5976 * z + 0.070565 * z**3)))
        high = x > k / 2
        a = high.sum()
        mean = 2 * a * (n - a) / n + 1
        z = [
            abs((k / n * squares - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)),
            abs(1 + (high[1:] != high[:-1]).sum() - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)),
            abs(((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum() / ((x - x.mean()) ** 2).sum()) * math.sqrt(n),
        ]
        t = -sum(math.log(max(2 * (1 - phi(v)), 1e-12)) for v in z)
        assert r.b.random == pytest.approx(math.exp(-t) * (1 + t + t * t / 2), rel=1e-6)


def test_short_tokens_meet_short_ones(spark):
    rng = np.random.default_rng(9)
    words = ["lemon", "orchard", "silver", "window", "stone", "river", "garden", "letter"]
    d = [(i, "-".join(rng.choice(words, 4)) + str(i)) for i in range(600)]
    d += [(1000 + i, "".join(rng.choice(list(ENCODINGS["base64"]), 44))) for i in range(20)]
    got = {r.doc_id: [x.k for x in r.secrets] for r in secrets.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert sum(3 in got[i] for i in range(600)) <= 6
    assert sum(3 in got[1000 + i] for i in range(20)) >= 16


def test_false_discovery_rules():
    n = [0] * secrets.BINS
    assert secrets.benjamini_hochberg(n[:-1] + [5], 0.05) == -1
    assert secrets.benjamini_hochberg([9] + n[1:-1] + [5], 0.05) == 0
    flat = [10] * secrets.BINS
    assert secrets.least_random(flat, 0.05) == 2
    heap = [0] * 40 + [500] + [0] * (secrets.BINS - 41)
    assert secrets.least_random([a + b for a, b in zip(flat, heap)], 0.05) > 40


def test_edges(spark):
    t = "AKIA" + "Q" * 20 + " token: abc.def-1 "
    d = spark.createDataFrame([(1, None, 1, 2), (2, "", 1, 2), (3, t, 1, 2), (3, t, 1, 2), (4, "x" * 200_000 + " password=abcdefgh", 1, 2)], "doc_id long, text string, secrets int, _text int")
    got = secrets.scan(d).collect()
    assert sorted((r.doc_id, [(x.s, x.k, x.e) for x in r.secrets]) for r in got) == sorted((r.doc_id, brute.secrets(r.text)) for r in d.collect())
    clean = secrets.redact(d)
    assert clean.columns == d.columns and {r.secrets for r in clean.collect()} == {1}
    assert secrets.scan(d.limit(0)).count() == 0
