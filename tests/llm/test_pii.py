import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from thalassa.llm import pii, registry


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "write to ann@x.example or +49 30 1234567, 10.0.0.1, 4111 1111 1111 1111"), (3, "write to ann@x.example or +49 30 1234567, 10.0.0.1, 4111 1111 1111 1111"), (4, "plain " * 60_000 + "bob@y.example")]
    d = spark.createDataFrame([(*r, 7, "x", 1.5, True) for r in rows], "doc_id long, text string, found int, terms string, dk double, _cuts boolean")
    clean = pii.sanitise(d)
    assert clean.columns == d.columns
    got = clean.collect()
    assert all((r.found, r.terms, r.dk, r["_cuts"]) == (7, "x", 1.5, True) for r in got)
    text = {r.doc_id: r.text for r in got}
    assert text[1] is None and text[2] == "" and "bob@" not in text[4] and text[4].endswith("[EMAIL]")
    assert not any(x in text[3] for x in ("ann@", "1234567", "10.0.0.1", "4111"))
    s = pii.scan(d)
    assert {len(r.found) for r in s.where("doc_id = 3").collect()} == {4} and "dk" in s.columns
    assert pii.scan(d.limit(0)).count() == 0



def terms_of(text):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return [(low(m[0]), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text or "")]


def ents_of(text):
    out = set()
    for k, s, e in brute.pii(text):
        m = text[s:e].lower()
        digits = regex.sub("[^0-9]", "", m)
        out |= {("entity", k, m), ("group", k, m.split("@")[-1] if k == 0 else ".".join(m.split(".")[:3]) if k == 1 else digits[:6])}
    return out


def told(texts):
    """Of each text the spans of its disclosing terms."""
    n, df, both = Counter(), Counter(), Counter()
    for t in texts:
        words = {w for w, *_ in terms_of(t)}
        df.update(words)
        for e in ents_of(t):
            n[e] += 1
            both.update((e, w) for w in words)
    best = defaultdict(dict)
    for (e, w), c in both.items():
        z, p, d = pii.Z, c / df[w], df[w]
        low = (p + z * z / (2 * d) - z * math.sqrt(p * (1 - p) / d + z * z / (4 * d * d))) / (1 + z * z / d)
        if n[e] < len(texts) and low > 0 and math.log2(low * len(texts) / n[e]) >= pii.GAIN and -math.log2(low) <= pii.GENERALISE:
            best[e][w] = 4 if -math.log2(low) <= pii.REMOVE else 5
    out = []
    for t in texts:
        mine, spans = {}, []
        for e in ents_of(t):
            for w, k in best[e].items():
                mine[w] = min(k, mine.get(w, 9))
        base = brute.pii(t)
        for w, s, e in terms_of(t):
            if w in mine and not any(a < e and s < b for _, a, b in base):
                spans.append((s, e, mine[w]))
        out.append(spans)
    return out


def test_terms_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: s for d, s in zip(docs, told([d.text for d in docs]))}
    got = {r.doc_id: [tuple(t) for t in r.terms] for r in pii.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == want and any(want.values())


def test_same_verdict_in_any_corpus(spark):
    """A term of one document, of five, of a tenth of an entity's, for corpora of 10^3 to 10^9 documents."""
    cases = [(1, 1, 1, 5), (2, 2, 2, 5), (5, 5, 5, 4), (40, 40, 40, 4), (1, 2, 1, None), (1, 10, 1, None), (1, 10, 5, None), (10, 100, 10, None), (30, 100, 30, 5), (60, 100, 60, 4)]
    for n_docs in (10**3, 10**5, 10**7, 10**9):
        d = spark.createDataFrame(cases, "c long, df long, n long, want int")
        assert all(r.k == r.want for r in d.select("want", pii.verdict(F.col("c"), F.col("df"), F.col("n"), n_docs).alias("k")).collect())


@pytest.mark.parametrize("others", [50, 1000])
def test_planted_person_among_others(spark, others):
    rows = [(i, f"common words w{i % 7} of all") for i in range(others)] + [(-1, "zorblatt ann@x.example common words")] + [(-2 - i, f"quux common boss@y{i}.example boss@firm.example") for i in range(6)]
    got = {r.doc_id: {(r.text[t.s : t.e], t.k) for t in r.terms} for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[-1] == {("zorblatt", 5)} and all(got[-2 - i] == {("quux", 4)} for i in range(6)) and not got[0]


def test_pages_of_many_entities(spark, monkeypatch):
    """Entities of the same documents count as one; documents of many classes and terms are dealt out in parts."""
    monkeypatch.setattr(pii, "MANY_PAIRS", 20)
    monkeypatch.setattr(pii, "PART", 3)
    page = " ".join(f"u{i}@h{i}.example" for i in range(40)) + " rare words of this page " + " ".join(f"t{i}" for i in range(50))
    rows = [(0, page), (0, page), (1, page + " u1@h1.example"), (2, "u3@h3.example rare"), (3, "nothing t1 t2"), (4, None)] + [(10 + i, "nothing of this") for i in range(30)]
    got = sorted((r.doc_id, [tuple(t) for t in r.terms]) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, s) for (d, _), s in zip(rows, told([t for _, t in rows])))
    held, n = pii._classed(pii._held(pii._keyed(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("found", pii.entities(F.col("_text")))), 2.0)
    assert n.count() == 2 and max(r.s for r in held.select(F.size("ents").alias("s")).collect()) == 2
