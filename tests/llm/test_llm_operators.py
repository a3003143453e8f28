import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from thalassa.llm import leaks, licenses, pii, quotes, registry, rnn, secrets, topk, toxicity  # noqa: E402

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def rows(spark, name):
    return registry.queries()[name](spark, DIR).collect()


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]


def test_secrets_base(spark, texts):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows(spark, "op2_secret_scan")}
    assert got == {k: brute.secrets_row(t) for k, t in texts.items()}


def test_pii_base(spark, texts):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows(spark, "op3_pii_sanitisation")}
    assert got == {k: brute.pii_row(t) for k, t in texts.items()}


def test_lm_base_counts_and_gain(spark, texts):
    import zlib

    train = [t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*words(t), None])
    n = sum(c.values())
    got = {r.doc_id: r for r in rows(spark, "op4_recurrent_lm")}
    assert len(got) == len(texts)
    for k, t in texts.items():
        tok = [*words(t), None]
        want = sum(np.log10((c[w] + 1) / (n + len(c) + 1)) for w in tok)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok), sum(c[w] > 0 for w in tok), n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_outputs_sum_to_one_and_carry_state():
    m = rnn.Gru(np.arange(rnn.VOCABULARY + 1, 0, -1.0))
    h = np.random.default_rng(0).normal(size=(1, rnn.HIDDEN)).astype(np.float32)
    y = np.arange(rnn.VOCABULARY + 1)
    lp, _ = m.outputs(np.repeat(h, len(y), 0), y)
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-4)
    place = np.random.default_rng(1).integers(0, rnn.VOCABULARY + 1, 3 * rnn.SCORE_WINDOW)
    state, want = np.zeros((1, rnn.HIDDEN), np.float32), []
    for t, y in enumerate(place):
        state = m.step(np.array([place[t - 1] if t else 0]), state)[0]
        want.append(m.outputs(state, np.array([y]))[0][0])
    assert np.allclose(m.score(place, np.array([0, len(place)])), want, atol=1e-4)


def test_lm_trains_on_all_texts(spark, docs):
    m = rnn.Gru(np.ones(rnn.VOCABULARY + 1))
    before = m.flat()
    assert m.train(np.array([5, 6, 7, 0], np.int32), 0.01) == 4
    assert not np.array_equal(before, m.flat())
    train = docs.where("doc_id < 300").select("doc_id", "text").repartition(7)
    _, total, _, counts = rnn.counted(train)
    assert rnn.fit(train, counts).seen == total


def test_lm_rare_words_have_places(spark, docs):
    all_, total, distinct, counts = rnn.counted(docs.select("doc_id", "text"))
    w = all_.toPandas()
    c, place = counts.look(w["w"].to_numpy(np.int64).view(np.uint64))
    assert (c == w["c"]).all()
    tail = place >= rnn.VOCABULARY
    assert len(set(place[tail])) > distinct**0.5 / 2
    assert counts.mass.sum() == total
    share = np.bincount(place[tail] - rnn.VOCABULARY, (c[tail] + 1) / counts.rest[place[tail] - rnn.VOCABULARY], counts.buckets)
    assert np.allclose(share + 1 / counts.rest, 1)  # and one for unseen words


def test_topk_brute(spark):
    v = [(i, [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(3).normal(size=(450, 8)).astype(np.float32))]
    v += [(7, v[0][1]), (900, None), (901, [float("nan")] * 8), (100, v[5][1])]
    got = topk.exact_topk(spark.createDataFrame(v, "vec_id long, embedding array<float>")).collect()
    ok = [(i, np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in v if e is not None and np.isfinite(e).all()]
    want = []
    for a, (i, e) in enumerate(ok):
        if i % 100 == 0:
            s = sorted((-int(e @ f), j) for b, (j, f) in enumerate(ok) if a != b)[:10]
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_toxicity_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    got = [r for r in rows(spark, "op6_toxicity") if r.held_out and r.doc_id in toxic]
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in got]) >= 0.97


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(d, none) is None
    assert [r.toxic_score for r in toxicity.score(d, None).collect()] == [0.0] * 3


def test_toxicity_same_epochs_for_all_sizes():
    for n in (100, 5000):
        m = toxicity.FactorizationMachine(np.arange(4))
        m.fit(np.arange(n) % 4, np.arange(n + 1), np.arange(n) % 2, epochs=8)
        assert m.steps == 8 * n


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_leaks_brute(spark, texts):
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    want = set()
    for k, t in texts.items():
        w = words(t)
        mine = set(shingles(w))
        for i, x in items.items():
            s = shingles(x)
            if not mine & set(s):
                continue
            for b in range(max(1, len(w) - len(x) + 1)):
                o = shingles(w[b : b + len(x)])
                if sum((o & s).values()) >= 0.8 * sum((o | s).values()):
                    want.add((k, i))
    assert {(r.doc_id, r.item_id) for r in rows(spark, "op7_decontamination")} == want


def test_leaks_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c d e f g h", 0), (3, "a b c d e f g h", 0), (4, "x A B c d e f G h y", 0)], "doc_id long, text string, similarity int")
    items = spark.createDataFrame([(9, "a b c d e f g h"), (8, "a b"), (7, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()} == {(3, 9), (4, 9)}
    assert [r.doc_id for r in leaks.decontaminate(docs, items).orderBy("doc_id").collect()] == [1, 2]
    assert leaks.leaks(docs, items.limit(0)).count() == 0


def test_licenses(spark, texts):
    got = {r.doc_id: r.licenses for r in rows(spark, "op10_license_scan")}
    for k, t in texts.items():
        for name, notes in licenses.TEMPLATES.items():
            if any(" ".join(words(n)) in " ".join(words(t)) for n in notes):
                assert name in got[k].split(",")


def test_licenses_edges(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "so: released  under the\nMIT license. ok", 3)], "doc_id long, text string, licenses0 int")
    assert [[x.name for x in r.licenses] for r in licenses.scan(d).orderBy("doc_id").collect()] == [[], [], ["MIT"]]


def test_licenses_of_other_list(spark, texts):
    notes = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "licensed under a CC BY-NC-SA 4.0 license.": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "Released under the BSD 2-Clause License.": "BSD-2-Clause",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "you are free to use it": "",
    }
    d = spark.createDataFrame([(i, f"so it is. {t} And more of it.") for i, t in enumerate(notes)], "doc_id long, text string")
    assert [",".join(x.name for x in r.licenses) for r in licenses.scan(d).orderBy("doc_id").collect()] == list(notes.values())
    got = {r.doc_id: r.licenses for r in rows(spark, "op10_license_scan")}
    for k, t in texts.items():
        if "Licensed under CC BY-NC 4.0." in (t or ""):
            assert "CC-BY-NC-4.0" in got[k].split(",")


@pytest.fixture(scope="module")
def told(spark):
    """Sanitised texts: 400 of common words, one person's document with a hapax near and one far, an office's in 100, a copy of each."""
    rng = np.random.default_rng(4)
    fill = lambda n: " ".join(f"common{chr(97 + i)}" for i in rng.integers(0, 20, n))
    d = [(i, fill(60)) for i in range(400)]
    d += [(400, f"Zorblatt here: ann@x.example {fill(100)}. {fill(100)}\n\nthe quuxite of it"), (401, f"the frobnitz {fill(60)}")]
    d += [(500 + i, f"{fill(40)} deskword {fill(40)} office@y.example") for i in range(100)]
    return {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(d, "doc_id long, text string")).collect()}


def test_pii_terms_of_one_document(told):
    assert "Zorblatt" not in told[400] and "ann@" not in told[400]
    assert "frobnitz" in told[401]  # no entity there to protect


def test_pii_spans_hold_all_terms(spark):
    got = rows(spark, "op3_pii_sanitisation")
    assert sum(r.n_terms for r in got) > 0
    assert all(sum(x.split(":")[0] in ("remove", "general") for x in r.spans.split(",")) == r.n_terms for r in got)


def test_pii_terms_of_hot_entity(told):
    assert not any("deskword" in told[500 + i] for i in range(100))


def test_pii_terms_far_from_entity(told):
    assert "quuxite" not in told[400]
    assert all(f"common{c}" in told[400] for c in "abcdefghij")


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there all.\nHow do we run it?"),
        (1, 1, "v", "On Monday u wrote:\n> Hello there all.\n> How do we run it?\n\nUse the script."),
        (1, 2, "u", "> On Monday u wrote:\n>> how do we run it?\n> Use the script.\nThanks"),
        (1, 2, "u", None),
        (2, 5, "w", "> use THE script\nno"),
        (None, 1, "x", "> use the script"),
    ]
    got = {(r.conv_id, r.turn, r.text): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6
    a, b, c, d = (got[r[0], r[1], r[3]] for r in (rows[1], rows[2], rows[4], rows[5]))
    assert (a.reply, a.parent_turn, a.depth, a.max_level) == ("Use the script.", 0, 1, 1)
    assert (b.reply, b.parent_turn, b.thread_turn, b.depth, b.max_level) == ("Thanks", 1, 0, 2, 2)
    assert (c.parent_conv, c.parent_turn, c.depth) == (1, 1, 0)
    assert d.parent_turn is None


def test_random_tokens_without_digits(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    d = [(i, f"the key is {''.join(rng.choice(letters, 48))} and no more") for i in range(40)]
    d += [(100 + i, "an internationalisation-of-the-interoperability of Donaudampfschifffahrtsgesellschaft") for i in range(40)]
    got = {r.doc_id: [x.k for x in r.secrets] for r in secrets.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert sum(got[i] == [3] for i in range(40)) >= 30
    assert all(got[100 + i] == [] for i in range(40))


def test_quotes_of_least_owner(spark):
    rows = [(1, 0, "> the shared passage\nyes"), (1, 1, "the shared passage"), (4, 3, "the shared passage"), (3, 2, "the shared passage"), (3, 1, "> The shared passage\nno")]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 0] == (3, 2)
    assert got[3, 1] == (1, 1)
    assert got[4, 3] == (None, None)


def test_redact_edges(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, 'x password="abcdef12" y', 0)], "doc_id long, text string, n_chars long")
    assert [r.text for r in secrets.redact(d).orderBy("doc_id").collect()][:2] == [None, ""]
    assert "abcdef12" not in secrets.redact(d).where("doc_id = 3").first().text
