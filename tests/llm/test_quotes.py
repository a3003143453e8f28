import numpy as np
import pytest

from thalassa.llm import quotes

SCHEMA = "conv_id long, turn long, text string"


def brute(rows):
    """(parent_conv, parent_turn, n_linked, thread_turn, depth) per (conv_id, turn), by search over all messages."""
    own, quoted = {}, {}
    for c, t, x in rows:
        parts = quotes.passages(quotes.parse(x or ""))
        own.setdefault((c, t), set()).update(k for k, _, _ in quotes.keys(parts, True))
        quoted.setdefault((c, t), {}).update({(k, level): n for k, level, n in quotes.keys(parts, False)})
    parent, linked = {}, {}
    for (c, t), held in quoted.items():
        votes, n = {}, 0
        for (k, level), words in held.items():
            here = [u for (d, u), keys in own.items() if d == c and k in keys]
            far = sorted((d, u) for (d, u), keys in own.items() if d != c and k in keys)
            if here and min(here) < t:
                source = (c, min(here))
            elif far:
                source = far[0]
            else:
                continue
            votes.setdefault((level, source), [0])[0] += words
        n = len(votes)
        if votes:
            (level, source), _ = max(votes.items(), key=lambda v: (-v[0][0], v[1][0], v[0][1][0] == c, v[0][1][1], v[0][1][0]))
            parent[c, t], linked[c, t] = source, n
    out = {}
    for m in own:
        top, depth = m, 0
        while top in parent and parent[top][0] == top[0]:
            top, depth = parent[top], depth + 1
        out[m] = (*parent.get(m, (None, None)), linked.get(m, 0), top[1], depth)
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_links_and_threads_brute(spark, monkeypatch, hot):
    """hot = 2: passages quoted often take the broadcast way."""
    monkeypatch.setattr(quotes, "HOT", hot)
    rng = np.random.default_rng(hot)
    rows, said = [], []
    common = "this very passage is quoted by a great many messages"
    for c in range(12):
        mine = []
        for t in range(30):
            body = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"], 6)) + f" {rng.integers(0, 40)}"
            text = body
            if mine and rng.random() < 0.6:
                text = f"> {mine[rng.integers(len(mine))]}\n\n{text}"
            if said and rng.random() < 0.3:
                text = f">> {said[rng.integers(len(said))]}\n{text}"
            if rng.random() < 0.5:
                text = f"> {common}\n{text}"
            if c == 3 and t == 0:
                text = f"{common}\n\n{text}"
            rows.append((c, t, text))
            mine.append(body), said.append(body)
    got = quotes.link(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.parent_conv, r.parent_turn, r.n_linked, r.thread_turn, r.depth) == want[r.conv_id, r.turn]


def test_edges(spark):
    long_ = "> " + "word " * 60_000 + "\nyes"
    rows = [(1, 0, "word " * 60_000, 5, "x"), (1, 1, long_, 5, "x"), (1, 1, long_, 5, "x"), (2, 0, None, 5, "x"), (2, 1, "", 5, "x"), (None, 1, "> a b", 5, "x"), (3, None, "> a b", 5, "x")]
    d = spark.createDataFrame(rows, SCHEMA + ", reply int, _c string")
    got = quotes.link(d).collect()
    assert len(got) == 7 and all(r["_c"] == "x" for r in got)
    assert sorted(r.reply for r in got if r.conv_id == 1 and r.turn == 1) == ["yes", "yes"]
    assert [r.parent_turn for r in got if r.conv_id == 1 and r.turn == 1] == [0, 0]
    assert quotes.link(d.limit(0)).count() == 0
    assert [(r.conv_id, r.turn) for r in quotes.conversations(d.where("turn IS NOT NULL AND conv_id IS NOT NULL")).collect()] == [(1, 0), (1, 1), (1, 1), (2, 0), (2, 1)]
