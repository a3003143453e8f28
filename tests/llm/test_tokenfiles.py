import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from thalassa.llm import tokenfiles

DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t", "Hello  World", "it's I'LL x y z", "ΣΑΣ Σ ΌΣΟΣ", "é ́x café", "a<|endoftext|>b <|startoftext|> c", "日本語 テキスト 123456 ½ ²",
    "x" * 5000, "\x00\x1f\x85 ​", "İstanbul ǅ ẞ ﬁ", "don't can't'll 've", "👍🏽 👨‍👩‍👧 !!!???", "　", "a\x0bb\x0cc\rd",
]


def brute(rows, tokenizer, end=2):
    """(doc_id, start, n, ids) in order of doc_id."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), ids))
        at += len(ids)
    return out


def test_query_equals_library(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (s, n, zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, n, i in brute(rows, Tokenizer.from_file(WORDS))}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.query(spark, DIR).collect()}
    assert got == want


PARTS = [
    "don't 's 'S x's y'sfoo 5's ,'s ''s '' ' a'", "é's 's. …'s, Ábc á 1́ .́x", "<|EndOfText|> a<|endoftext|>b", "<|startoftext|", "abc123def45.6,7;x--y__z", "x\x00y\x1cz\x7f0",
    "K K ſ S's ’s l'll", "3rd (a)b]c{d}e'f 'll'll 1'2'3",
]


@pytest.mark.parametrize("parts", ["text", "space", "class"])
def test_parts_encode_as_texts(parts, monkeypatch):
    """Also parts met again, and those beyond the kept ones."""
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("aZ'’é́ .,<|0x9\x1f\x85日ß"), 200)) for _ in range(200)]
    plain = Tokenizer.from_file(WORDS)
    for texts in (ODD, PARTS, noise):
        encoder = tokenfiles.Encoder(open(WORDS, encoding="utf-8").read(), parts)
        for kept in (1 << 17, 5):
            monkeypatch.setattr(tokenfiles, "KEPT_WORDS", kept)
            (ids, n), = encoder.encode(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(encoder.encode(pa.array([], pa.string()))) == []
    with pytest.raises(ValueError):
        tokenfiles.Encoder(open(WORDS, encoding="utf-8").read(), "letter")


@pytest.mark.parametrize("name, parts, length, per_batch", [("word_bpe_49k.json", "class", 16, 3), ("byte_bpe_50k.json", "text", 8, 2), ("word_bpe_49k.json", "space", 1 << 16, 1)])
def test_round_trip(spark, tmp_path, name, parts, length, per_batch):
    path = public_tokenizers.path(name)
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 5)] + [(None, "last of all")]
    folder = f"file://{tmp_path}/out"
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, h string, part int").repartition(6)
    files = tokenfiles.write(table, folder, path, 2, parts, length, per_batch)
    want = brute(rows, Tokenizer.from_file(path))
    got = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfiles.read_documents(spark, folder).collect())
    assert got == [(s, d, n, i) for d, s, n, i in want]
    parts = files.orderBy("part").collect()
    assert sum(p.n_docs for p in parts) == len(rows)
    # random access, by number, to what a scan gives
    stream, opened = [i for *_, x in want for i in x], tokenfiles.TokenFolder(folder)
    seen = {r.sequence: (r.ids, r.mask) for r in tokenfiles.read_sequences(spark, folder).collect()}
    assert len(opened) == len(seen) == sum(p.n_sequences for p in parts) == sum(-(-p.n_tokens // length) for p in parts)
    for p in parts:
        tokens = stream[p.start : p.start + p.n_tokens]
        for i in reversed(range(p.n_sequences)):
            ids, mask = opened[p.first_sequence + i]
            x = tokens[i * length : (i + 1) * length]
            assert ids.tolist() == x + [0] * (length - len(x)) == seen[p.first_sequence + i][0]
            assert np.unpackbits(mask, bitorder="little").tolist() == [1] * len(x) + [0] * (length - len(x)) == seen[p.first_sequence + i][1]
    for i in (-1, len(opened)):
        with pytest.raises(IndexError):
            opened[i]


def test_no_copy(spark, tmp_path):
    table = spark.createDataFrame([(i, "some words here " * 50) for i in range(100)], "doc_id long, text string")
    tokenfiles.write(table, str(tmp_path / "out"), WORDS, 2, "class", 32, 4)
    folder = tokenfiles.TokenFolder(str(tmp_path / "out"))
    ids, mask = folder[len(folder) // 2]
    part = next(iter(folder.open.values()))
    part.source.seek(0)
    base, size = part.source.read_buffer(8).address, part.source.size()
    assert ids.dtype == np.uint16 and mask.dtype == np.uint8 and not ids.flags.owndata
    before = pa.total_allocated_bytes()
    held = [folder[i] for i in range(len(folder))]
    assert pa.total_allocated_bytes() - before < 4096 * len(folder.open) + 1024 and len(held) == len(folder)
    assert all(base <= a.__array_interface__["data"][0] < base + size for a in (ids, mask))


def test_repeated_rows_and_failed_attempts(spark, tmp_path):
    """Copies of one row are spread over parts; files that no table lists are not read."""
    rows = [(5, "copy of a row")] * 3000 + [(4, "b"), (6, None), (5, "another")]
    folder = str(tmp_path / "out")
    files = tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, WORDS, 2, "class")
    (tmp_path / "out" / "part-000000-lost.arrow").write_bytes(b"half a fi")
    got = tokenfiles.read_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [4] + [5] * 3001 + [6] and got[-1].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert files.count() >= 1


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), folder, WORDS, 2).count() == 0
    assert tokenfiles.read_documents(spark, folder).count() == tokenfiles.read_sequences(spark, folder).count() == len(tokenfiles.TokenFolder(folder)) == 0
