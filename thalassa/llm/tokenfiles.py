"""Token ids of documents in Arrow files of equal-length sequences.

A folder holds for each part, i.e. each range of doc_id,

- `part-*.arrow`: the ids of its documents, one after the other, each with the end id, cut into sequences of `length`.
  Columns `ids` (fixed-size list of uint16, or of uint32 where the vocabulary needs it) and `mask` (fixed-size list of
  bits: 1 for a token, 0 for the padding of the part's last sequence; `length` is a multiple of 8). Every record batch but the last has `per_batch`
  sequences, so sequence i is row i % per_batch of batch i // per_batch, and a memory map gives it without a copy;
- `part-*.docs.arrow`: doc_id, start (within the part) and n_tokens of its documents;

and `files.parquet`, written last: one row per part with its names, counts, and the ids and sequences before it. Names
hold a random part and only parts in that table count, so attempts of tasks that failed leave nothing that is read.
Parts are written by the tasks of one range sort; the only sum over all of them is over one row per part.

Cases: a null text is empty, an empty text has the end id only. Documents go by doc_id, null ones last, those of equal
doc_id by a hash of the text; repeated rows are documents of their own, and many copies of one row are spread over parts.
A long text spans sequences. An empty table gives a folder without parts. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import native, scratch, textnum

LENGTH, PER_BATCH = 2048, 128
#: Bytes of texts that are encoded together, and words from which on a worker keeps the ids of no more.
SLICE_BYTES, KEPT_WORDS = 8 << 20, 1 << 17
OUT_IDS = 1 << 20
_FILES = "part int, file string, docs string, n_docs long, n_tokens long, n_sequences long"
_encoders: dict[tuple, Encoder] = {}

# Classes of bytes: 0 is white space or beyond ASCII. Cuts are made between two of ASCII, but not within letters or others.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, _LETTER, _DIGIT
_CLASS[textnum._SPACE] = 0
_LETTERS = re.compile("[a-z]+")
_CUTS = np.zeros((4, 4), bool)
_CUTS[1:, 1:] = True
_CUTS[_LETTER, _LETTER] = _CUTS[_OTHER, _OTHER] = False


def filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if ":" not in folder.split("/")[0]:
        return pa.fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


class Encoder:
    """Ids of texts by a vocabulary file of the tokenizers library.

    parts says what a text may be cut into so that distinct parts are encoded once: "text", itself; "space", words, for
    vocabularies whose white space only parts words and leaves no token; "class", besides, runs of ASCII letters, single
    ASCII digits and runs of others in one case, for vocabularies that also set these apart and lower the case. A part
    never ends within a contraction ('s), beside a letter beyond ASCII, or within a special token.
    """

    def __init__(self, vocabulary: str, parts: str):
        if parts not in ("text", "space", "class"):
            raise ValueError(f"parts of kind {parts}")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_str(vocabulary), parts
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # parts of letters that reach the model as they are need not pass what stands before it
        before, word = self.tokenizer.pre_tokenizer, "abcxyz"
        as_is = parts == "class" and before is not None and [w for w, _ in before.pre_tokenize_str(word)] == [word]
        self.model = self.tokenizer.model if as_is else None
        # kept words: their place among runs of ids
        self.known: dict[str, int] = {}
        self.runs, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, key: str, vocabulary: str, parts: str) -> Encoder:
        """One per worker process."""
        if (key, parts) not in _encoders:
            _encoders[key, parts] = cls(vocabulary, parts)
        return _encoders[key, parts]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each)."""
        if self.model is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            letters = [_LETTERS.fullmatch(t) is not None for t in texts]
            others = iter(self.tokenizer.encode_batch_fast([t for t, own in zip(texts, letters, strict=True) if not own], add_special_tokens=False))
            tokenize = self.model.tokenize
            found = [[x.id for x in tokenize(t)] if own else next(others).ids for t, own in zip(texts, letters, strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of runs of whole texts, in order."""
        for lo, data, offsets in textnum.slices(column, SLICE_BYTES):
            if self.parts == "text":
                yield self._encoded([t or "" for t in column.slice(lo, len(offsets) - 1).to_pylist()])
            else:
                yield self._in_parts(data, offsets)

    def _in_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = textnum.bounds(data, offsets)
        solid = ~textnum._SPACE[data]
        if self.parts == "class":
            low = textnum._LOWER[data]
            plain = low.tobytes()
            if not any(s in plain for s in self.special):
                data = low
                before, after = _CLASS[data[:-1]], _CLASS[data[1:]]
                cut = _CUTS[before, after] & ~((data[:-1] == ord("'")) & (after == _LETTER))
                at = np.flatnonzero(cut) + 1
                at = at[~np.isin(at, offsets)] if len(at) else at
                starts, ends = (np.sort(np.append(x, at)) for x in (starts, ends))
        cut = np.append(0, np.cumsum(ends - starts))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(data[solid].tobytes())).dictionary_encode()
        distinct, known = words.dictionary.to_pylist(), self.known
        place = np.fromiter((known.get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        new = [distinct[i] for i in missing]
        found, n = self._encoded(new)
        place[missing] = len(self.runs) - 1 + np.arange(len(new))
        runs, ids = np.append(self.runs, self.runs[-1] + np.cumsum(n)), np.append(self.ids, found)
        if len(known) < KEPT_WORDS:
            known.update(zip(new, place[missing].tolist(), strict=True))
            self.runs, self.ids = runs, ids
        at = place[words.indices.to_numpy()]
        n, first = runs[at + 1] - runs[at], runs[at]
        total = np.append(0, np.cumsum(n))
        return ids[np.repeat(first - total[:-1], n) + np.arange(total[-1])], np.diff(total[np.searchsorted(starts, offsets)])


def _ended(ids: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """ids with the end id after each text."""
    out = np.empty(len(ids) + len(n), np.uint32)
    last = np.cumsum(n + 1) - 1
    mask = np.ones(len(out), bool)
    mask[last] = False
    out[last], out[mask] = end, ids
    return out


class PartWriter:
    """One part: sequences as they fill up, documents at the end."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int, per_batch: int):
        if length % 8:
            raise ValueError("a length that is no multiple of 8")
        self.fs, at = filesystem(folder)
        self.length, self.per_batch, self.dtype = length, per_batch, dtype
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.names = f"{name}.arrow", f"{name}.docs.arrow"
        self.paths = [f"{at}/{n}" for n in self.names]
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(dtype), length), "mask": pa.list_(pa.bool_(), length)})
        self.sink = self.fs.open_output_stream(self.paths[0])
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.n_tokens = self.n_sequences = 0
        self.docs: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        self.docs.append((doc_ids, n))
        self.rest.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.n_tokens += len(ids)
        full = self.length * self.per_batch
        if self.held >= full:
            flat = np.concatenate(self.rest)
            cut = len(flat) // full * full
            for lo in range(0, cut, full):
                self._batch(flat[lo : lo + full], full)
            self.rest, self.held = [flat[cut:].copy()], len(flat) - cut

    def _batch(self, flat: np.ndarray, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (flat, np.arange(len(flat)) < n)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(flat) // self.length

    def close(self) -> tuple[int, int, int]:
        if self.held:
            flat = np.concatenate(self.rest)
            self._batch(np.append(flat, np.zeros(-len(flat) % self.length, self.dtype)), len(flat))
        self.file.close()
        self.sink.close()
        n = np.concatenate([x for _, x in self.docs])
        table = pa.table({"doc_id": pa.concat_arrays([d for d, _ in self.docs]), "start": np.cumsum(n) - n, "n_tokens": n})
        with self.fs.open_output_stream(self.paths[1]) as sink, pa.ipc.new_file(sink, table.schema) as file:
            file.write_table(table, max_chunksize=1 << 16)
        return len(n), self.n_tokens, self.n_sequences


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, parts: str = "text", length: int = LENGTH, per_batch: int = PER_BATCH) -> DataFrame:
    """Write (doc_id, text) to the folder and return files.parquet.

    vocabulary: path of a file of the tokenizers library, read by the driver and sent to the tasks. parts: see Encoder.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    text = Path(vocabulary).read_text(encoding="utf-8")
    size = max(Encoder(text, parts).size, end_id + 1)
    dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
    sent = spark.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encoder = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            encoder = encoder or Encoder.of(vocabulary, sent.value, parts)
            writer = writer or PartWriter(folder, part, dtype, length, per_batch)
            lo, doc_ids = 0, b.column("doc_id")
            for ids, n in encoder.encode(b.column("text")):
                writer.add(doc_ids.slice(lo, len(n)), _ended(ids, n, end_id), n + 1)
                lo += len(n)
        if writer:
            n_docs, n_tokens, n_sequences = writer.close()
            file, of_docs = writer.names
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "docs": of_docs, "n_docs": n_docs, "n_tokens": n_tokens, "n_sequences": n_sequences}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.string()), *((n, pa.int64()) for n in ("n_docs", "n_tokens", "n_sequences"))]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), native.text_of("text").alias("text"))
    # the last key parts copies of one row
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("copy")]
    parts = scratch.materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order[:2], "text").select("doc_id", "text").mapInArrow(run, _FILES))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("n_tokens", "start"), ("n_sequences", "first_sequence"))])
    files.write.parquet(f"{folder}/files.parquet")
    scratch.drop(parts)
    return spark.read.parquet(f"{folder}/files.parquet")


class TokenFile:
    """Random access to the sequences of one part; of a local file without copies."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.n_batches = self.file.num_record_batches
        self.per_batch = self.file.get_batch(0).num_rows if self.n_batches else 1
        self.length = self.file.schema.field("ids").type.list_size

    def __len__(self) -> int:
        return (self.n_batches - 1) * self.per_batch + self.file.get_batch(self.n_batches - 1).num_rows if self.n_batches else 0

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all sequences of a record batch and the bits of their masks (eight to a byte, lowest first), as matrices."""
        b = self.file.get_batch(i)
        mask = b.column("mask").flatten()
        bits = np.frombuffer(mask.buffers()[1], np.uint8)[mask.offset // 8 : (mask.offset + len(mask)) // 8]
        return b.column("ids").flatten().to_numpy().reshape(-1, self.length), bits.reshape(-1, self.length // 8)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the bits of the mask of a sequence; np.unpackbits(bits, bitorder="little") gives a byte each."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        ids, mask = self.batch(i // self.per_batch)
        return ids[i % self.per_batch], mask[i % self.per_batch]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on: a view within a record batch, else put together."""
        full, out = self.length * self.per_batch, []
        while n:
            flat = self.batch(start // full)[0].reshape(-1)[start % full : start % full + n]
            out.append(flat)
            start, n = start + len(flat), n - len(flat)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


class TokenFolder:
    """Random access to all sequences of a folder by their number, e.g. for a training loop; parts open when needed."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        fs, at = filesystem(f"{self.folder}/files.parquet")
        table = pa.parquet.read_table(at, filesystem=fs).sort_by("part")
        self.names = table.column("file").to_pylist()
        self.ends = np.cumsum(table.column("n_sequences").to_numpy())
        self.open: dict[int, TokenFile] = {}

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        part = int(np.searchsorted(self.ends, i, "right"))
        if part not in self.open:
            self.open[part] = TokenFile(f"{self.folder}/{self.names[part]}")
        return self.open[part][i - (int(self.ends[part - 1]) if part else 0)]


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.parquet(f"{folder}/files.parquet")
    # by number, as a few small rows would be put into one task
    return files.repartitionByRange(max(1, files.count()), "part")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""
    scratch.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens = TokenFile(f"{folder}/{row['file']}")
                fs, at = filesystem(f"{folder}/{row['docs']}")
                with fs.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        start, n = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                        lo = 0
                        while lo < len(n):
                            # whole documents of about OUT_IDS ids
                            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + OUT_IDS)))
                            ids = tokens.tokens(int(start[lo]), int(n[lo:hi].sum())).astype("<u4")
                            cut = np.append(0, np.cumsum(n[lo:hi])) * 4
                            kind = (pa.LargeBinaryArray, np.int64) if cut[-1] >= 2**31 else (pa.BinaryArray, np.int32)
                            binary = kind[0].from_buffers(pa.large_binary() if kind[1] is np.int64 else pa.binary(), hi - lo, [None, pa.py_buffer(cut.astype(kind[1])), pa.py_buffer(ids)])
                            yield pa.record_batch({"doc_id": docs.column("doc_id").slice(lo, hi - lo), "start": start[lo:hi] + row["start"], "n_tokens": n[lo:hi], "ids": binary})
                            lo = hi
                tokens.close()

    return _parts(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """sequence (its number), ids array<int>, mask array<tinyint>: all sequences of the folder."""
    scratch.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens, at = TokenFile(f"{folder}/{row['file']}"), row["first_sequence"]
                for i in range(tokens.n_batches):
                    ids, mask = tokens.batch(i)
                    cut = np.arange(len(ids) + 1, dtype=np.int32) * tokens.length
                    mask = np.unpackbits(mask, axis=1, bitorder="little")
                    lists = [pa.ListArray.from_arrays(cut, a.reshape(-1).astype(kind)) for a, kind in ((ids, np.int32), (mask, np.int8))]
                    yield pa.record_batch({"sequence": np.arange(at, at + len(ids)), "ids": lists[0], "mask": lists[1]})
                    at += len(ids)
                tokens.close()

    return _parts(spark, folder).mapInArrow(run, "sequence long, ids array<int>, mask array<tinyint>")


#: The vocabulary, the end id, and what texts may be cut into for it.
VOCABULARY, END_ID, PARTS = "word_bpe_49k.json", 2, "class"


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch.root(spark)}/thalassa-tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, public_tokenizers.path(VOCABULARY), END_ID, PARTS)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
