"""Records of instrument files by byte range: a file is read by many tasks, at any split size with the same rows.

A record is whole where its header is in place and its checksum holds; that depends on its bytes alone. Records whose
bytes overlap make an island, in which the first counts, then the next that begins after its end, and so on; this is
what reading from the start of the file gives, since no record reaches over the edge of an island. A task owns the
islands that begin in its range. Looking back by the longest record tells it which do. Headers outside all whole records
whose checksum fails, or that are cut off by the end of the file, are damaged records: they are counted and skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import files

SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


class Framing:
    """Where records stand. longest: the most bytes of a record."""

    longest: int

    def headers(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, size) of all headers whose first bytes are in data."""
        raise NotImplementedError

    def whole(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of these records, all of whose bytes are in data, have a checksum that holds."""
        raise NotImplementedError


def first_of_islands(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the sorted records begin an island."""
    reach = np.maximum.accumulate(at + size)
    return np.append(True, at[1:] >= reach[:-1])[: len(at)]


def counted(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the sorted records count: of each island the first, then those that begin after the end of the last counted."""
    first = first_of_islands(at, size)
    out = first.copy()
    starts = np.flatnonzero(first)
    for i, j in zip(starts, np.append(starts[1:], len(at)), strict=True):
        if j - i > 1:
            end = at[i] + size[i]
            for k in range(i + 1, j):
                if at[k] >= end:
                    out[k] = True
                    end = at[k] + size[k]
    return out


def records(framing: Framing, read, length: int, lo: int, hi: int) -> tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, their place, places and sizes of the records that count, places of damaged headers) of islands that begin in lo to hi."""
    begin, after = max(0, lo - framing.longest), 2 * framing.longest
    while True:
        end = min(length, hi + after)
        data = read(begin, end - begin)
        raw = np.frombuffer(data, np.uint8)
        at, size = framing.headers(raw)
        fits = at + size <= len(raw)
        ok = np.zeros(len(at), bool)
        ok[fits] = framing.whole(raw, at[fits], size[fits])
        good, sizes = at[ok], size[ok]
        first = first_of_islands(good, sizes)
        own = first & (good + begin >= lo) & (good + begin < hi)
        # the island that the last own record begins reaches up to the next first one
        island = np.cumsum(first) - 1
        owned = own[np.flatnonzero(first)][island] if len(good) else own
        reach = int((good[owned] + sizes[owned]).max(initial=0)) + begin
        if end == length or reach <= end - framing.longest:
            break
        after *= 2
    cover = np.maximum.accumulate(good + sizes) if len(good) else good
    bad = at[~ok]
    before = np.searchsorted(good, bad, "right") - 1
    inside = (before >= 0) & (cover[np.maximum(before, 0)] > bad) if len(good) else np.zeros(len(bad), bool)
    bad = bad[~inside & (bad + begin >= lo) & (bad + begin < hi)]
    keep = owned & counted(good, sizes) if len(good) else owned
    return data, begin, good[keep], sizes[keep], bad + begin


def gathered(data: bytes, at: np.ndarray, size: int) -> np.ndarray:
    """Records of one size as the rows of a matrix of bytes."""
    raw = np.frombuffer(data, np.uint8)
    return raw[at[:, None] + np.arange(size)]


def field(rows: np.ndarray, at: int, kind: str, n: int = 1) -> np.ndarray:
    """n numbers from byte `at` of each row; one as a vector."""
    width = np.dtype(kind).itemsize * n
    out = np.ascontiguousarray(rows[:, at : at + width]).view(kind)
    return out[:, 0] if n == 1 else out


def nested(values: np.ndarray) -> pa.Array:
    """A matrix or cube as lists, or lists of lists, of its last dimensions; NaN is null."""
    flat = values.reshape(-1)
    out = pa.array(flat, from_pandas=flat.dtype.kind == "f")
    for d in range(values.ndim - 1, 0, -1):
        lists = int(np.prod(values.shape[:d]))
        out = pa.ListArray.from_arrays(np.arange(lists + 1, dtype=np.int32) * values.shape[d], out)
    return out


class Split(InputPartition):
    def __init__(self, path: str, length: int, lo: int, hi: int):
        self.path, self.length, self.lo, self.hi = path, length, lo, hi


class FrameSource(DataSource):
    """A format of records. Options: path (a file, a folder, or a pattern of names), splitBytes."""

    framing: Framing

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self, schema)

    def decoded(self, data: bytes, begin: int, at: np.ndarray, size: np.ndarray, bad: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        """Columns of the records; `pos` is each one's place in the file."""
        raise NotImplementedError


class FrameReader(DataSourceReader):
    def __init__(self, source: FrameSource, schema: StructType):
        self.source, self.schema = source, schema
        self.path = source.options["path"]
        self.split = int(source.options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        return [Split(p, n, lo, min(n, lo + self.split)) for p, n in files.listed(self.path) for lo in range(0, n, self.split)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        fs, at = files.filesystem(part.path)
        with fs.open_input_file(at) as file:
            read = lambda lo, n: file.read_at(n, lo)
            for lo in range(part.lo, part.hi, BLOCK_BYTES):
                found = records(self.source.framing, read, part.length, lo, min(part.hi, lo + BLOCK_BYTES))
                for columns in self.source.decoded(*found):
                    n = len(columns["pos"])
                    whole = lambda f: pa.array([part.path] * n) if f.name == "file" else columns[f.name] if f.name in columns else pa.nulls(n, f.type)  # noqa: B023, E731
                    yield pa.record_batch([whole(f).cast(f.type) for f in schema], schema=schema)
