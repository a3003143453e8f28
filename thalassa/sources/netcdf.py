"""Classic netCDF files (`netcdf3`: versions 1, 2 and 5) by slices of their leading dimension, and folders of them.

    spark.dataSource.register(netcdf.Classic)
    spark.read.format("netcdf3").option("dimension", "time").load(path)

One row per index of a dimension (by default that of records, else that of the first variable): file, the index under the
name `<dimension>_index`, and each variable that begins with the dimension, its further dimensions as nested arrays.
Variables of other dimensions come by a read of their own dimension; those of none, and attributes, by header(). Text is a
string over its last dimension. Values equal to `_FillValue` or `missing_value`, and NaN, are null; scale_factor and
add_offset are applied (option `raw` = true leaves counts as they are). A file is split by bytes (`splitBytes`) wherever an
index begins: tasks read records, or runs of each variable, of their own.

write() writes a DataFrame as a folder of files, one per task, along a dimension of records.

Cases: a file without records has no rows; a dimension that a file lacks is an error; nulls are written as the type's fill
value; rows of arrays of unequal shape are refused; unknown columns of a given schema are null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from . import files

# Fixed values of the format.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {1: -127, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 10: -9223372036854775806}
STREAMING = 0xFFFFFFFF

_SPARK = {1: ByteType(), 3: ShortType(), 4: IntegerType(), 5: FloatType(), 6: DoubleType(), 7: ShortType(), 8: IntegerType(), 9: LongType(), 10: LongType(), 11: LongType()}
_WRITTEN = {"tinyint": 1, "smallint": 3, "int": 4, "float": 5, "double": 6}
HEADER_BYTES = 1 << 16


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    size: int
    begin: int


@dataclass
class Header:
    records: int
    dimensions: list[tuple[str, int]]
    attributes: dict
    variables: list[Variable] = field(default_factory=list)

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dimensions[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> list[int]:
        """The further dimensions' lengths."""
        return [self.dimensions[d][1] for d in v.dims[1:]]

    def width(self, v: Variable) -> int:
        """Bytes of one index of the leading dimension."""
        return int(np.prod(self.shape(v), dtype=np.int64)) * np.dtype(KINDS[v.kind]).itemsize

    def record_bytes(self) -> int:
        mine = [v for v in self.variables if self.is_record(v)]
        # a single variable of records is not padded
        return self.width(mine[0]) if len(mine) == 1 else sum(-(-self.width(v) // 4) * 4 for v in mine)


class _Short(Exception):
    pass


def parsed(data: bytes, length: int) -> Header:
    """The header at the start of a file of that length."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a classic netCDF file")
    wide, far, at = data[3] == 5, data[3] != 1, 4

    def number(kind: str) -> int:
        nonlocal at
        n = np.dtype(kind).itemsize
        if at + n > len(data):
            raise _Short
        at += n
        return int(np.frombuffer(data, kind, 1, at - n)[0])

    count = lambda: number(">u8" if wide else ">u4")

    def padded(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise _Short
        at += -(-n // 4) * 4
        return data[at - -(-n // 4) * 4 :][:n]

    def name() -> str:
        return padded(count()).decode("utf-8")

    def many(tag: int, one) -> list:
        found, n = number(">u4"), count()
        if found not in (0, tag):
            raise ValueError("a damaged header")
        return [one() for _ in range(n)]

    def attribute():
        key, kind, n = name(), number(">u4"), count()
        raw = padded(n * np.dtype(KINDS[kind]).itemsize)
        return key, raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, KINDS[kind])

    def variable() -> Variable:
        key, dims = name(), [count() for _ in range(count())]
        marks, kind, size = dict(many(ATTRIBUTES, attribute)), number(">u4"), count()
        return Variable(key, dims, marks, kind, size, number(">u8" if far else ">u4"))

    records = count()
    out = Header(records, many(DIMENSIONS, lambda: (name(), count())), dict(many(ATTRIBUTES, attribute)))
    out.variables = many(VARIABLES, variable)
    if records == (2**64 - 1 if wide else STREAMING):
        first = min((v.begin for v in out.variables if out.is_record(v)), default=length)
        out.records = (length - first) // max(out.record_bytes(), 1)
    return out


def header(path: str) -> Header:
    fs, at = files.filesystem(path)
    with fs.open_input_file(at) as f:
        n, length = HEADER_BYTES, f.size()
        while True:
            try:
                return parsed(f.read_at(min(n, length), 0), length)
            except _Short:
                if n >= length:
                    raise ValueError("a header without end") from None
                n *= 4


def leading(h: Header, name: str | None) -> int:
    """The number of the dimension of that name, by default of records, else of the first variable."""
    names = [d for d, _ in h.dimensions]
    if name:
        if name not in names:
            raise ValueError(f"no dimension {name}")
        return names.index(name)
    unlimited = [i for i, (_, n) in enumerate(h.dimensions) if n == 0]
    return unlimited[0] if unlimited else next(v.dims[0] for v in h.variables if v.dims)


def _scaled(v: Variable, raw: bool) -> bool:
    return not raw and ("scale_factor" in v.attributes or "add_offset" in v.attributes)


def _type(h: Header, v: Variable, raw: bool) -> DataType:
    if v.kind == 2:
        out, nest = StringType(), max(0, len(v.dims) - 2)
    else:
        out, nest = DoubleType() if _scaled(v, raw) else _SPARK[v.kind], len(v.dims) - 1
    for _ in range(nest):
        out = ArrayType(out)
    return out


def _values(h: Header, v: Variable, cells: np.ndarray, raw: bool) -> pa.Array:
    """Rows of raw numbers (n, ...) as an Arrow array."""
    if v.kind == 2:
        shape = cells.shape if cells.ndim > 1 else (*cells.shape, 1)
        joined = np.ascontiguousarray(cells.reshape(shape)).view(f"S{max(shape[-1], 1)}").reshape(shape[:-1])
        out, shape = pa.array([t.decode("utf-8", "replace") for t in joined.reshape(-1)], pa.string()), joined.shape
    else:
        lost = np.isnan(cells) if cells.dtype.kind == "f" else np.zeros(cells.shape, bool)
        for mark in ("_FillValue", "missing_value"):
            if mark in v.attributes and len(v.attributes[mark]):
                lost |= np.isin(cells, v.attributes[mark].astype(cells.dtype))
        plain = cells.astype(cells.dtype.newbyteorder("="))
        if _scaled(v, raw):
            one = lambda key, default: float(v.attributes[key][0]) if key in v.attributes else default
            plain = plain.astype(float) * one("scale_factor", 1.0) + one("add_offset", 0.0)
        out, shape = pa.array(plain.reshape(-1), mask=lost.reshape(-1)), cells.shape
    for d in range(len(shape) - 1, 0, -1):
        out = pa.ListArray.from_arrays(np.arange(int(np.prod(shape[:d])) + 1, dtype=np.int32) * shape[d], out)
    return out


class Slice(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class Classic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _raw(self) -> bool:
        return self.options.get("raw", "false").lower() == "true"

    def schema(self) -> StructType:
        h = header(files.listed(self.options["path"])[0][0])
        d = leading(h, self.options.get("dimension"))
        own = [StructField(v.name, _type(h, v, self._raw())) for v in h.variables if v.dims and v.dims[0] == d]
        return StructType([StructField("file", StringType()), StructField(f"{h.dimensions[d][0]}_index", LongType()), *own])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema, self._raw())


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, raw: bool):
        self.path, self.dimension, self.schema, self.raw = options["path"], options.get("dimension"), schema, raw
        self.split = int(options.get("splitbytes", 64 << 20))

    def _plan(self, path: str) -> tuple[Header, int, list[Variable], int]:
        """Header, leading dimension, wanted variables, and its length."""
        h = header(path)
        d = leading(h, self.dimension)
        names = set(self.schema.fieldNames())
        return h, d, [v for v in h.variables if v.dims and v.dims[0] == d and v.name in names], h.dimensions[d][1] or h.records

    def partitions(self) -> list[Slice]:
        out = []
        for path, _ in files.listed(self.path):
            h, d, wanted, n = self._plan(path)
            one = h.record_bytes() if h.dimensions[d][1] == 0 else sum(map(h.width, wanted))
            step = max(1, self.split // max(one, 1))
            out += [Slice(path, lo, min(n, lo + step)) for lo in range(0, n, step)]
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        h, d, wanted, _ = self._plan(part.path)
        records, one = h.dimensions[d][1] == 0, h.record_bytes()
        width = one if records else sum(map(h.width, wanted))
        step = max(1, (4 << 20) // max(width, 1))
        fs, at = files.filesystem(part.path)
        with fs.open_input_file(at) as f:
            for lo in range(part.lo, part.hi, step):
                n = min(part.hi, lo + step) - lo
                columns = {"file": pa.array([part.path] * n), f"{h.dimensions[d][0]}_index": pa.array(np.arange(lo, lo + n))}
                if records and wanted:
                    first = min(v.begin for v in h.variables if h.is_record(v))
                    # the last record may end without its padding
                    block = f.read_at(one * n, first + one * lo)
                    rows = np.frombuffer(block.ljust(one * n, b"\0"), np.uint8).reshape(n, one)
                for v in wanted:
                    if records:
                        raw = np.ascontiguousarray(rows[:, v.begin - first : v.begin - first + h.width(v)])
                    else:
                        raw = np.frombuffer(f.read_at(h.width(v) * n, v.begin + h.width(v) * lo), np.uint8).reshape(n, -1)
                    columns[v.name] = _values(h, v, np.ascontiguousarray(raw).view(KINDS[v.kind]).reshape(n, *h.shape(v)), self.raw)
                yield pa.record_batch([columns[c.name].cast(c.type) if c.name in columns else pa.nulls(n, c.type) for c in schema], schema=schema)


def _name(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(4, "big") + raw.ljust(-(-len(raw) // 4) * 4, b"\0")


def file_header(dimension: str, records: int, columns: list[tuple[str, int, list[int]]], attributes: dict[str, dict[str, str]]) -> bytes:
    """The header (version 2) of variables of records: name, kind and the lengths of further dimensions."""
    u4 = lambda *v: b"".join(int(x).to_bytes(4, "big") for x in v)
    inner = [(f"{name}_{i}", n) for name, _, shape in columns for i, n in enumerate(shape)]
    dims = [(dimension, 0), *inner]
    number = {name: i for i, (name, _) in enumerate(dims)}
    listed = lambda tag, items: u4(tag if items else 0, len(items)) + b"".join(items)
    text = lambda key, value: _name(key) + u4(2) + _name(value)

    def built(begins: list[int]) -> bytes:
        variables = []
        for (name, kind, shape), begin in zip(columns, begins, strict=True):
            marks = [text(k, v) for k, v in attributes.get(name, {}).items()]
            marks.append(_name("_FillValue") + u4(kind, 1) + np.array([FILLS[kind]], KINDS[kind]).tobytes().ljust(4, b"\0"))
            ids = [0, *(number[f"{name}_{i}"] for i in range(len(shape)))]
            size = int(np.prod(shape, dtype=np.int64)) * np.dtype(KINDS[kind]).itemsize
            variables.append(_name(name) + u4(len(ids), *ids) + listed(ATTRIBUTES, marks) + u4(kind, -(-size // 4) * 4) + begin.to_bytes(8, "big"))
        return b"CDF\2" + u4(records) + listed(DIMENSIONS, [_name(n) + u4(size) for n, size in dims]) + listed(ATTRIBUTES, []) + listed(VARIABLES, variables)

    at, begins = len(built([0] * len(columns))), []
    for _, kind, shape in columns:
        begins.append(at)
        at += -(-int(np.prod(shape, dtype=np.int64)) * np.dtype(KINDS[kind]).itemsize // 4) * 4
    return built(begins)


def write(df: DataFrame, folder: str, dimension: str, attributes: dict[str, dict[str, str]] | None = None) -> list[str]:
    """Write numbers and arrays of numbers as one file per partition with rows; returns their paths.

    A file gets its name when it is whole. Rows of a task are spooled to its file in batches; the number of records is put
    into the header at the end.
    """
    fs, at = files.filesystem(folder)
    fs.create_dir(at, recursive=True)
    kinds = {}
    for f in df.schema:
        t = f.dataType
        while isinstance(t, ArrayType):
            t = t.elementType
        if t.simpleString() not in _WRITTEN:
            raise ValueError(f"{f.name}: {t.simpleString()} is not written")
        kinds[f.name] = _WRITTEN[t.simpleString()]
    marks = attributes or {}

    def cells(c: pa.Array, kind: int) -> np.ndarray:
        shape = [len(c)]
        while pa.types.is_list(c.type):
            if c.null_count:
                raise ValueError("a null array")
            sizes = np.diff(c.offsets.to_numpy())
            if len(sizes) and (sizes != sizes[0]).any():
                raise ValueError("arrays of unequal shape")
            shape.append(int(sizes[0]) if len(sizes) else 0)
            c = c.flatten()
        lost = c.is_null().to_numpy(zero_copy_only=False)
        v = np.where(lost, 0, c.fill_null(0).to_numpy(zero_copy_only=False)).astype(KINDS[kind])
        v[lost] = FILLS[kind]
        return v.reshape(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = files.filesystem(folder)
        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        body, whole = f"{where}/_{mark}.body", f"{where}/_{mark}"
        columns, n = None, 0
        with store.open_output_stream(body) as sink:
            for b in batches:
                if not b.num_rows:
                    continue
                own = [(c, kinds[c], cells(b.column(c), kinds[c])) for c in b.schema.names]
                layout = [(c, k, list(v.shape[1:])) for c, k, v in own]
                if columns is not None and layout != columns:
                    raise ValueError("arrays of unequal shape")
                columns = layout
                raw = [v.reshape(len(v), -1).view(np.uint8).reshape(len(v), -1) for _, _, v in own]
                if len(raw) > 1:
                    raw = [np.concatenate([r, np.zeros((len(r), -r.shape[1] % 4), np.uint8)], 1) for r in raw]
                sink.write(np.concatenate(raw, 1).tobytes())
                n += b.num_rows
        if n:
            with store.open_output_stream(whole) as out, store.open_input_stream(body) as source:
                out.write(file_header(dimension, n, columns, marks))
                while chunk := source.read(8 << 20):
                    out.write(chunk)
            store.move(whole, f"{where}/part-{part:06d}.nc")
            yield pa.record_batch({"name": pa.array([f"{folder}/part-{part:06d}.nc"])})
        store.delete_file(body)

    return sorted(r.name for r in df.mapInArrow(run, "name string").collect())
