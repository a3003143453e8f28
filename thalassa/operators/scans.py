"""Scans along ordered series by many tasks: numbering, earlier values, filling of gaps, cycles, and recursive filters.

Rows are range-sorted by series and order, so a long series lies in several parts and a part may hold many series. Each
part first gives a summary of the series that it begins and ends with. Summaries join associatively; going over them in
order, one or two a part, gives the state in which every part begins. A second pass applies the scan within the parts. So
one series of any length is read by as many tasks as there are parts, twice.

Cases: null values are skipped by filling and cycles, and count as 0 in filters, whose result is null there; rows of equal
order come in the order of their value; a null series is a series; an empty table gives an empty one. Parts of a third of
all rows of equal series and order are spread too, as a part may end anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from thalassa.sources.tables import stored


class Scan:
    """A scan over numbers (NaN for null). A summary of no rows is `none`."""

    none: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The summary of a stretch of rows."""
        raise NotImplementedError

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The summary of a stretch and the one after it."""
        raise NotImplementedError

    def run(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The results of a stretch, after rows of that summary."""
        raise NotImplementedError


class Number(Scan):
    """The number of the row in its series, from 1."""

    none = np.zeros(1)

    def of(self, x):
        return np.array([len(x)], float)

    def join(self, a, b):
        return a + b

    def run(self, x, before):
        return before[0] + 1 + np.arange(len(x))


class Earlier(Scan):
    """The value of the row before; with skip, the last that is not null, up to and with the row itself."""

    none = np.array([0, np.nan])

    def __init__(self, skip: bool = False):
        self.skip = skip

    def of(self, x):
        x = x[~np.isnan(x)] if self.skip else x
        return np.array([1, x[-1]]) if len(x) else self.none

    def join(self, a, b):
        return b if b[0] else a

    def run(self, x, before):
        if not self.skip:
            return np.append(before[1], x[:-1])
        at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
        return np.where(at < 0, before[1], x[np.maximum(at, 0)])


class Cycles(Scan):
    """How many times the series has risen through a level: from below it to it or above."""

    none = np.array([0, np.nan, np.nan])

    def __init__(self, level: float = 0.0):
        self.level = level

    def of(self, x):
        x = x[~np.isnan(x)] - self.level
        return np.array([float(((x[:-1] < 0) & (x[1:] >= 0)).sum()), x[0], x[-1]]) if len(x) else self.none

    def join(self, a, b):
        if np.isnan(a[1]) or np.isnan(b[1]):
            return b if np.isnan(a[1]) else a
        return np.array([a[0] + b[0] + float(a[2] < 0 <= b[1]), a[1], b[2]])

    def run(self, x, before):
        y = x - self.level
        last = Earlier(skip=True)
        prior = np.append(before[2], last.run(y, np.array([1, before[2]]))[:-1])
        return before[0] + np.cumsum((prior < 0) & (y >= 0))


class Recursive(Scan):
    """y_i = sum_k b_k x_(i-k) - sum_k a_k y_(i-k), a_0 = 1, from rest or from the state in which it would be at rest at
    its first value (settled)."""

    #: Rows of a block: all blocks of a stretch run at once from rest, then each gets what the state before it adds.
    BLOCK = 256

    def __init__(self, b: list[float], a: list[float], settled: bool = False):
        n = max(len(a), len(b), 2)
        self.b, self.a = (np.append(np.array(c, float), np.zeros(n - len(c))) / a[0] for c in (b, a))
        m = self.m = n - 1
        self.step = np.zeros((m, m))
        self.step[:, 0] = -self.a[1:]
        self.step[:-1, 1:] += np.eye(m - 1)
        self.settled = settled
        # state from rest at a constant value of one
        self.still = np.linalg.solve(np.eye(m) - self.step, self.b[1:] - self.a[1:] * self.b[0]) if settled else np.zeros(m)
        # rows, the first value, then the state from rest
        self.none = np.concatenate([[0, 0], np.zeros(m)])

    def _from_rest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(results, states after the rows) of the rows of a matrix."""
        z, y = np.zeros((len(x), self.m)), np.empty_like(x)
        for i in range(x.shape[1]):
            y[:, i] = self.b[0] * x[:, i] + z[:, 0]
            z = np.concatenate([z[:, 1:], np.zeros((len(x), 1))], 1) + x[:, i : i + 1] * self.b[1:] - y[:, i : i + 1] * self.a[1:]
        return y, z

    def _filtered(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(results, state after) from a state."""
        full = len(x) // self.BLOCK * self.BLOCK
        out = np.empty(len(x))
        if full:
            y, ends = self._from_rest(x[:full].reshape(-1, self.BLOCK))
            # what a state adds to the rows of a block, and where it goes after them
            powers = [np.eye(self.m)]
            for _ in range(self.BLOCK):
                powers.append(powers[-1] @ self.step)
            adds, over = np.array([p[0] for p in powers[:-1]]), powers[-1]
            for k in range(len(y)):
                y[k] += adds @ z
                z = over @ z + ends[k]
            out[:full] = y.reshape(-1)
        for i in range(full, len(x)):
            out[i] = self.b[0] * x[i] + z[0]
            z = np.append(z[1:], 0) + x[i] * self.b[1:] - out[i] * self.a[1:]
        return out, z

    def of(self, x):
        x = np.nan_to_num(x)
        return np.concatenate([[len(x), x[0]], self._filtered(x, np.zeros(self.m))[1]]) if len(x) else self.none

    def join(self, a, b):
        if not a[0] or not b[0]:
            return b if not a[0] else a
        return np.concatenate([[a[0] + b[0], a[1]], np.linalg.matrix_power(self.step, int(b[0])) @ a[2:] + b[2:]])

    def run(self, x, before):
        plain = np.nan_to_num(x)
        first = before[1] if before[0] else plain[0]
        z = before[2:] + np.linalg.matrix_power(self.step, int(before[0])) @ (self.still * first)
        return np.where(np.isnan(x), np.nan, self._filtered(plain, z)[0])


def _stretches(series: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(series[1:] != series[:-1]) + 1
    return zip(np.append(0, cut), np.append(cut, len(series)), strict=True)


def scanned(df: DataFrame, by: list[str], order: list[str], value: str, out: str, scan: Scan, descending: bool = False) -> DataFrame:
    """df with `out` (double): the scan of `value` along each series of `by` in the order of the columns `order`."""
    own = [c for c in df.columns if c != out]
    way = [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in (*order, value)]
    series = F.xxhash64(*[F.struct(c) for c in by]) if by else F.lit(0).cast("long")
    rows = df.select(*own).withColumns({"_series": series, "_x": F.col(value).cast("double")})
    key = [F.col(c) for c in by] + way
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key) if by or order else rows
    rows = stored(rows.withColumn("_part", F.spark_partition_id()))

    def numbers(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return b.column("_series").to_numpy(), b.column("_x").to_numpy(zero_copy_only=False).astype(float)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("_part")[0].as_py()
            s, x = numbers(b)
            for i, j in _stretches(s):
                now = scan.of(x[i:j])
                if held and held[-1][0] == s[i]:
                    held[-1] = s[i], scan.join(held[-1][1], now)
                else:
                    held = [held[0], (s[i], now)] if held else [(s[i], now)]
        if held:
            yield pa.record_batch({"part": pa.array([part] * len(held), pa.int32()), "series": [int(k) for k, _ in held], "summary": [v.tolist() for _, v in held]})

    # one or two rows a part
    found: dict[int, list] = {}
    for r in rows.select("_series", "_x", "_part").mapInArrow(summaries, "part int, series long, summary array<double>").collect():
        found.setdefault(r.part, []).append((r.series, np.array([np.nan if v is None else v for v in r.summary])))
    before, now = {}, (None, scan.none)
    for part in sorted(found):
        head, last = found[part][0], found[part][-1]
        before[part] = now[1] if now[0] == head[0] else scan.none
        now = (head[0], scan.join(before[part], head[1])) if len(found[part]) == 1 else last

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            s, x = numbers(b)
            if at is None:
                at, state = s[0], before[b.column("_part")[0].as_py()]
            result = np.empty(len(x))
            for i, j in _stretches(s):
                if s[i] != at:
                    at, state = s[i], scan.none
                result[i:j] = scan.run(x[i:j], state)
                state = scan.join(state, scan.of(x[i:j]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(result, from_pandas=True)], names=[*own, out])

    return rows.mapInArrow(apply, StructType([*df.select(*own).schema, StructField(out, DoubleType())]))


def there_and_back(df: DataFrame, by: list[str], order: list[str], value: str, out: str, b: list[float], a: list[float]) -> DataFrame:
    """df with `out`: `value` filtered forward and then backward, so without delay; each way begins as if at rest at its first value."""
    once = scanned(df, by, order, value, "_there", Recursive(b, a, settled=True))
    return scanned(once, by, order, "_there", out, Recursive(b, a, settled=True), descending=True).drop("_there")
