"""Readers of agency, buoy, model and instrument text files as DataFrames.

Tables of lines are read with spark.read.text, so that large files and many files are split over executors; a table's
header is taken from its first file. Formats that only make sense as a whole file (JSON, XML, blocks of grids) are read
one file to a row. Every reader takes a path of any store that Spark reads, with globs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalassa.functions.codes import MISSING


def number(c: Column) -> Column:
    """The number in a text, null if it is none."""
    return c.try_cast("double")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first n lines of the first file."""
    name = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    whole = spark.read.text(name)
    return [" ".join(r[0].split()) for r in whole.head(n)]


def _table(lines: DataFrame, names: list[str]) -> DataFrame:
    """The fields of lines, as texts, by name; missing ones are null."""
    parts = lines.select(F.split("line", " ").alias("p"))
    return parts.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def dates(year: Column, month: Column, day: Column, hour: Column, minute: Column | None = None) -> Column:
    """A timestamp of date fields; years of two digits below 69 are of this century."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    y = year.cast("string")
    full = F.when(F.length(y) > 2, y).otherwise(F.concat(F.when(y.cast("int") < 69, "20").otherwise("19"), two(y)))
    text = F.concat(full, two(month), two(day), two(hour), two(minute) if minute is not None else F.lit("00"))
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmm"))


def read_buoy(spark: SparkSession, path: str, missing: tuple = MISSING) -> tuple[DataFrame, dict[str, str] | None]:
    """(time and a column per field, units by field if the files have them) of buoy archive tables.

    The header may begin with #, a second line with # holds units, minutes may be absent. Fields are numbers; MM and the
    numbers of `missing` are null.
    """
    header, second = (_first_lines(spark, path, 2) + ["", ""])[:2]
    names = header.lstrip("#").split()
    n = 5 if len(names) > 4 and names[4] == "mm" else 4
    units = second.split()[n:] if second.startswith("#") else None
    rows = _table(_lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#") & (F.col("line") != header)), [f"c{i}" for i in range(len(names))])
    at = dates(*[F.col(f"c{i}") for i in range(n)])
    value = lambda i: F.when(~number(F.col(f"c{i}")).isin(*missing), number(F.col(f"c{i}")))
    out = rows.select(at.alias("time"), *[value(i).alias(names[i]) for i in range(n, len(names))])
    return out, dict(zip(names[n:], units)) if units else None


def spectra_of(table: DataFrame, time: str = "time") -> DataFrame:
    """time, f, s (arrays): the columns of a table whose names are frequencies."""
    names = sorted((c for c in table.columns if re.fullmatch(r"\d*\.?\d+", c)), key=float)
    return table.select(time, F.array(*[F.lit(float(c)) for c in names]).alias("f"), F.array(*[F.col(f"`{c}`") for c in names]).alias("s"))


def read_moored(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a mooring model's output; its second line (units) and columns without values are left out."""
    header, units = _first_lines(spark, path, 2)
    names = header.split()
    rows = _table(_lines(spark, path).where((F.col("line") != "") & (F.col("line") != header) & (F.col("line") != units)), names)
    rows = rows.select(*[number(F.col(f"`{c}`")).alias(c) for c in names])
    held = rows.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
    return rows.select(*[F.col(f"`{c}`") for c in names if held is None or held[c]])


def lay_length(table: DataFrame, time: str, depth: float, tolerance: float = 0.25) -> DataFrame:
    """time, length: horizontal distance of a line's first node to the last one that rests on the bed.

    Columns are named <node>x, <node>y, <node>z; nodes in the order of the columns. The line leaves the bed at the first
    node that is above depth + tolerance at all times.
    """
    nodes = [c[:-1] for c in table.columns if c.endswith("z")]
    least = table.agg(*[F.min(f"`{n}z`").alias(n) for n in nodes]).first()
    up = next((i for i, n in enumerate(nodes) if least[n] is not None and least[n] > depth + abs(tolerance)), None)
    if not up:
        raise ValueError("no node rests on the bed before one that never does")
    d = [F.col(f"`{nodes[up - 1]}{c}`") - F.col(f"`{nodes[0]}{c}`") for c in "xy"]
    return table.select(time, F.sqrt(d[0] * d[0] + d[1] * d[1]).alias("length"))


def metadata(line: str) -> dict[str, str]:
    """The `key: value` pairs of a comment line of a spectral wave model; ** names the variable."""
    words = re.sub(r"\s+", " ", line.replace(",", " ").strip("% \n").replace("**", "vars:"))
    keys = [m for m in re.finditer(r"(\S+)\s*:", words)]
    ends = [m.start() for m in keys[1:]] + [len(words)]
    return {m[1]: words[m.end() : e].strip() for m, e in zip(keys, ends)}


def read_wave_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(columns, run, header and units) of a table of a spectral wave model: the fifth line names the columns."""
    head = _first_lines(spark, path, 6)
    meta = next((metadata(x) for x in head if x.startswith("% Run") or x.startswith("%Run")), {})
    names = head[4].strip("% ").split()
    meta |= {"header": names, "units": re.sub(r"[\[\]]", "", head[5]).strip("% ").split()}
    rows = _table(_lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("%")), names)
    return rows.select(*[number(F.col(f"`{c}`")).alias(c) for c in names]), meta


def read_wave_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, variable, y, x, value of files with one or several grids each; **** is null, units are applied.

    A grid begins with a line `% Run`; its rows begin with their number. A file is parsed as a whole, by one task.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["path"], frame["value"]):
                out, variable, factor = [], None, 1.0
                for line in text.split("\n"):
                    if line.startswith("% Run"):
                        m = metadata(line)
                        variable, factor = m.get("vars"), float(m.get("Unit", "1").split()[0])
                    elif line.strip() and not line.startswith("%"):
                        row, *values = re.findall(r"\*{4}|-?\d+(?=\.|\s|$)", line)
                        out += [(name, variable, int(row), x, None if v == "****" else float(v) * factor) for x, v in enumerate(values)]
                yield pd.DataFrame(out, columns=["path", "variable", "y", "x", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(parse, "path string, variable string, y int, x int, value double")


def blocks_to_table(blocks: DataFrame) -> DataFrame:
    """x, y and a column per variable."""
    return blocks.groupBy("x", "y").pivot("variable").agg(F.first("value"))


def read_gage(spark: SparkSession, path: str) -> DataFrame:
    """time, variable, value of stream gage JSON files: the first value list of every time series."""
    raw = spark.read.option("multiLine", True).json(path)
    series = raw.select(F.explode("value.timeSeries").alias("s"))
    rows = series.select(F.col("s.variable.variableDescription").alias("variable"), F.explode(F.get("s.values", F.lit(0)).getField("value")).alias("v"))
    return rows.select(F.try_to_timestamp("v.dateTime").alias("time"), "variable", number(F.col("v.value").cast("string")).alias("value"))


def combine_first(rows: DataFrame, key: str, variable: str, value: str, order: str | None = None) -> DataFrame:
    """A column per variable: for each key the first value there is, in the order of `order`."""
    at = F.min_by(value, F.col(order) if order else F.col(value))
    return rows.where(F.col(value).isNotNull()).groupBy(key).pivot(variable).agg(at)


def coalesced(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both by key: where left has no value, that of right."""
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    r = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    both = left.join(r, F.col(key) == F.col("_k"), "full_outer")
    pick = lambda c: F.coalesce(*([F.col(c)] if c in left.columns else []), *([F.col(f"_r_{c}")] if c in right.columns else []))
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), *[pick(c).alias(c) for c in names])


def without_repeats(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by `order`."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def read_station_xml(spark: SparkSession, path: str) -> DataFrame:
    """time, name, value and station id of tide station XML files: the attributes of the observations, without repeats."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for frame in frames:
            out = []
            for text in frame["value"]:
                root = ElementTree.fromstring(text)
                if root.find("error") is not None:
                    continue
                meta, held = root.find("metadata"), root.find("observations")
                station = meta.get("id") if meta is not None else None
                for o in held if held is not None else ():
                    out += [(station, o.get("t"), k, v) for k, v in o.attrib.items() if k != "t"]
            yield pd.DataFrame(out, columns=["station", "t", "name", "value"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(parse, "station string, t string, name string, value string")
    return rows.select("station", _moment(F.col("t")).alias("time"), "name", number(F.col("value")).alias("value")).distinct()


def _moment(t: Column) -> Column:
    """A timestamp of milliseconds since 1970 or of a date and time."""
    return F.when(t.rlike(r"^-?\d+$"), F.timestamp_millis(t.try_cast("long"))).otherwise(F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(t)))


def read_station_json(spark: SparkSession, path: str) -> DataFrame:
    """time, name, value of tide station JSON files, by column ({name: {ms: value}}) or by row (columns, index, data)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            out = []
            for text in frame["value"]:
                d = json.loads(text)
                d.pop("metadata", None)
                if {"columns", "index", "data"} <= set(d):
                    out += [(str(t), c, str(v)) for t, row in zip(d["index"], d["data"]) for c, v in zip(d["columns"], row)]
                else:
                    out += [(t, c, str(v)) for c, values in d.items() for t, v in values.items()]
            yield pd.DataFrame(out, columns=["t", "name", "value"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(parse, "t string, name string, value string")
    return rows.select(_moment(F.col("t")).alias("time"), "name", number(F.col("value")).alias("value"))


def date_ranges(begin: Column, end: Column, days: int = 30) -> Column:
    """array<struct<begin, end>>: a span of dates in parts of at most `days`."""
    n = F.greatest(F.lit(0), F.ceil(F.date_diff(end, begin) / days).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.date_add(begin, (i * days).cast("int")).alias("begin"), F.least(end, F.date_add(begin, ((i + 1) * days).cast("int"))).alias("end")))
