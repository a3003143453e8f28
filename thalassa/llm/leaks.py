"""Benchmark decontamination by SimHash over item-sized windows (DataFrame functions only).

A window is as many words of a text as an item has. Windows that can reach the similarity share a five-word shingle with
the item, so they are placed where such a shingle stands: at its place in the text less its place in the item.

Each window and item gets PRINTS independent 64-bit SimHashes of its shingles, repeats weighing more. A bit is the sign
of a sum of one byte per shingle, so that hardly any sum is zero. Multi-index blocks: a print has four blocks of 16 bits;
prints within RADIUS = 11 bits agree in one block up to 2 bits, so listing the windows and the items each under the 17
values within one bit of every block finds all of them. Random pairs meet in 1 of 20 cases and pass the radius in about
1 of a million.

Candidates are verified by the exact weighted Jaccard similarity of the shingle multisets, sum of the smaller over sum
of the larger counts, of LEAST or more. At a similarity of 0.8 a print differs in 9.7 bits on average and in at most 11
in more than half of the cases, so that all PRINTS of a window miss in less than one of 4,000 (a test measures it).

Cases: a null or empty text has no windows; items with fewer than five words are too short to tell and never match.
Repeated rows give one result row. A null doc_id keeps its rows apart by text. A text with less words than an item is
one window. Empty tables give no rows. Other columns are kept by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native, scratch

K = 5
LEAST = 0.8
PRINTS = 12
RADIUS = 11
#: Rows up to which item shingles, listed items and windows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _hashes(text: Column) -> Column:
    return F.transform(native.words(native.lowered(text)), lambda w: F.xxhash64(w))


def once(value: Column, f) -> Column:
    """f(value) with value bound to a variable: the optimizer inlines plain columns into lambdas, to be computed per element."""
    return F.transform(F.array(value), f)[0]


def _shingles(hashes: Column) -> Column:
    def of(h: Column) -> Column:
        at = lambda i, j: F.element_at(h, (i + j).cast("int"))
        return F.when(F.size(h) >= K, F.transform(F.sequence(F.lit(1), F.size(h) - K + 1), lambda i: F.xxhash64(*[at(i, F.lit(j)) for j in range(K)]))).otherwise(F.array().cast("array<long>"))

    return once(hashes, of)


def simhashes(s: Column) -> Column:
    """The PRINTS 64-bit SimHashes of an array of hashes."""
    seeded = F.transform(F.sequence(F.lit(0), F.lit(8 * PRINTS - 1)), lambda g: F.transform(s, lambda x: F.xxhash64(x, g)))

    def prints(h: Column) -> Column:
        def bit(f: Column, b: Column) -> Column:
            of = F.element_at(h, (f * 8 + F.floor(b / 8) + 1).cast("int"))
            byte = lambda x: F.call_function("shiftright", x, (b % 8) * 8).bitwiseAND(F.lit(255).cast("long"))
            return 2 * F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + byte(x)) > 255 * F.size(of)

        one = lambda f: F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(bit(f, b), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a)
        )
        return F.transform(F.sequence(F.lit(0), F.lit(PRINTS - 1)), one)

    return once(seeded, prints)


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    """columns, print, fp, block, value: each row under the values within one bit of every block of its prints."""
    df = df.select(*columns, F.posexplode("fps").alias("print", "fp"))
    df = df.select(*columns, "print", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftright("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("value")) for i in range(4)])).alias("b"))
    near = F.array(F.col("b.value"), *[F.col("b.value").bitwiseXOR(F.lit(1 << i)) for i in range(16)])
    return df.select(*columns, "print", "fp", F.col("b.block").alias("block"), F.explode(near).alias("value"))


def similarity(a: Column, b: Column) -> Column:
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda t, x: t + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), native.text_of("text")).cast("binary")))


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """_key, doc_id, item_id, first, n_words, similarity: the best window of each text and item at `least` or above."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be from 0 to {RADIUS}")
    near = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    known = items.select("item_id", _hashes(native.text_of("text")).alias("h"))
    known = scratch.materialize(known.select("item_id", F.size("h").alias("n"), _shingles(F.col("h")).alias("s")).where(F.size("s") > 0))
    printed = scratch.materialize(known.withColumn("fps", simhashes(F.col("s"))))
    places = scratch.materialize(known.select("n", F.posexplode("s").alias("q", "s")).distinct())

    keyed = _keyed(docs.select("doc_id", "text"), "_key")
    text = keyed.select("_key", F.posexplode(_shingles(_hashes(native.text_of("text")))).alias("p", "s"))
    # windows of one text: as many as it has shared shingles, without repeats
    start = F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("first")
    windows = text.join(near(places, places.count()), "s").select(F.col("_key").alias("_k"), start, F.col("n")).distinct()
    windows = scratch.materialize(windows.groupBy("_k").agg(F.collect_list(F.struct("first", "n")).alias("windows")))
    placed = windows.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    held = keyed.join(near(windows, placed), F.col("_key") == F.col("_k")).dropDuplicates(["_key"])

    # windows over the end of the text are moved back to the last full one
    def cut(h: Column) -> Column:
        fit = F.transform("windows", lambda w: F.struct(F.least(w["first"], F.greatest(F.size(h) - w["n"], F.lit(0))).alias("first"), w["n"].alias("n")))
        return F.transform(F.array_distinct(fit), lambda w: F.struct(w["first"].alias("first"), w["n"].alias("n"), _shingles(F.slice(h, w["first"] + 1, w["n"])).alias("s")))

    each = held.select("_key", "doc_id", F.explode(once(_hashes(native.text_of("text")), cut)).alias("w")).select("_key", "doc_id", "w.*").where(F.size("s") > 0)
    each = scratch.materialize(each)
    # few bytes, but long to compute: spread over all tasks that shuffles have
    spread = each.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "first")
    probes = _listed(spread.select("_key", "first", "n", simhashes(F.col("s")).alias("fps")), "_key", "first", "n")
    listed = _listed(printed.select("item_id", F.col("n").alias("m"), "fps"), "item_id", "m").withColumnsRenamed({"print": "item_print", "fp": "item_fp", "block": "item_block", "value": "item_value"})
    n_items = known.count()
    same = (F.col("print") == F.col("item_print")) & (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("item_value")) & (F.col("n") == F.col("m"))
    pairs = probes.join(near(listed, n_items * PRINTS * 4 * 17), same)
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("_key", "first", "n", "item_id").distinct()
    exact = pairs.join(each, ["_key", "first", "n"])
    exact = exact.join(near(known.select(F.col("item_id").alias("_item"), F.col("n").alias("_n"), F.col("s").alias("t")), n_items), (F.col("item_id") == F.col("_item")) & (F.col("n") == F.col("_n")))
    exact = exact.withColumn("similarity", similarity(F.col("s"), F.col("t"))).where(F.col("similarity") >= least - 1e-12)
    best = exact.groupBy("_key", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first")).alias("b"), "n")).alias("x"))
    return best.select("_key", "doc_id", "item_id", (-F.col("x.b")).cast("long").alias("first"), F.col("x.n").cast("long").alias("n_words"), F.col("x.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    key, bad = scratch.fresh(docs.columns, "key", "bad")
    found = scratch.materialize(leaks(docs, items).select(F.col("_key").alias(bad)).distinct())
    gone = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return _keyed(docs, key).join(gone, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("_key")
