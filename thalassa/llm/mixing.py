"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each document is queued in its source in the order of a hash. Its virtual finish time is the cumulative number of
words of its source, repeats included, divided by the source's target. At rate `target` every source has sent its
target at virtual time 1, so that time is the cut of the total budget; the document then being sent is cut there.
The queue of all sources is range-sorted by virtual finish time, which gives each document its place in the mix.

Nothing here grows with a source: cumulative sums are taken over hash ranges of about `per_bucket` documents, and the
sums of the ranges over two levels, so a source with a third of all rows is many small windows.

Cases: a null or blank text has size 0 and takes 0. A null source is a source, ordered last. Repeated rows and equal
doc_ids are documents of their own. An empty table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import native, scratch

SHARE = 1.5
WEIGHTS = (3, 1, 2)
COPIES = 2
SEED = "mix"
FAN = 1024


def _before(df: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """(keys, bucket, before): the sum of value over smaller buckets of the same keys, on two levels of at most FAN."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("v")).withColumn("hi", F.floor(F.col(bucket) / FAN))
    top = sums.groupBy(*keys, "hi").agg(F.sum("v").alias("v"))
    w = Window.partitionBy(*keys).orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("hi").alias("_hi"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("base"))
    w = Window.partitionBy(*keys, "hi").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    part = sums.withColumn("low", F.coalesce(F.sum("v").over(w), F.lit(0)))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("hi") == F.col("_hi")]
    out = part.join(top, on).select(*keys, bucket, (F.col("low") + F.col("base")).alias("before"))
    return scratch.materialize(out)


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """(source, sid, source_size, target) from (source, size).

    sid numbers the sources by code point, null last; weights repeat over it. Targets share `share` of all words by
    weight; those above `copies` times their source stop there and the rest is shared again until none is above.
    Sums are decimals, so that sources may hold any number of words; no list of sources reaches the driver.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    ranged = scratch.materialize(
        by.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id())
    )
    first = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    first = first.select(F.col("pid").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    at = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    listed = ranged.withColumn("at", at).join(F.broadcast(first), F.col("pid") == F.col("p")).withColumn("sid", (F.col("at") + F.col("skip") - 1).cast("long"))
    wide = lambda c: c.cast("decimal(38,0)")
    listed = listed.select("source", "sid", "source_size", pick.cast("long").alias("w"), wide(F.col("source_size") * copies).alias("cap"))
    listed = scratch.materialize(listed.withColumn("fill", F.col("cap").cast("double") / F.col("w")))

    # Sources stop at their cap in the order of cap / weight: with those before it at their caps, a source stops if its
    # cap does not exceed its share of the rest. One sort, prefix sums over ranges, and no round per source.
    # share = num / den exactly, so that both this and SQL compute targets from integers with one division
    den = 1 << 20
    num = round(share * den)
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    ordered = scratch.materialize(listed.repartitionByRange(parts, "fill", "sid").withColumn("pid", F.spark_partition_id()))
    sums = ordered.groupBy("pid").agg(F.sum("cap").alias("c"), F.sum("w").alias("v"))
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    before = sums.select(F.col("pid").alias("p"), F.coalesce(wide(F.sum("c").over(w)), zero).alias("c0"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("v0"))
    w = Window.partitionBy("pid").orderBy("fill", "sid").rowsBetween(Window.unboundedPreceding, -1)
    each = ordered.join(F.broadcast(before), F.col("pid") == F.col("p"))
    weights_ = ordered.agg(F.sum("w")).first()[0] or 0
    held = wide(F.col("c0") + F.coalesce(wide(F.sum("cap").over(w)), zero))
    each = each.withColumn("rest", F.lit(str(num * total)).cast("decimal(38,0)") - wide(held * den)).withColumn("left", F.lit(weights_) - F.col("v0") - F.coalesce(F.sum("w").over(w), F.lit(0)))
    # the first source that does not stop sets the rate of all after it
    stops = wide(F.col("cap") * den).cast("double") * F.col("left") <= F.col("w") * F.col("rest").cast("double")
    exact = wide(F.col("cap") * den) * F.col("left").cast("decimal(19,0)") <= F.col("w").cast("decimal(19,0)") * F.col("rest")
    each = each.withColumn("stops", F.coalesce(exact, stops))
    rate = each.where("NOT stops").orderBy("fill", "sid").select("fill", "sid", "rest", "left").first()
    cap = F.col("cap").cast("double")
    if rate is None:
        return listed.select("source", "sid", "source_size", cap.alias("target"))
    first_ = (F.col("fill") < rate["fill"]) | ((F.col("fill") == rate["fill"]) & (F.col("sid") < rate["sid"]))
    fair = F.col("w").cast("double") * F.lit(float(int(rate["rest"]))) / F.lit(float(den * rate["left"]))
    return listed.select("source", "sid", "source_size", F.when(first_, cap).otherwise(fair).alias("target"))


def key(seed: str = SEED):
    """The hash that orders the queue: equal for rows of equal doc_id and text."""
    text = F.md5(native.text_of("text").cast("binary"))
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def mix_sources(
    docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, copies: int = COPIES, seed: str = SEED, per_bucket: int = 256
) -> DataFrame:
    """One row per document: doc_id, source, key, size, source_size, target, taken, mix_start.

    key is the hash that orders the queue; taken counts words, repeats included; mix_start is the number of words that
    the mix holds before the document's first ones (null if it takes none).
    """
    text = native.text_of("text")
    queue = scratch.materialize(
        docs.select(
            "doc_id",
            "source",
            native.n_words(text).alias("size"),
            key(seed).alias("key"),
        )
    )
    n = queue.count()
    buckets = max(1, -(-n // per_bucket))
    targets = scratch.materialize(source_targets(queue, share, weights, copies))
    t = targets.withColumnRenamed("source", "_source")
    spot = F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12) * buckets).cast("long")
    queue = queue.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", spot)
    before = _before(queue, ["sid"], "bucket", "size")
    w = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    placed = (
        queue.join(before, ["sid", "bucket"])
        .withColumn("rn", F.row_number().over(w))
        .withColumn("begin", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    # one entry per document and repeat: the words of it that its source sends up to virtual time 1
    sent = placed.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(copies)])))
    begin = F.col("begin") + F.col("turn") * F.col("source_size")
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin))
    sent = sent.withColumn("words", words.cast("long")).withColumn(
        "finish", F.when(F.col("words") > 0, (begin + F.col("words")).cast("double") / F.col("target")).otherwise(F.lit(0.0))
    )
    sent = scratch.materialize(
        sent.withColumn("range", F.least(F.floor(F.col("finish") * buckets), F.lit(buckets - 1)).cast("long")).withColumn(
            "range", F.when(F.col("words") > 0, F.col("range")).otherwise(F.col("bucket"))
        )
    )
    before = _before(sent.withColumn("all", F.lit(0)), ["all"], "range", "words").drop("all").withColumnRenamed("before", "ahead")
    w = Window.partitionBy("range").orderBy("finish", "sid", "begin", "turn", "rn")
    whole = sent.join(before, "range").withColumn(
        "start", F.col("ahead") + F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    )
    return (
        whole.groupBy("sid", "bucket", "rn")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "source", "key", "size", "source_size", "target")],
            F.sum("words").cast("long").alias("taken"),
            F.min(F.when(F.col("words") > 0, F.col("start"))).cast("long").alias("mix_start"),
        )
        .drop("sid", "bucket", "rn")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", F.coalesce("mix_start", F.lit(-1).cast("long")).alias("mix_start"))


SQL = r"""
WITH q AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM q GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][1 + sid % 3]::BIGINT AS w FROM s),
o AS (SELECT *,
        3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest2,
        sum(w) OVER (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM c),
f AS (SELECT rest2, wrest FROM o WHERE cap * 2 * wrest > w * rest2 ORDER BY cap::DOUBLE / w, sid LIMIT 1),
t AS (SELECT source, sid, source_size,
        CASE WHEN f.rest2 IS NULL OR cap * 2 * f.wrest <= w * f.rest2 THEN cap::DOUBLE
             ELSE w::DOUBLE * (f.rest2::DOUBLE * 524288) / (1048576.0::DOUBLE * f.wrest::DOUBLE) END AS target
      FROM c LEFT JOIN f ON true),
p AS (SELECT q.*, t.sid, t.source_size, t.target, row_number() OVER z AS rn,
        (sum(size) OVER z - size)::BIGINT AS start0
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source
      WINDOW z AS (PARTITION BY t.sid ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT p.*, turn, greatest(0, least(size, floor(target)::BIGINT - (start0 + turn * source_size)))::BIGINT AS words
      FROM p, (VALUES (0), (1)) v(turn)),
g AS (SELECT *, sum(words) OVER (ORDER BY (start0 + turn * source_size + words)::DOUBLE / target, sid, start0, turn, rn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS start FROM e WHERE words > 0)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(sum(g.words), 0)::BIGINT AS taken, coalesce(min(g.start), -1)::BIGINT AS mix_start
FROM p LEFT JOIN g ON p.sid = g.sid AND p.rn = g.rn
GROUP BY p.sid, p.rn, p.doc_id, p.size, p.source_size, p.target
"""
