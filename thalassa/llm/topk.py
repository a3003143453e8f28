"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Each component x becomes floor(1024 x). A block of candidates is indexed by segments of postings (vector, dimension)
whose impact |x| falls into one quantised level, highest level first. All queries of a block add one segment after the
other to their accumulators; after each, the rest of a vector's score is at most |q| times the norm of its postings
still to come (Cauchy-Schwarz). A query is done with a block only on proof: what is left are the vectors whose bound
reaches the k-th best score; these possible members are rescored exactly, in integers.

Queries come in blocks of QUERY_BLOCK (a fixed size that travels with the tasks); every block meets all rows once. Each
task holds one candidate block and k best rows per query, and the k best per task are merged by a ranking with map-side
limits.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with
zeros. Components whose scores might not fit 64 bits are refused. Repeated vec_ids are rows of their own: only the query's own row is left out. Equal scores go to the smaller
vec_id. Null vec_ids take no part. Fewer than k candidates give them all; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SCALE = 1024
QUERY_BLOCK = 8192
BLOCK = 2048
LEVELS = 4


def _dense(column, dim: int) -> np.ndarray:
    """int64 rows of floor(1024 x) from an Arrow list column, zero-padded."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    flat = np.floor(SCALE * column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[off[0] : off[-1]])
    if float(np.abs(flat).max(initial=0)) ** 2 * dim > 2**62:
        raise ValueError(f"components above {int((2**62 / dim) ** 0.5 / SCALE)} give scores beyond 64 bits for {dim} dimensions")
    lengths = np.diff(off)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], lengths)] = flat
    return out


class ImpactBlock:
    """The segments of one block of vectors, by descending quantised impact."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        impact = np.abs(x)
        # level l holds impacts within (edge[l+1], edge[l]]; quantiles make segments of like size
        edges = np.quantile(impact, np.linspace(1, 0, levels + 1)[1:-1]) if x.size else np.zeros(levels - 1)
        level = (impact[:, :, None] <= edges).sum(2)
        self.segments = [np.where(level == i, x, 0) for i in range(levels)]
        square = np.stack([(s * s).sum(1) for s in self.segments])
        self.rest = np.sqrt(np.maximum(square[::-1].cumsum(0)[::-1] - square, 0)) * (1 + 1e-9)
        # sums of large integers round: by so much of |q| at most
        self.rounding = np.sqrt(square.sum(0)) * (x.shape[1] if x.ndim > 1 else 1) * 2.0**-51

    def candidates(self, q: np.ndarray, least: np.ndarray, k: int):
        """(query index, rows) whose score may reach both `least` and the block's k-th best: none that may is left out."""
        norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        acc, alive = np.zeros((len(q), len(self.x))), np.arange(len(q))
        found = {}
        for i, segment in enumerate(self.segments):
            acc[alive] += q[alive] @ segment.T
            slack = norm[alive, None] * (self.rest[i] + self.rounding)
            floor = least[alive]
            if len(self.x) > k:
                low = acc[alive] - slack
                floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
            may = acc[alive] + slack >= floor[:, None] - 1e-6
            few = may.sum(1) <= (4 * k if i < len(self.segments) - 1 else len(self.x))
            for j in np.flatnonzero(few):
                found[alive[j]] = np.flatnonzero(may[j])
            alive = alive[~few]
            if not len(alive):
                break
        return found


def _search(q: np.ndarray, own: np.ndarray, dim: int, k: int):
    def run(batches):
        # k + 1, as a query's own row is dropped afterwards
        best_s, best_v = [np.zeros(0, np.int64) for _ in q], [np.zeros(0, np.int64) for _ in q]
        least = np.full(len(q), -np.inf)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                vec, rid = part.column("vec_id").to_numpy(), part.column("rid").to_numpy()
                x = _dense(part.column("embedding"), dim)
                for j, rows in ImpactBlock(x).candidates(q, least, k + 1).items():
                    rows = rows[rid[rows] != own[j]]
                    if not len(rows):
                        continue
                    s = np.append(best_s[j], x[rows].astype(np.int64) @ q[j].astype(np.int64))
                    v = np.append(best_v[j], vec[rows])
                    top = np.lexsort((v, -s))[:k]
                    best_s[j], best_v[j] = s[top], v[top]
                    if len(top) == k:
                        least[j] = np.nextafter(float(s[top[-1]]), -np.inf)
        n = [len(s) for s in best_s]
        if sum(n):
            yield pa.record_batch({"q": np.repeat(np.arange(len(q)), n), "vec_id": np.concatenate(best_v), "score": np.concatenate(best_s).astype(np.int64)})

    return run


def exact_topk(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row."""
    spark = vectors.sparkSession
    scratch.ship(spark)
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fit)
    rows = scratch.materialize(clean.withColumn("embedding", F.col("embedding").cast("array<float>") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding")).withColumn("rid", F.monotonically_increasing_id()))
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    queries = rows.where(is_query)
    last, parts = (None, None), []
    while True:
        rest = queries if last[0] is None else queries.where((F.col("vec_id") > last[0]) | ((F.col("vec_id") == last[0]) & (F.col("rid") > last[1])))
        block = rest.orderBy("vec_id", "rid").limit(QUERY_BLOCK).toArrow()
        if not block.num_rows:
            break
        ids, own = block.column("vec_id").to_numpy(), block.column("rid").to_numpy()
        last = (int(ids[-1]), int(own[-1]))
        found = rows.mapInArrow(_search(_dense(block.column("embedding"), dim), own, dim, k), "q long, vec_id long, score long")
        ranked = scratch.materialize(found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k))
        label = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids}))
        parts.append(ranked.join(F.broadcast(label), "q").select("query_id", "rank", "vec_id", "score"))
        if block.num_rows < QUERY_BLOCK:
            break
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for p in parts:
        out = out.unionByName(p)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS qr, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) <= 10
"""
