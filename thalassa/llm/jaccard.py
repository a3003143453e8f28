"""N-gram Jaccard join over whole texts: size-banded tiles, bitmap bounds, exact sorted-array intersection.

A document's set is its distinct k-word shingles. Equal sets become one node (copies are never expanded to pairs).
A node's shingles are ordered rarest first (a fixed-size list of frequent shingles last); two sets with Jaccard >= t
share one of the first n - ceil(t n) + 1, so each node is listed under those. A tile is the nodes of one such shingle
and one band of set sizes; tiles are range-sorted by (shingle, size), so that a tile of a third of all nodes lies in
many partitions.

Signatures are bitmaps of one parity bit per hash value: a bit that differs between two sets stands for an element of
one set only, so the bit count of their exclusive or bounds the overlap from above, and folding a bitmap to half its
length keeps that true.

Round 1 proposes one partner per node: of the first node of its tiles and of its neighbours in size the one it shares
most tiles with. Rounds 2 and 3 take the tiles that still hold several components. Round 2 proposes all pairs of
different components of those of at most SMALL nodes. Larger tiles go in blocks of at most TILE nodes; the nodes outside
a tile's largest component stand in each of its blocks, so that every pair of different components meets. Within a block
sizes, positions and bitmap bounds are tested. Of the pairs that pass, round 2 proposes a spanning forest, closest first,
which joins a group of near copies by as many rows as it has nodes; round 3 all between the components of then. Proposals of every round are verified by exact intersection. As every pair that may link is
either proposed in round 3 or already within one component, the components are those of all links.

Cases: null, empty and blank texts have no shingles, link with nothing and are their own component; a text of fewer
than k words has its whole sequence as one shingle; a null doc_id keeps its row; repeated rows are copies. Other
columns are ignored. Ties and order do not matter: the component id is the smallest doc_id. Shingles and sets are known
by 64-bit hashes: among 10^9 different sets two share one with a chance of about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum
from .components import connected, extended

#: Entries of the list of frequent shingles that order last; only the speed depends on it.
FREQUENT = 1 << 16
_FLUSH = 1 << 21
#: Pairs that are tested at a time.
_BLOCK = 1 << 17
#: Bytes of bitmaps that are compared at a time.
_BITMAP_BYTES = 4 << 20
#: Rows on either side that are looked at for a partner.
REACH = 8
#: Rows up to which a tile's pairs are proposed without bitmaps.
SMALL = 8
#: Most nodes of a block of a tile.
TILE = 1 << 14
#: Most rows of (node, doc_id) that are broadcast; above, they are joined by shuffling.
BROADCAST_ROWS = 1 << 17


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the FREQUENT shingles with the highest counts, most frequent last: two arrays of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(8, rows // 1000)
            return pa.record_batch({"s": u[keep].view(np.int64), "c": c[keep].astype(np.int64)})

        for b in batches:
            for x in textnum.shingle_sets(b.column(0), k):
                held.append(x)
                size += len(x)
                rows += 1
                if size > _FLUSH:
                    yield flush()
                    held, size, rows = [], 0, 0
        if held:
            yield flush()

    top = docs.select("text").mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(FREQUENT)
    got = top.toPandas()
    return np.stack([got["s"].to_numpy(np.int64), got["c"].to_numpy(np.int64)])


def set_key(x: np.ndarray) -> int:
    """A hash of a set of shingle hashes: the finalizer of two sums, of the hashes and of their squares."""
    with np.errstate(over="ignore"):
        total = x.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (x * x).sum(dtype=np.uint64) + np.uint64(len(x))
    return int(textnum.mix(np.array([total]))[0].view(np.int64))


def bitmap(x: np.ndarray) -> bytes:
    """One parity bit per hash value, in the smallest power of two of at least 1.5 n bits (64 to 65536)."""
    bits = 1 << min(16, max(6, int(1.5 * len(x) - 1).bit_length()))
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """The bitmaps of some nodes, as rows of a matrix per length."""

    def __init__(self, column: pa.Array):
        off = column.offsets.to_numpy() if isinstance(column, pa.LargeBinaryArray) else np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        self.length = np.diff(off)
        self.place = {}
        for size in np.unique(self.length):
            # bitmaps of this length, and those of twice the length folded
            at = np.full(len(self.length), -1)
            rows = [np.flatnonzero(self.length == size), np.flatnonzero(self.length == 2 * size)]
            own, two = (np.empty((len(r), n), np.uint8) for r, n in zip(rows, (size, 2 * size)))
            for out, r in ((own, rows[0]), (two, rows[1])):
                for k, i in enumerate(r):
                    out[k] = data[off[i] : off[i + 1]]
            own, two = own.view(np.uint64), two.view(np.uint64)
            at[rows[0]], at[rows[1]] = np.arange(len(rows[0])), len(rows[0]) + np.arange(len(rows[1]))
            half = size // 8
            self.place[int(size)] = at, np.concatenate([own, two[:, :half] ^ two[:, half:]])

    def difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the number of elements that are in one of the sets i, j only."""
        size = np.minimum(self.length[i], self.length[j])
        out = np.zeros(len(i), np.int64)
        for s, (at, rows) in self.place.items():
            mine = np.flatnonzero((size == s) & (at[i] >= 0) & (at[j] >= 0))
            step = max(1, _BITMAP_BYTES // s)
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                out[part] = np.bitwise_count(rows[at[i[part]]] ^ rows[at[j[part]]]).sum(1)
        return out


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Indices of links (a, b) between n components that span all that the links join, nearest first."""
    live = np.argsort(far, kind="stable")
    label, picked = np.arange(n), [np.zeros(0, np.int64)]
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.concatenate(picked)
        best = np.full(n, len(live))
        np.minimum.at(best, x, np.arange(len(live)))
        np.minimum.at(best, y, np.arange(len(live)))
        chosen = np.unique(best[best < len(live)])
        picked.append(live[chosen])
        x, y, to = x[chosen], y[chosen], np.arange(n)
        while (to[x] != to[y]).any():
            low = np.minimum(to[x], to[y])
            np.minimum.at(to, x, low)
            np.minimum.at(to, y, low)
            to = to[to]
        label = to[label]


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _signatures(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    order = np.argsort(frequent[0].view(np.uint64))
    known, rank = frequent[0].view(np.uint64)[order], frequent[1][order]

    def sign(batches):
        for b in batches:
            n, k1, bits, prefix = [], [], [], []
            for x in textnum.shingle_sets(b.column(1), k):
                n.append(len(x))
                if not len(x):
                    k1.append(None), bits.append(None), prefix.append(None)
                    continue
                k1.append(set_key(x))
                bits.append(bitmap(x))
                p = len(x) - -(-num * len(x) // den) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    weight = np.where(known[at] == x, rank[at], 0)
                    x = x[np.lexsort((x, weight))]
                prefix.append(x[:p].view(np.int64))
            yield pa.record_batch(
                [
                    b.column(0),
                    b.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(prefix, pa.list_(pa.int64())),
                ],
                names=["doc_id", "hash", "n", "node", "bits", "prefix"],
            )

    return docs.select("doc_id", "text", _text_hash().alias("hash")).mapInArrow(sign, "doc_id long, hash long, n long, node long, bits binary, prefix array<long>")


def _tiles(num: int, den: int):
    """Over rows sorted by (token, n, node): drops rows without a partner, adds the tile's first node and the previous node.

    A partner is a row of the same token whose size and position allow a link. It is looked for among the REACH rows on
    either side; rows with more rows within their size bound stay, and so do a partition's first and last token, which
    may go on in another partition.
    """
    step = np.log(den / num)

    def partnered(token, n, pos):
        """Whether each row has a partner, or may have one beyond reach."""
        n, pos, out = n.astype(np.int64), pos.astype(np.int64), np.zeros(len(n), bool)
        for d in range(1, REACH + 2):
            i, j = slice(0, -d), slice(d, None)
            ok = (token[i] == token[j]) & (n[i] * den >= n[j] * num)
            if d <= REACH:
                ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= -(-num * (n[i] + n[j]) // (num + den))
            out[i] |= ok
            out[j] |= ok
        return out

    def run(batches):
        names = ("token", "n", "pos", "node")
        held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]
        edge = None
        for b in chain(batches, [None]):
            if b is not None:
                rows = [np.append(h, b.column(c).to_numpy()) for h, c in zip(held, names)]
                if not len(rows[0]):
                    continue
                # the last token goes on in the next batch, if it is not of many rows
                token = rows[0]
                edge = token[0] if edge is None else edge
                whole = int(np.searchsorted(token, token[-1])) if token[0] != token[-1] or len(token) < _FLUSH >> 6 else len(token)
                held = [x[whole:] for x in rows]
                rows = [x[:whole] for x in rows]
            else:
                rows, whole = held, len(held[0])
            if not whole:
                continue
            token, n, pos, node = rows
            same = np.append(False, token[1:] == token[:-1])
            band = np.floor(np.log(n) / step)
            new = ~same
            new[1:] |= band[1:] != band[:-1]
            head = node[np.maximum.accumulate(np.where(new, np.arange(whole), 0))]
            prev = np.where(same, np.append(node[:1], node[:-1]), node)
            keep = partnered(token, n, pos) | (token == edge)
            if b is None or not len(held[0]):
                keep |= token == token[-1]
            yield pa.record_batch({k: v[keep] for k, v in zip((*names, "head", "prev"), (token, n, pos, node, head, prev))})

    return run


def _pairs(num: int, den: int, span: bool):
    """Over rows sorted by (token, block, n, node): pairs of different components within the bounds of size, position and,
    where the rows have them, bitmaps.

    With span, only a spanning forest of each batch's components. Of a block that goes on in the next batch, only the
    rows within the size bound of its last row are kept.
    """
    names = ("token", "block", "n", "pos", "node", "comp")

    def of(tile, n, pos, comp, bits, old):
        """Places, and lower bounds of the difference, of the pairs of each row from `old` on with the rows before it."""
        lo = np.searchsorted((tile << 40) + n * den, (tile << 40) + n * num)
        count = np.arange(len(n)) - lo
        count[:old] = 0
        ends = np.cumsum(count)
        at = old
        while at < len(n):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, "right")))
            c = count[at:upto]
            i = np.repeat(np.arange(at, upto), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + lo[i]
            at = upto
            ok = comp[i] != comp[j]
            i, j = i[ok], j[ok]
            need = -(-num * (n[i] + n[j]) // (num + den))
            ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
            i, j, need = i[ok], j[ok], need[ok]
            if len(i):
                far = bits.difference(i, j) if bits else np.zeros(len(i), np.int64)
                ok = (n[i] + n[j] - far) // 2 >= need
                if ok.any():
                    yield i[ok], j[ok], far[ok]

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            old = held.num_rows if held is not None else 0
            t = (pa.concat_tables([held, t]) if old else t).combine_chunks()
            token, block, n, pos, node, comp = (t.column(c).to_numpy().astype(np.int64) for c in names)
            tile = np.cumsum(np.append(0, (token[1:] != token[:-1]) | (block[1:] != block[:-1])))
            which, label = np.unique(comp, return_inverse=True)
            bits = Bitmaps(t.column("bits").combine_chunks()) if "bits" in t.column_names else None
            for i, j, far in of(tile, n, pos, comp, bits, old):
                if span:
                    keep = forest(label[i], label[j], far, len(which))
                    i, j = i[keep], j[keep]
                x = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
                yield pa.record_batch({"a": x[0], "b": x[1]})
            held = t.filter(pa.array((tile == tile[-1]) & (n * den >= n[-1] * num)))

    return run


def _open_tiles(tiles: DataFrame, nodes: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of tiles that hold several components, with components, sorted: those of at most SMALL rows, and the
    others with bitmaps and dealt to blocks. The third table is what both are of, to be dropped after them."""
    label = F.coalesce("c", "node").alias("comp")
    left = tiles.select("token", "n", "pos", "node").join(comp.select(F.col("node").alias("m"), "c"), F.col("node") == F.col("m"), "left").select("token", "n", "pos", "node", label)
    by = left.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    by = by.groupBy("token").agg(F.max_by("comp", "rows").alias("most"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    by = by.select(F.col("token").alias("t"), "most", F.when(F.col("rows") > SMALL, F.ceil(F.col("rows") / TILE).cast("int")).otherwise(0).alias("blocks"))
    held = scratch.keep(left.join(by, F.col("token") == F.col("t")).drop("t"))
    sort = lambda x: x.repartition("token", "block").sortWithinPartitions("token", "block", "n", "node")
    small = held.where("blocks = 0").select("token", F.lit(0).alias("block"), "n", "pos", "node", "comp")
    large = held.where("blocks > 0")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    block = F.when(F.col("comp") == F.col("most"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = large.select("token", "n", "pos", "node", "comp", F.explode(block).alias("block"))
    # bitmaps of the nodes in question only
    some = nodes.join(large.select(F.col("node").alias("m")).distinct(), F.col("node") == F.col("m"), "left_semi").select(F.col("node").alias("k"), "bits")
    dealt = dealt.join(some, F.col("node") == F.col("k")).select("token", "block", "n", "pos", "node", "comp", "bits")
    return sort(small), sort(dealt), held


def _likely(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that sizes and bitmap bounds let link."""
    a, b = (nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}")) for s in "ab")
    near = lambda x, y: F.col(x) * den >= F.col(y) * num
    both = pairs.join(a, "a").join(b, "b").where(near("na", "nb") & near("nb", "na"))

    def bound(batches):
        for x in batches:
            if not x.num_rows:
                continue
            n = x.column("na").to_numpy() + x.column("nb").to_numpy()
            place = np.arange(x.num_rows)
            far = Bitmaps(pa.concat_arrays([x.column("bitsa"), x.column("bitsb")])).difference(place, place + x.num_rows)
            yield x.filter(pa.array((n - far) // 2 >= -(-num * n // (num + den)))).select(["a", "b"])

    return both.mapInArrow(bound, "a long, b long")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, by exact intersection."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct()
    wanted = scratch.keep(nodes.join(wanted, F.col("node") == F.col("m")).select("node", "rep"))

    def sets(batches):
        for b in batches:
            x = list(textnum.shingle_sets(b.column(1), k))
            key = [set_key(s) for s in x]
            ok = [p == q for p, q in zip(key, b.column(0).to_pylist())]
            yield pa.record_batch({"node": pa.array(key, pa.int64()).filter(pa.array(ok, pa.bool_())), "items": pa.array([s.tobytes() for s in x], pa.binary()).filter(pa.array(ok, pa.bool_()))})

    near = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda x: x
    texts = docs.select("doc_id", "text").join(near(wanted), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    arrays = scratch.keep(texts.mapInArrow(sets, "node long, items binary").dropDuplicates(["node"]))

    def verify(batches):
        for b in batches:
            keep = []
            for p, q in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                o = int((y[at] == x).sum())
                keep.append(den * o >= num * (len(x) + len(y) - o))
            if any(keep):
                yield b.filter(pa.array(keep)).select(["a", "b"])

    x = arrays.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = arrays.select(F.col("node").alias("b"), F.col("items").alias("y"))
    out = scratch.materialize_narrow(pairs.join(x, "a").join(y, "b").mapInArrow(verify, "a long, b long"))
    scratch.drop(arrays, wanted)
    return out


def _nodes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node and more per row; node, component of the nodes): component is the least doc_id."""
    docs = docs.select("doc_id", "text")
    scratch.ship(docs.sparkSession)
    signed = scratch.materialize(_signatures(docs, k, num, den, _frequent(docs, k)))
    some = signed.where("n > 0")
    nodes = scratch.keep(
        some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    )
    listed = nodes.select(F.posexplode("prefix").alias("pos", "token"), F.col("n").cast("int"), "node")
    listed = listed.select("token", "n", "pos", "node").repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node")
    tiles = scratch.keep(listed.mapInArrow(_tiles(num, den), "token long, n int, pos int, node long, head long, prev long"))
    first = tiles.select(F.explode(F.array("head", "prev")).alias("o"), "node").where("o != node").groupBy("node", "o").agg(F.count(F.lit(1)).alias("c"))
    first = first.groupBy("node").agg(F.max_by("o", F.struct("c", "o")).alias("o"))
    first = first.select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b")).distinct()
    first = scratch.materialize_narrow(_likely(first, nodes, num, den))
    links = _linked(first, nodes, docs, k, num, den)
    comp = connected(links)
    scratch.drop(first, links)
    for span in (True, False):
        small, large, open_ = _open_tiles(tiles, nodes, comp)
        held = large.mapInArrow(_pairs(num, den, span), "a long, b long")
        if span:  # all pairs of small tiles, once
            pairs = small.mapInArrow(_pairs(num, den, False), "a long, b long").distinct()
            held = held.unionByName(_likely(pairs, nodes, num, den))
        held = scratch.materialize_narrow(held.distinct())
        scratch.drop(open_)
        links, before = _linked(held, nodes, docs, k, num, den), comp
        comp = extended(before, links)
        scratch.drop(held, links, before)
    scratch.drop(tiles)
    named = nodes.select("node", "rep").join(comp, "node", "left").select("node", "rep", F.coalesce("c", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component"))
    named = scratch.materialize_narrow(named.join(least, "c").select(F.col("node").alias("m"), "component"))
    scratch.drop(nodes)
    return signed, named


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per document; documents link when den * |A & B| >= num * |A | B|."""
    signed, named = _nodes(docs, k, num, den)
    return signed.join(named, F.col("node") == F.col("m"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: of those of the smallest doc_id one. Documents without words all stay.

    The rows that go are looked for by doc_id and a hash of the text; texts do not pass through Python again.
    """
    id_, text_ = scratch.fresh(docs.columns, "id", "hash")
    signed, named = _nodes(docs, k, num, den)
    # rows that share doc_id and text are copies; of the texts of a component's least doc_id the least stays
    mine = signed.where("n > 0").join(named, F.col("node") == F.col("m")).groupBy("component", "node", "doc_id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    best = mine.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "node", "hash")).alias("x"))
    judged = mine.join(best.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c"))
    stays = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("hash") == F.col("x.hash")) & (F.col("node") == F.col("x.node"))
    judged = scratch.materialize_narrow(judged.select(F.col("doc_id").alias(id_), F.col("hash").alias(text_), stays.alias("stays"), "rows").where("NOT stays OR rows > 1"))
    near = F.broadcast if judged.count() <= BROADCAST_ROWS else lambda x: x
    gone, several = near(judged.where("NOT stays").select(id_, text_).distinct()), judged.where("stays").select(id_, text_)
    (mark,) = scratch.fresh([*docs.columns, id_, text_], "mark")
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(text_))
    left = docs.withColumn(mark, _text_hash()).join(gone, on, "left_anti")
    if several.isEmpty():
        return left.select(*docs.columns)
    once = left.join(near(several), on, "left_semi").dropDuplicates(["doc_id", mark])
    return left.join(near(several), on, "left_anti").unionByName(once).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
x AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
c AS (WITH RECURSIVE t(r, top) AS (SELECT r, r FROM s UNION SELECT l.b, t.top FROM t JOIN l ON l.a = t.r)
      SELECT t.r, min(s.doc_id) AS component_id FROM t JOIN s ON s.r = t.top GROUP BY t.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c USING (r)
"""
