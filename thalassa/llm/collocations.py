"""Phrase collocations by hierarchical pair naming.

Frequent words get global numbers (names). Then, level by level, two adjacent names of (k-1)-grams become one name of a
k-gram: pairs are counted over all texts, those of `least` occurrences and more are numbered by one join, and texts
go on as sequences of the new names. Every part of a phrase is at least as frequent as the phrase, so no candidate is
lost. The two halves of a pair are parent pointers: l is the phrase without its last word, r without its first. Counts
of all first and last parts travel along them, which gives every cut of a phrase; going up by one level is enough to
find whether a longer candidate covers a phrase, since what covers it by two levels is no more frequent than the level
between.

Texts travel as chunks of about CHUNK_BYTES of one lang with word numbers of their own, cut at the ends of pieces, so a
chunk sends each of its distinct pairs once, with a count. A frequent word or pair is then one row a chunk at most, and
these are summed before the shuffle. Tables of names are sent to all tasks while they have at most BROADCAST_ROWS rows;
larger ones are joined by key to the distinct pairs of each chunk, at most as many rows as there are words.

Cases: a null text is empty; a null lang is `und`, together with rows of that lang; blank pieces have no phrases;
repeated rows count again; equal scores go by count, then by phrase in byte order; an empty table gives no rows. Other
columns are ignored, whatever their names. Counts are longs and scores exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import native, scratch, textnum

LEAST, LONGEST = 30, 4
#: A phrase goes if a longer candidate has this part of its occurrences.
COVERED = (80, 100)
SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"
CHUNK_BYTES = 2 << 20
BROADCAST_ROWS = 1 << 20
#: Chunks are long rows: row groups are small, so that a reader holds few of them at once.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
#: Rankings of one lang are cut to its first rows in so many parts before they meet.
PARTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = _BREAK.copy()
_BLANK[list(b" \t")] = True
_CHUNK = "chunk long, lang string, n long, words array<string>, counts array<int>, at array<int>"


def _stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets of rows) of about CHUNK_BYTES; longer rows are cut at the ends of pieces."""
    for _, data, offsets in textnum.slices(column):
        lo = 0
        while len(data) - lo > 2 * CHUNK_BYTES:
            ends = np.flatnonzero(_BREAK[data[lo : lo + CHUNK_BYTES]])
            if not len(ends):
                ends = np.flatnonzero(_BREAK[data[lo:]])[:1]
            if not len(ends):
                break
            hi = lo + int(ends[-1]) + 1
            yield data[lo:hi], np.append(np.append(lo, offsets[(offsets > lo) & (offsets < hi)]), hi) - lo
            lo = hi
        yield data[lo:], np.append(lo, offsets[offsets > lo]) - lo


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words in lower case, and which of them begin a piece."""
    low = textnum._LOWER[data]
    solid = ~_BLANK[low]
    first, final = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    final[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] |= solid[edge]
    final[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(final) + 1 - starts)).astype(np.int32)
    piece = np.cumsum(_BREAK[low])[starts] + np.searchsorted(offsets, starts, "right")
    opens = np.append(True, piece[1:] != piece[:-1])[: len(starts)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(low[solid].tobytes())), opens


def _chunk(key: int, lang: str, parts: list) -> pa.RecordBatch:
    coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    codes, opens = coded.indices.to_numpy(), np.concatenate([o for _, o in parts])
    at = np.full(len(codes) + int(opens.sum()) - 1, -1, np.int32)
    at[np.arange(len(codes)) + np.cumsum(opens) - 1] = codes
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    cut = pa.array([0, len(coded.dictionary)], pa.int32())
    return pa.record_batch(
        {
            "chunk": pa.array([key], pa.int64()), "lang": pa.array([lang]), "n": pa.array([len(codes)], pa.int64()),
            "words": pa.ListArray.from_arrays(cut, coded.dictionary),
            "counts": one(np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32), pa.int32()), "at": one(at, pa.int32()),
        }
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 36
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for data, offsets in _stretches(b.column("text").filter(pa.compute.equal(langs.indices, i))):
                words, opens = _words(data, offsets)
                if not len(words):
                    continue
                held.setdefault(lang, []).append((words, opens))
                size[lang] = size.get(lang, 0) + len(data)
                if size[lang] >= CHUNK_BYTES or sum(size.values()) >= 8 * CHUNK_BYTES:
                    full = max(size, key=size.get)
                    yield _chunk(key, full, held.pop(full))
                    del size[full]
                    key += 1
    for lang, parts in held.items():
        yield _chunk(key, lang, parts)
        key += 1


def _lists(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    c = b.column(name)
    flat, off = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]


def _adjacent(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the neighbours in `at` that both have a name: (where, left and right of each distinct pair, which pair, counts)."""
    ok = (at[:-1] >= 0) & (at[1:] >= 0)
    key, which, count = np.unique(at[:-1][ok].astype(np.int64) * n + at[1:][ok], return_inverse=True, return_counts=True)
    return ok, key, which.reshape(-1), count


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, at, ids in zip(b.column("chunk").to_pylist(), _lists(b, "at"), _lists(b, "ids"), strict=True):
            _, key, _, count = _adjacent(at, len(ids))
            if len(key):
                yield pa.record_batch({"chunk": np.full(len(key), chunk), "code": np.arange(len(key), dtype=np.int32), "l": ids[key // len(ids)], "r": ids[key % len(ids)], "n": count})


class Names:
    """The names of a level, small enough to be sent to all tasks: by word for each lang, or by pair."""

    def __init__(self, table: pa.Table, level: int):
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type)
        self.ids = column("id").to_numpy()
        if level == 1:
            langs = column("lang").dictionary_encode()
            self.of = {}
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = pa.compute.equal(langs.indices, i)
                self.of[lang] = column("word").filter(own), column("id").filter(own).to_numpy()
            return
        # a pair is one number: the place of its left among all lefts, and of its right
        (self.left, i), (self.right, j) = (np.unique(column(c).to_numpy(), return_inverse=True) for c in ("l", "r"))
        key = i.reshape(-1) * len(self.right) + j.reshape(-1)
        order = np.argsort(key)
        self.key, self.ids = key[order], self.ids[order]

    def words(self, lang: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(which words have a name, their names)."""
        known, ids = self.of.get(lang, (pa.array([], pa.string()), np.zeros(0, np.int64)))
        at = pa.compute.fill_null(pa.compute.index_in(words, known), -1).to_numpy()
        codes = np.flatnonzero(at >= 0)
        return codes, ids[at[codes]]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        find = lambda among, x: np.minimum(np.searchsorted(among, x), len(among) - 1)
        i, j = find(self.left, left), find(self.right, right)
        key = i * len(self.right) + j
        at = find(self.key, key)
        codes = np.flatnonzero((self.left[i] == left) & (self.right[j] == right) & (self.key[at] == key))
        return codes, self.ids[at[codes]]


def _renamed(level: int, sent=None):
    """Chunks in which the names of the last level give way to those of this one, as far as they have any.

    The names are sent to all tasks, or have been joined to each chunk as codes and named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (chunk, at) in enumerate(zip(b.column("chunk").to_pylist(), _lists(b, "at"), strict=True)):
                if level > 1:
                    old = b.column("ids")[i].values.to_numpy()
                    ok, key, which, _ = _adjacent(at, len(old))
                    at = np.full(len(ok), -1, np.int64)
                    at[ok] = which
                if sent is None:
                    codes, ids = b.column("codes")[i].values.to_numpy(), b.column("named")[i].values.to_numpy()
                elif level == 1:
                    codes, ids = sent.value.words(b.column("lang")[i].as_py(), b.column("words")[i].values)
                else:
                    codes, ids = sent.value.pairs(old[key // len(old)], old[key % len(old)])
                if not len(codes):
                    continue
                to = np.full(int(max(codes.max(), at.max())) + 2, -1, np.int32)
                to[codes] = np.arange(len(codes))
                at = to[at]  # the last entry, for -1, is -1
                keep = (at >= 0) | np.append(True, at[:-1] >= 0)
                yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "at": pa.array([at[keep]], pa.list_(pa.int32())), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return run


def _named(chunks: DataFrame, seen: DataFrame, names: DataFrame, on: list[str], level: int) -> DataFrame:
    """The chunks in the names of this level. seen: chunk, code and the columns `on` of the distinct items of each."""
    key, schema = names.select(*on, "id"), "chunk long, at array<int>, ids array<long>"
    if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sent = chunks.sparkSession.sparkContext.broadcast(Names(key.toArrow(), level))
        return scratch.materialize(chunks.mapInArrow(_renamed(level, sent), schema), ROW_GROUPS)
    found = seen.join(key, on).groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("found"))
    found = found.select("chunk", F.col("found.code").alias("codes"), F.col("found.id").alias("named"))
    old = chunks.select("chunk", "at", *(["ids"] if level > 1 else []))
    return scratch.materialize(old.join(found, "chunk").mapInArrow(_renamed(level), schema), ROW_GROUPS)


def _numbered(counts: DataFrame, least: int) -> DataFrame:
    return scratch.materialize(counts.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """([phrases of 1 word, of 2, ...], words per lang): all of `least` and more occurrences within a piece.

    Phrases: id, lang, words, f, pre, suf (counts of the first and last 1, 2, ... words), and from 2 words on the ids
    l and r of the phrases without the last and the first word. Words per lang: lang, n.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    texts = docs.select(native.text_of("text").alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    chunks = scratch.materialize(texts.mapInArrow(_chunks, _CHUNK), ROW_GROUPS)
    total = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    each = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
    each = each.select("chunk", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    names = _numbered(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), least)
    levels = [names.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("pre"), F.array("f").alias("suf"))]
    named = _named(chunks, each, names, ["lang", "word"], 1)
    total = scratch.materialize(total)
    scratch.drop(chunks)
    for level in range(2, longest + 1):
        seen = named.mapInArrow(_pairs, "chunk long, code int, l long, r long, n long")
        names = _numbered(seen.groupBy("l", "r").agg(F.sum("n").alias("f")), least)
        left, right = (levels[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in levels[-1].columns if c not in ("l", "r")]) for side in "lr")
        both = names.join(left, F.col("l") == F.col("l_id")).join(right, F.col("r") == F.col("r_id"))
        last = F.array(F.element_at("r_words", -1))
        own = F.array("f")
        levels.append(scratch.materialize(both.select("id", "l", "r", F.col("l_lang").alias("lang"), F.concat("l_words", last).alias("words"), "f", F.concat("l_pre", own).alias("pre"), F.concat("r_suf", own).alias("suf"))))
        if level < longest:
            before, named = named, _named(named, seen, names, ["l", "r"], level)
            scratch.drop(before)
        scratch.drop(names)
    scratch.drop(named)
    return levels, total


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: tuple[int, int] = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each lang's `top` phrases of 2 to `longest` words.

    cut is the number of words before the cut of the lowest score.
    """
    levels, total = phrases(docs, least, longest)
    big = lambda c: c.cast("decimal(20,0)")
    kept = None
    for k in range(2, longest + 1):
        these = levels[k - 1].select("id", "lang", "words", F.col("f").alias("a"), "pre", "suf")
        if k < longest:
            up = levels[k]
            longer = up.select(F.col("l").alias("id"), "f").unionByName(up.select(F.col("r").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            part, whole = covered
            hides = F.coalesce(big(F.col("longer")) * whole >= big(F.col("a")) * part, F.lit(False))
            these = these.join(longer, "id", "left").where(~hides).drop("longer")
        kept = these if kept is None else kept.unionByName(these)

    def cut(j):
        first, rest = F.get("pre", j - 1), F.get("suf", F.size("words") - j - 1)
        score = F.floor(big(F.col("a")) * SCALE / (big(first) + big(rest))).cast("long")
        # the quotient of decimals is rounded: settle the last unit in integers
        over = (big(score) * (big(first) + big(rest)) > big(F.col("a")) * SCALE).cast("long")
        return F.struct((score - over).alias("score"), j.alias("j"), first.alias("l"), rest.alias("r"))

    scored = kept.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), F.col("best.j").alias("cut"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")).drop("cut")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, g, count(*)::BIGINT AS a FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k >= 2),
covered AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN
              (SELECT lang, a, unnest([g[1:k - 1], g[2:k]]) AS part FROM c WHERE k >= 3) u ON u.lang = s.lang AND u.part = s.g AND 100 * u.a::HUGEINT >= 80 * s.a::HUGEINT),
covered2 AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN (SELECT lang, a, g[2:3] AS part FROM c WHERE k = 4) u
               ON u.lang = s.lang AND u.part = s.g AND 100 * u.a::HUGEINT >= 80 * s.a::HUGEINT),
cuts AS (SELECT c.lang, c.g, c.a, c.k, unnest(range(1, c.k)) AS j FROM c
         WHERE NOT EXISTS (SELECT 1 FROM covered x WHERE x.lang = c.lang AND x.g = c.g) AND NOT EXISTS (SELECT 1 FROM covered2 x WHERE x.lang = c.lang AND x.g = c.g)),
s AS (SELECT cuts.lang, cuts.g, cuts.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * cuts.a // (l.a + r.a))::BIGINT AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = cuts.g[1:j] JOIN f r ON r.lang = cuts.lang AND r.g = cuts.g[j + 1:cuts.k]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
