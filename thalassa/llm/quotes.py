"""Quotation linking: nested quote levels, hashes of quoted passages joined to the messages they come from.

A line's level is the number of '>' marks before its text. A passage is a run of non-blank lines of one level; its key
is the hash of its words (A-Z as a-z, punctuation at either end dropped), and each line of a longer passage has a key
too. A message owns its passages of level 0. A quoted key belongs to the earliest turn of the conversation that owns it,
if that is before the quoting turn, else to the earliest (conv_id, turn) that owns it elsewhere. The parent of a message
is the source of most quoted words of its lowest linked level, ties to the later turn of the own conversation.

Links within a conversation make threads: thread_turn is the first message above, depth the number of links to it. As
parents come before replies, (conv_id, thread_turn, turn) is a reply order; conversations() range-sorts by it, so a
conversation may span partitions and none is gathered. The own text has no quotes and no "... wrote:" lines before them.

Only messages with '>' are parsed line by line, and own passages are aggregated by key before they are shuffled, so a
passage that stands in a third of all messages is one row per task. A passage that is quoted in a third of all messages
meets its owner in a broadcast (see HOT). Quoted keys travel with a broadcast only up to BROADCAST_KEYS; more are joined
by shuffle.

Cases: a null text is empty; an empty text has an empty reply. A null conv_id or turn keeps its row and links with
nothing. Repeated (conv_id, turn) rows link as one message and keep a row each. Other columns are kept, but for those
of the names that link() adds. An empty table
gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, textnum

BROADCAST_KEYS = 200_000
#: Keys of more than one in HOT quoted passages are broadcast with their owners.
HOT = 1000
#: What link() adds.
ADDED = ("reply", "n_quotes", "max_level", "parent_conv", "parent_turn", "n_linked", "thread_turn", "depth")
_MARK = re.compile(r"^(?:[ \t]{0,3}>)+")
_WROTE = re.compile(r"(?:^On .*|^Am .*|^Le .*)?(?:wrote|writes|schrieb[^:]*|a écrit)\s?:\s*$")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def parse(text: str) -> list[tuple[int, str]]:
    """(level, text after the marks) of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARK.match(line)
        out.append((m[0].count(">"), line[m.end() :].strip(" \t\r")) if m else (0, line.rstrip("\r")))
    return out


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Runs of non-blank lines of one level."""
    out: list[tuple[int, list[str]]] = []
    open_ = False
    for level, line in lines:
        if not line.strip():
            open_ = False
        elif open_ and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
            open_ = True
    return out


def normalised(text: str) -> str:
    words = (_EDGE.sub("", w) for w in text.translate(_LOWER).split())
    return " ".join(w for w in words if w)


_LOWER = {i: i + 32 for i in range(65, 91)}


def own_text(lines: list[tuple[int, str]]) -> str:
    """The lines of level 0, without the attribution before a quote, blank lines around removed quotes closed up."""
    out: list[str] = []
    quoted = False
    for level, line in lines:
        if level:
            if not quoted:
                while out and not out[-1].strip():
                    out.pop()
                if out and _WROTE.search(out[-1]):
                    out.pop()
                while out and not out[-1].strip():
                    out.pop()
            quoted = True
        elif line.strip() or not quoted:
            if quoted and out:
                out.append("")
            quoted = False
            out.append(line)
    return "\n".join(out)


def keys(parts: list[tuple[int, list[str]]], own: bool) -> list[tuple[str, int, int]]:
    """(normalised text, level, words) of the passages, and of their lines if they have several."""
    out = {}
    for level, lines in parts:
        if (level == 0) == own:
            for text in {" ".join(lines), *(lines if len(lines) > 1 else ())}:
                if n := normalised(text):
                    out.setdefault((n, level), n.count(" ") + 1)
    return [(n, level, c) for (n, level), c in out.items()]


def _hash(texts: list[str]) -> pa.Array:
    """Hashes of normalised texts by their words."""
    out = [np.zeros(0, np.uint64)]
    for _, data, offsets in textnum.slices(pa.array(texts, pa.string())):
        h, row, _ = textnum.words(data, offsets)
        n = len(offsets) - 1
        place = np.arange(len(h)) - np.searchsorted(row, row)
        s = np.zeros(n, np.uint64)
        np.add.at(s, row, textnum.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out.append(textnum.mix(s))
    return pa.array(np.concatenate(out).view(np.int64))


def _keys(messages: DataFrame, own: bool) -> DataFrame:
    """(conv_id, turn, key, level, words) of the own or of the quoted passages."""

    def run(batches):
        for b in batches:
            rows, texts, level, words = [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if own and ">" not in t:
                    parts = passages([(0, x) for x in t.split("\n")])
                else:
                    parts = passages(parse(t))
                for n, k, c in keys(parts, own):
                    rows.append(i), texts.append(n), level.append(k), words.append(c)
            if rows:
                at = pa.array(rows, pa.int64())
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), _hash(texts), pa.array(level, pa.int32()), pa.array(words, pa.int32())], names=["conv_id", "turn", "key", "level", "words"])

    plain = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    if not own:
        plain = plain.where(F.col("text").contains(">"))
    return plain.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").mapInArrow(run, "conv_id long, turn long, key long, level int, words int")


def _by_key(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """left with the one row of right per key, if there is one. Keys of more than one in HOT rows of left, at most HOT of
    them, meet right in a broadcast; all others in a shuffle that no key fills."""
    names = [f"_{k}" for k in keys]
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(100, total // HOT)).drop("_n")
    hot = scratch.materialize(hot.withColumnsRenamed(dict(zip(keys, names))))
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    known = right.join(F.broadcast(hot), on, "left_semi").withColumnsRenamed(dict(zip(keys, names)))
    often = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(known), on, "left").drop(*names)
    return often.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, keys, "left"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv, parent_turn, n_linked of the messages with a linked quote."""
    quoted = scratch.materialize(_keys(messages, False))
    wanted = quoted.select("key").distinct()
    n = wanted.count()
    if not n:
        return quoted.select("conv_id", "turn", F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"), F.lit(0).cast("long").alias("n_linked"))
    own = _keys(messages, True).select("conv_id", "turn", "key")
    own = own.join(F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted, "key", "left_semi")
    first = scratch.materialize(own.groupBy("key", "conv_id").agg(F.min("turn").alias("own_turn")))
    # the two least owners, one of which is another conversation; tasks keep two rows of a key before the shuffle
    two = first.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("conv_id"))).where("place <= 2")
    at = F.struct("conv_id", "own_turn")
    far = two.groupBy("key").agg(F.min(at).alias("far"), F.max(at).alias("next"))
    each = scratch.materialize(quoted.dropDuplicates(["conv_id", "turn", "key", "level"]))
    total = each.count()
    each = _by_key(_by_key(each, first, ["key", "conv_id"], total), scratch.materialize(far), ["key"], total)
    here = F.col("own_turn") < F.col("turn")
    there = lambda f: F.when(F.col("far.conv_id") != F.col("conv_id"), F.col(f"far.{f}")).when(F.col("next.conv_id") != F.col("conv_id"), F.col(f"next.{f}"))
    each = each.select(
        "conv_id", "turn", "level", "words",
        F.when(here, F.col("conv_id")).otherwise(there("conv_id")).alias("parent_conv"),
        F.when(here, F.col("own_turn")).otherwise(there("own_turn")).alias("parent_turn"),
    ).where("parent_conv IS NOT NULL")
    votes = each.groupBy("conv_id", "turn", "level", "parent_conv", "parent_turn").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "words", (F.col("parent_conv") == F.col("conv_id")).alias("same"), "parent_turn", "parent_conv")).alias("x"), F.count(F.lit(1)).alias("n_linked")
    )
    return best.select("conv_id", "turn", F.col("x.parent_conv").alias("parent_conv"), F.col("x.parent_turn").alias("parent_turn"), "n_linked")


def _threads(found: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of linked messages, by pointer jumping: rounds grow with the logarithm of the depth."""
    at = scratch.materialize(found.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = at.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread_turn").alias("top"), F.col("depth").alias("d"))
        both = at.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread_turn") == F.col("t")), "left")
        new = scratch.materialize(both.select("conv_id", "turn", F.coalesce("top", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")))
        more = not new.where("moved").isEmpty()
        scratch.drop(at)
        at = new.drop("moved")
        if not more:
            return at


def link(messages: DataFrame) -> DataFrame:
    """messages with reply, n_quotes, max_level, parent_conv, parent_turn, n_linked, thread_turn, depth."""
    scratch.ship(messages.sparkSession)
    names = [c for c in messages.columns if c not in ADDED]
    messages = messages.select(*names)
    at = names.index("text")
    schema = messages.select("*", F.lit("").alias("reply"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("max_level")).schema

    def run(batches):
        for b in batches:
            reply, n, level = [], [], []
            for t in b.column(at).to_pylist():
                t = t or ""
                if ">" in t:
                    lines = parse(t)
                    quoted = [p for p, _ in passages(lines) if p]
                    reply.append(own_text(lines) if quoted else t), n.append(len(quoted)), level.append(max(quoted, default=0))
                else:
                    reply.append(t), n.append(0), level.append(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reply, pa.string()), pa.array(n, pa.int64()), pa.array(level, pa.int64())], names=[*names, "reply", "n_quotes", "max_level"])

    c, t, c2, t2 = scratch.fresh([*names, *ADDED], "c", "t", "c2", "t2")
    found = scratch.materialize(links(messages))
    parts = found.withColumnsRenamed({"conv_id": c, "turn": t})
    tops = _threads(found).withColumnsRenamed({"conv_id": c2, "turn": t2})
    out = messages.mapInArrow(run, schema)
    # one row per message on the right; the left side may hold a conversation with a third of all rows, keys include turn
    out = out.join(parts, (F.col("conv_id") == F.col(c)) & (F.col("turn") == F.col(t)), "left")
    out = out.join(tops, (F.col("conv_id") == F.col(c2)) & (F.col("turn") == F.col(t2)), "left")
    return out.select(*names, "reply", "n_quotes", "max_level", "parent_conv", "parent_turn", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("thread_turn", F.col("turn").cast("long")).alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """link() in reply order, range-sorted."""
    order = ["conv_id", "thread_turn", "turn"]
    return link(messages).repartitionByRange(*order).sortWithinPartitions(*order)


def query(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")).drop("text")
