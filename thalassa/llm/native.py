"""Column builders shared by the operators that stay within DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lowered(c: Column) -> Column:
    """A-Z to a-z, all other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The maximal runs of characters other than 0x20 and 0x09-0x0D, in order."""
    trimmed = F.btrim(c, F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def n_words(c: Column) -> Column:
    trimmed = F.btrim(c, F.lit(_TRIM))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE, -1))).cast("long")


def running(a: Column, block: int = 256) -> Column:
    """Inclusive prefix sums of array<int>. Two levels, so that the work is n * block and not n squared."""
    none = F.array().cast("array<int>")
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / block).cast("int"), F.lit(0))), lambda i: F.slice(a, i * block + 1, F.lit(block))
    )
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda t, x: t + x))
    before = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("t"), none.alias("o")),
        lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["o"], F.array(s["t"])).alias("o")),
        lambda s: s["o"],
    )
    inner = F.zip_with(
        parts,
        before,
        lambda p, o: F.aggregate(
            p,
            F.struct(o.alias("t"), none.alias("o")),
            lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["o"], F.array(s["t"] + x)).alias("o")),
            lambda s: s["o"],
        ),
    )
    return F.when(F.size(a) == 0, none).otherwise(F.flatten(inner))


def spans(matches: Column, pieces: Column) -> Column:
    """array<struct<s,e,m>> from all matches of a pattern and the pieces of split() by it: code points, e exclusive."""
    n = F.size(matches)
    both = F.zip_with(F.slice(pieces, F.lit(1), n), matches, lambda p, m: F.length(p) + F.length(m))
    return F.when(n > 0, F.zip_with(running(both), matches, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))).otherwise(
        F.array().cast("array<struct<s:int,e:int,m:string>>")
    )


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def replaced(text: Column, cuts: Column) -> Column:
    """text with each of the sorted cuts (struct s, e, by) replaced by its `by`; overlapping cuts become one."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        cuts,
        state,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] >= a["at"], F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), x["by"])))
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
