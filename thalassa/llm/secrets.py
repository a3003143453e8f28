"""Secret scan (DataFrame functions only): three patterns, and a randomness test battery over all other long tokens.

Battery. A token's encoding is inferred from its letters (decimal, hex, base32, base36, base64); a token of letters of
one case, or with one capital first, is a word and not tested. Over the encoding's alphabet of k symbols:
  chi-squared   X2 = k/n * sum(count^2) - n, the uniformity of the symbols, both tails
  runs          Wald-Wolfowitz on symbols below and above the middle of the alphabet, both tails
  serial        lag-1 correlation of the symbols' ranks, times sqrt(n), both tails
Fisher's method combines the three into one p-value, `random`, that is uniform for uniformly random tokens.

False-discovery control. Tokens are judged among those of their encoding and length class in the whole corpus, so short
tokens, which say little, meet short ones. With A(t) the tokens of `random` >= t, the random ones are estimated as
R = (A(1/2) + 1) / (1/2), so that A(t) - (1 - t) R of the tokens above t are not random. The least t from RANDOM_LEAST
on at which these are at most RATE of A(t) is the threshold. Encodings that can hold words (base32, base36, base64) must
also be told from written text: the lower tail of sum(count^2) under the repeated letters of written text gives a second
p-value, `text`, of which Benjamini-Hochberg at RATE takes the discoveries.

The thresholds need only histograms of p-values: (encoding, length class, kind, bin) counts, at most 5 * 6 * 2 * BINS
rows, whatever the corpus. The corpus is scanned twice and nothing else is shuffled.

Cases: a null text is empty; an empty text has no spans, and the digest of the empty string. Repeated rows are judged
alike, each. Very long texts and tokens cost in proportion to their length. Other columns are kept; scan() replaces a
column of the name of its result, redact() adds none. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native, scratch

#: The contract's patterns. Bounded repeats that equal "match, then drop if shorter" are written as such.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Tokens that the battery looks at: 20 or more letters of base64 or base64url.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
RATE = 0.05
RANDOM_LEAST = 0.01
#: The chance that two letters of written text are equal.
TEXT_MATCH = 0.066
BINS = 200
CLASSES = 6
#: Encodings (by place in ALPHABETS) that can hold words.
WORDY = (2, 3, 4)
ALPHABETS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base64": (".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def _normal(z: Column) -> Column:
    """P(N(0,1) < z), a logistic fit good to 2e-4 that keeps the order of the tails."""
    return 1 / (1 + F.exp(-F.least(F.greatest(1.5976 * z + 0.070565 * z * z * z, F.lit(-500.0)), F.lit(500.0))))


def bind(f, **values: Column) -> Column:
    """f of a struct of values that are computed once: a plain column in a lambda is computed for each element."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def battery(token: Column) -> Column:
    """struct<code, size, text, random>: index of the encoding, length class, and the two p-values of a token."""
    body = F.translate(token, "-_", "+/")
    code = F.lit(len(ALPHABETS) - 1)
    for i, (_, (shape, _)) in reversed(list(enumerate(list(ALPHABETS.items())[:-1]))):
        code = F.when(body.rlike(shape), F.lit(i)).otherwise(code)
    alphabets = F.array(*[F.lit(a) for _, a in ALPHABETS.values()])
    zero = F.lit(0.0)

    def of(x: Column) -> Column:
        alphabet = F.element_at(alphabets, x["code"] + 1)
        return bind(measure, code=x["code"], s=F.when(x["code"].isin(1, 3), F.lower(x["body"])).otherwise(x["body"]), alphabet=alphabet)

    def measure(x: Column) -> Column:
        chars = F.filter(F.split(x["s"], ""), lambda c: c != "")
        count = lambda c: F.length(x["s"]) - F.length(F.replace(x["s"], c, F.lit("")))
        counts = F.transform(F.array_distinct(chars), lambda c: count(c).cast("double"))
        ranks = F.transform(chars, lambda c: F.instr(x["alphabet"], c).cast("double"))
        n, k = F.length(x["s"]).cast("double"), F.length(x["alphabet"]).cast("double")
        return bind(sums, code=x["code"], n=n, k=k, squares=F.aggregate(counts, zero, lambda a, c: a + c * c), ranks=ranks)

    def sums(x: Column) -> Column:
        high = F.transform(x["ranks"], lambda v: v > x["k"] / 2)
        mu = F.aggregate(x["ranks"], zero, lambda a, v: a + v) / x["n"]
        same = {c: x[c] for c in ("code", "n", "k", "squares")}
        return bind(turned, **same, high=high, above=F.aggregate(high, zero, lambda a, v: a + v.cast("double")), mu=mu, ranks=x["ranks"])

    def turned(x: Column) -> Column:
        turns = F.aggregate(F.zip_with(F.slice(x["high"], F.lit(2), F.size(x["high"])), x["high"], lambda a, b: F.coalesce((a != b).cast("double"), zero)), F.lit(1.0), lambda a, v: a + v)
        off = F.transform(x["ranks"], lambda v: v - x["mu"])
        same = {c: x[c] for c in ("code", "n", "k", "squares", "above")}
        return bind(spread, **same, turns=turns, off=off)

    def spread(x: Column) -> Column:
        var = F.aggregate(x["off"], zero, lambda a, v: a + v * v)
        lag = F.aggregate(F.zip_with(F.slice(x["off"], F.lit(2), F.size(x["off"])), x["off"], lambda a, b: F.coalesce(a * b, zero)), zero, lambda a, v: a + v)
        same = {c: x[c] for c in ("code", "n", "k", "squares", "above", "turns")}
        return bind(tests, **same, var=var, lag=lag, mean=2 * x["above"] * (x["n"] - x["above"]) / x["n"] + 1)

    def tests(x: Column) -> Column:
        n, k, pairs = x["n"], x["k"], x["n"] * (x["n"] - 1) / 2
        uniform = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        text = ((x["squares"] - n) / 2 - pairs * TEXT_MATCH) / F.sqrt(pairs * TEXT_MATCH)
        wide = F.sqrt(F.greatest((x["mean"] - 1) * (x["mean"] - 2) / (n - 1), F.lit(1e-9)))
        runs = F.when((x["above"] == 0) | (x["above"] == n), F.lit(9.0)).otherwise(F.abs(x["turns"] - x["mean"]) / wide)
        serial = F.when(x["var"] == 0, F.lit(9.0)).otherwise(F.abs(x["lag"] / x["var"]) * F.sqrt(n))
        return bind(combined, code=x["code"], n=n, text=_normal(text), z=F.array(F.abs(uniform), runs, serial))

    def combined(x: Column) -> Column:
        t = F.aggregate(x["z"], zero, lambda a, z: a - F.log(F.greatest(2 * (1 - _normal(z)), F.lit(1e-12))))
        size = F.least(F.floor(F.log2(x["n"] / 20) * 2), F.lit(CLASSES - 1)).cast("int")
        return bind(lambda y: F.struct(y["code"].alias("code"), y["size"].alias("size"), y["text"].alias("text"), (F.exp(-y["t"]) * (1 + y["t"] + y["t"] * y["t"] / 2)).alias("random")), code=x["code"], size=size, text=x["text"], t=t)

    return bind(of, code=code, body=body)


def _bins(x: Column) -> tuple[Column, Column]:
    """Bins of the p-values, 0 to BINS - 1: of `text` by its logarithm down to 1e-10, of `random` as it is."""
    low = F.floor((F.log10(F.greatest(x["text"], F.lit(1e-10))) / 10 + 1) * BINS)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), b)).cast("int") for b in (low, F.floor(x["random"] * BINS)))


def _tokens(text: Column) -> Column:
    shape = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[a-z]+)$"
    return F.when(text.rlike(TOKEN), F.filter(found_at(text, TOKEN), lambda x: ~x["m"].rlike(shape))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


def found_at(text: Column, pattern: str) -> Column:
    return native.spans(native.found(text, pattern), F.split(text, pattern, -1))


def benjamini_hochberg(counts: list[int], rate: float) -> int:
    """The highest bin of `text` that is a discovery, -1 if none is."""
    m, seen, top = sum(counts), 0, -1
    for b, n in enumerate(counts):
        seen += n
        if n and 10 ** (10 * ((b + 1) / BINS - 1)) <= rate * seen / m:
            top = b
    return top


def least_random(counts: list[int], rate: float) -> int:
    """The lowest bin of `random` from which on at most `rate` of the tokens are estimated not to be random."""
    above = lambda b: sum(counts[b:])
    random = (above(BINS // 2) + 1) * 2
    for b in range(round(RANDOM_LEAST * BINS), BINS // 2):
        if above(b) - (1 - b / BINS) * random <= rate * above(b):
            return b
    return BINS // 2


def thresholds(docs: DataFrame, rate: float = RATE) -> dict[tuple[int, int], tuple[int, int]]:
    """(encoding, length class): (highest bin of `text`, lowest bin of `random`) of a discovery; at most 30."""
    tested = docs.select(F.explode(F.transform(_tokens(native.text_of("text")), lambda x: battery(x["m"]))).alias("t"))
    text, random = _bins(F.col("t"))
    both = tested.select("t.code", "t.size", F.explode(F.array(F.struct(F.lit(0).alias("kind"), text.alias("bin")), F.struct(F.lit(1).alias("kind"), random.alias("bin")))).alias("b"))
    held: dict[tuple[int, int], list[list[int]]] = {}
    for r in both.groupBy("code", "size", "b.kind", "b.bin").count().collect():
        held.setdefault((r["code"], r["size"]), [[0] * BINS, [0] * BINS])[r["kind"]][r["bin"]] = r["count"]
    return {k: (benjamini_hochberg(t, rate) if k[0] in WORDY else BINS, least_random(r, rate)) for k, (t, r) in held.items()}


def scan(docs: DataFrame, rate: float = RATE, out: str = "secrets") -> DataFrame:
    """docs with `out`: array<struct<s, e, k>> sorted by start and kind (k indexes KINDS); e exclusive, code points."""
    limits = thresholds(docs, rate)
    text_, assign_, access_, hex_, token_, base_ = scratch.fresh([*docs.columns, out], "text", "assign", "access", "hex", "token", "base")
    text = F.col(text_)
    df = docs.withColumn(text_, native.text_of("text"))
    df = df.withColumn(assign_, F.when(text.rlike(ASSIGN), F.arrays_zip(found_at(text, ASSIGN).alias("x"), native.found(text, ASSIGN, 2).alias("v"))))
    df = df.withColumn(access_, F.when(text.contains("AKIA"), found_at(text, ACCESS)))
    df = df.withColumn(hex_, F.when(text.rlike(HEX), found_at(text, HEX)))
    df = df.withColumn(token_, _tokens(text))
    kind = lambda a, k: F.coalesce(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"))), F.array().cast("array<struct<s:int,e:int,k:int>>"))
    assign = F.transform(F.filter(F.col(assign_), lambda x: F.length(x["v"]) >= ASSIGN_LEAST), lambda x: x["x"])
    df = df.withColumn(base_, F.concat(kind(assign, 0), kind(F.col(access_), 1), kind(F.col(hex_), 2)))
    cells = [(c, z) for c in range(len(ALPHABETS)) for z in range(CLASSES)]
    top, least = (F.array(*[F.lit(limits.get(c, (-1, BINS))[i]) for c in cells]) for i in (0, 1))

    def discovered(x: Column) -> Column:
        at = x["t"]["code"] * CLASSES + x["t"]["size"] + 1
        text, random = _bins(x["t"])
        return (random >= F.element_at(least, at)) & (text <= F.element_at(top, at))

    free = F.filter(F.col(token_), lambda t: ~F.exists(F.col(base_), lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    tested = F.transform(free, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["m"]).alias("t")))
    df = df.withColumn(out, F.array_sort(F.concat(F.col(base_), kind(F.filter(tested, discovered), 3)), _by_start))
    return df.drop(text_, assign_, access_, hex_, token_, base_)


def _by_start(a: Column, b: Column) -> Column:
    """Order by start, then kind, then end."""
    out = F.lit(0)
    for f in ("e", "k", "s"):
        out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, if there, counts the new text."""
    (found,) = scratch.fresh(docs.columns, "secrets")
    df = scan(docs, rate, found)
    cuts = F.transform(_merged(F.col(found)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(mark).alias("by")))
    df = df.withColumn("text", F.when(F.size(found) > 0, native.replaced(F.col("text"), cuts)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones as one."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        me = F.struct(x["s"].alias("s"), x["e"].alias("e"))
        return F.when(F.size(a) == 0, F.array(me)).when(
            x["s"] < last["e"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        ).otherwise(F.concat(a, F.array(me)))

    return F.aggregate(spans, empty, add)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = F.col("secrets")
    n = lambda k: F.size(F.filter(s, lambda x: x["k"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["k"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(s).alias("spans"),
        n(3).alias("n_random"),
    )
