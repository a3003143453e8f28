"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal them (DataFrame functions only).

The patterns find protected entities (email, ip, card, phone). A term discloses an entity if seeing it tells the
entity: with N documents, n(e) that hold the entity, df(t) that hold the term and c(e, t) that hold both,
    IC(e) = log2(N / n(e)),   PMI(t; e) = log2(N P(e | t) / n(e))   and   left(t; e) = IC - PMI = -log2 P(e | t),
the bits that still hide the entity from who sees the term. P(e | t) is c / df where that is certain, and here the lower
end of its interval (Wilson's, one-sided 95 %), so that any number of documents is judged. A term that leaves REMOVE bits
or fewer is removed, one that leaves GENERALISE or fewer is generalised, wherever it stands in the documents that hold the
entity, if it tells anything at all: its PMI has to be GAIN or more. What a term of one document leaves beside an entity of
that document is 1.89 bits, whatever the number of documents, so it is generalised; removed are terms of three documents
and more that always go with the entity, or of many that do so in more than half of them. An entity also counts as one of its group (domain of an email, first
three parts of an ip, first six digits of a card or phone).

Entities that stand in the same documents have equal counts with every term. They make one class, found by the sums of
hashes of their documents, so a page of a thousand addresses counts its terms once and not a thousand times. Documents of
many classes and terms are dealt out in parts.

Terms are runs of letters or digits. Counts cover all documents and whole texts; a row is a document. Counts of entity
and term are aggregated before they are shuffled. Entities and terms of a large part of the rows meet their counts in a
broadcast (at most HOT of each per distinct one of a document), all others in a shuffle. Terms and entities travel as
64-bit hashes.

Cases: a null text is empty; an empty text has no spans. Repeated rows share one verdict. An entity in all documents has
nothing to disclose. Other columns are kept; scan() replaces `found` and `terms`, sanitise() adds none. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native, scratch
from .secrets import found_at

#: The contract's patterns. Possessive repeats and look-behind match the same and stay linear on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
CARD_HINT = r"[0-9](?:[\x20-]?[0-9]){12}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "remove", "general")

Z = 1.645
#: Bits that a term leaves of an entity's information, and bits that it has to tell.
REMOVE, GENERALISE, GAIN = 1.0, 2.5, 0.5
TERM = r"[\p{L}\p{N}]++"
#: Keys of more than one in HOT rows are broadcast with their counts.
HOT = 1000
#: Pairs of class and term from which on a document's terms are dealt out in parts of so many.
MANY_PAIRS, PART = 1 << 20, 2048

_SPANS = "array<struct<s:int,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.transform(F.array(F.substring(digits, i, F.lit(1)).cast("int")), lambda d: F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))[0],
    )
    return total % 10 == 0


def _octet(p: Column) -> Column:
    short = F.ltrim(p, F.lit("0"))
    return F.when(F.length(short) > 3, False).otherwise(F.when(short == "", F.lit(0)).otherwise(short.cast("int")) <= 255)


def entities(text: Column) -> Column:
    """array<struct<s, e, m, k>> by kind, then start."""
    none = F.array().cast(_SPANS)
    email = F.when(text.contains("@"), found_at(text, EMAIL)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(found_at(text, IP), lambda x: F.forall(F.split(x["m"], r"\."), _octet))).otherwise(none)
    card = F.when(
        text.rlike(CARD_HINT),
        F.filter(found_at(text, CARD), lambda x: F.when(F.length(x["m"]) < 13, False).otherwise(F.transform(F.array(_digits(x["m"])), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))[0])),
    ).otherwise(none)
    phone = F.when(text.contains("+"), F.filter(found_at(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))).otherwise(none)
    kind = lambda a, k: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(k).alias("k")))
    return F.concat(*[kind(a, k) for k, a in enumerate((email, ip, card, phone))])


def _ent(x: Column) -> list[Column]:
    """Hashes of an entity and of its group."""
    m, kind = F.lower(x["m"]), x["k"]
    group = F.when(kind == 0, F.substring_index(m, "@", -1)).when(kind == 1, F.substring_index(m, ".", 3)).otherwise(F.substring(_digits(m), 1, 6))
    return [F.xxhash64(F.lit("entity"), kind, m), F.xxhash64(F.lit("group"), kind, group)]


def _held(known: DataFrame) -> DataFrame:
    """(dk, ents, terms): hashes of the entities, and hash and place of each term, of the documents with entities."""
    terms = F.transform(found_at(F.col("_text"), TERM), lambda t: F.struct(F.xxhash64(native.lowered(t["m"])).alias("term"), t["s"].alias("s"), t["e"].alias("e")))
    ents = F.array_distinct(F.flatten(F.transform("found", lambda x: F.array(*_ent(x)))))
    return known.where(F.size("found") > 0).select("dk", ents.alias("ents"), terms.alias("terms"))


def _classed(held: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """held with `ent`s that are classes of entities in the same documents, and (ent, n), their documents."""
    held = scratch.materialize(held.withColumn("rid", F.monotonically_increasing_id()))
    each = held.select("rid", "dk", F.explode("ents").alias("ent"))
    print_of = lambda i: F.sum(F.xxhash64(F.lit(i), "dk").cast("decimal(20,0)"))
    of = each.groupBy("ent").agg(F.count(F.lit(1)).alias("n"), print_of(1).alias("a"), print_of(2).alias("b"))
    of = scratch.materialize(of.select("ent", "n", F.xxhash64("n", "a", "b").alias("cls")))
    # the same for few entities of many documents as for the others
    keyed = each.select("rid", "ent").join(F.broadcast(of.where(F.col("n") >= least).select("ent", "cls")), "ent", "left")
    rest = keyed.where(F.col("cls").isNull()).drop("cls").join(of.where(F.col("n") < least).select("ent", "cls"), "ent")
    mine = keyed.where(F.col("cls").isNotNull()).unionByName(rest).groupBy("rid").agg(F.collect_set("cls").alias("ents"))
    n = of.select(F.col("cls").alias("ent"), "n").distinct()
    return scratch.materialize(held.drop("ents").join(mine, "rid").drop("rid")), scratch.materialize(n)


def _pairs(held: DataFrame) -> DataFrame:
    """(dk, ent, term) of each document once."""
    x = held.select("dk", "ents", F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("ts"))
    many = F.size("ents").cast("long") * F.size("ts") > MANY_PAIRS
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ts") - 1) / PART).cast("int")), lambda i: F.slice("ts", i * PART + 1, F.lit(PART)))
    dealt = x.where(many).select("dk", "ents", F.posexplode(parts).alias("part", "ts")).repartition("dk", "part").drop("part")
    return x.where(~many).unionByName(dealt).select("dk", "ents", F.explode("ts").alias("term")).select("dk", F.explode("ents").alias("ent"), "term")


def _with(df: DataFrame, counts: DataFrame, key: str, least: float) -> DataFrame:
    """df joined with counts (key, value) of which one is for each key; keys of `least` or more by broadcast."""
    value = next(c for c in counts.columns if c != key)
    hot = df.join(F.broadcast(counts.where(F.col(value) >= least)), key, "left")
    rest = hot.where(F.col(value).isNull()).drop(value).join(counts.where(F.col(value) < least), key)
    return hot.where(F.col(value).isNotNull()).unionByName(rest)


def _keyed(docs: DataFrame) -> DataFrame:
    text = native.text_of("text")
    return docs.withColumn("_text", text).withColumn("dk", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")))


def lower_bound(c: Column, n: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval of a share c / n."""
    p = c / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def verdict(c: Column, df: Column, n: Column, n_docs: int) -> Column:
    """4 if the term is to be removed, 5 if generalised, else null."""
    told = F.greatest(lower_bound(c, df), F.lit(1e-12))
    left, gain = -F.log2(told), F.log2(told * F.lit(float(n_docs)) / n)
    return F.when(gain < GAIN, F.lit(None).cast("int")).when(left <= REMOVE, 4).when(left <= GENERALISE, 5)


def disclosures(docs: DataFrame, held: DataFrame, n: DataFrame, n_docs: int) -> DataFrame:
    """(ent, term, k): the terms to remove (4) or generalise (5) by each class of entities; n: (ent, n) of the classes."""
    one = F.count(F.lit(1))
    each = F.array_distinct(F.transform(native.found(native.lowered(native.text_of("text")), TERM), lambda t: F.xxhash64(t)))
    df_ = scratch.materialize(docs.select(F.explode(each).alias("term")).groupBy("term").agg(one.alias("df")))
    both = scratch.materialize(_pairs(held).groupBy("ent", "term").agg(one.alias("c")))
    least = max(2.0, n_docs / HOT)
    both = _with(_with(both, n, "ent", least), df_, "term", least)
    k = verdict(F.col("c"), F.col("df"), F.col("n"), n_docs)
    return both.where(F.col("n") < n_docs).withColumn("k", k).where(F.col("k").isNotNull()).select("ent", "term", "k")


#: Names of columns that scan() and sanitise() work with.
_OWN = ("found", "terms", "dk", "_text", "_dk", "_cuts")


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of those names renamed, and the way back."""
    back = {scratch.fresh([*docs.columns, *_OWN], f"aside_{c}")[0]: c for c in docs.columns if c in _OWN}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def scan(docs: DataFrame) -> DataFrame:
    """docs with `found` (entities by kind and start) and `terms` (array<struct<s, e, k>> by start) of terms that disclose them."""
    docs, back = _aside(docs.drop("found", "terms"))
    return _scanned(docs).withColumnsRenamed(back)


def _scanned(docs: DataFrame) -> DataFrame:
    known = _keyed(docs).withColumn("found", entities(F.col("_text")))
    n_docs = docs.count()
    held, n = _classed(_held(known), max(2.0, n_docs / HOT))
    flagged = disclosures(docs, held, n, n_docs)
    told = _pairs(held).join(flagged, ["ent", "term"]).groupBy("dk", "term").agg(F.min("k").alias("k"))
    places = held.select("dk", F.explode("terms").alias("t")).select("dk", "t.term", "t.s", "t.e")
    by = places.join(told, ["dk", "term"]).groupBy("dk", "s", "e").agg(F.min("k").alias("k")).groupBy("dk").agg(F.array_sort(F.collect_list(F.struct("s", "e", "k"))).alias("terms"))
    out = known.drop("_text").join(by.withColumnRenamed("dk", "_dk"), F.col("dk") == F.col("_dk"), "left").drop("_dk", "dk")
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    # a term within another entity's span is covered already
    clear = F.filter(F.coalesce("terms", none), lambda t: ~F.exists(F.col("found"), lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"])))
    return out.withColumn("terms", clear)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kind, disclosing terms removed or generalised."""
    names = docs.columns
    docs, back = _aside(docs)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""), F.lit("[TERM]"))
    cut = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(marks, x["k"] + 1).alias("by")))
    df = _scanned(docs).withColumn("_cuts", F.array_sort(F.concat(cut(F.col("found")), cut(F.col("terms")))))
    df = df.withColumn("text", F.when(F.size("_cuts") > 0, native.replaced(F.col("text"), F.col("_cuts"))).otherwise(F.col("text")))
    return df.select(*docs.columns).withColumnsRenamed(back).select(*names)


def joined(*spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.concat(*[F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))) for s in spans]), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, terms = F.col("found"), F.col("terms")
    n = lambda k: F.size(F.filter(found, lambda x: x["k"] == k)).cast("long")
    of = lambda k: F.filter(terms, lambda x: x["k"] == k)
    by_kind = F.concat(of(4), of(5))
    return scan(docs).select(
        "doc_id",
        *[n(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(joined(found).cast("binary"), 256).alias("base_sha256"),
        joined(found, by_kind).alias("spans"),
        F.size(terms).cast("long").alias("n_terms"),
    )
