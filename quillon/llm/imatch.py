"""Document fingerprints by I-Match; DataFrame operations only.

Terms whose document frequency lies in a band (by inverse document frequency)
make up the lexicon. A document's distinct lexicon terms are sorted, and for
each of several randomised subsets of the lexicon, which overlap and are of
different sizes, those in it are hashed to 64 bits; the hashes together are the
fingerprint. Two fingerprints are alike by the share of subsets, of those in
which either has a term, whose hashes agree: large subsets agree only in close
copies, small ones also where much of a text has changed.

The lexicon is one row with a sorted array, which is broadcast. The band bounds
it, whatever the input: no more than (mean distinct terms of a document) / (least
share of documents) terms can lie in it.

Edge cases: null texts count as empty; a text without a lexicon term has the
hash of the whole text as its fingerprint, and is alike (1) only to equal texts;
texts of any length are read whole; rows with equal doc_id share the next
document, which is the least text of the next id; with a single id, the next
document is the document itself; null doc_ids are one id, the last one, whose
rows stay where they are; every number is an id like any other; an empty
table stays empty; ``fingerprints`` replaces a column named fingerprint, all other
columns pass through; ``edited_fingerprints`` reads doc_id and text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Stored, fresh, parts

#: The band: shares of all documents that a term must be in, and may be in at the most.
LEAST_SHARE, MOST_SHARE = 0.01, 0.2
#: How many subsets there are that keep one term in so many.
RATES = {2: 2, 4: 2, 8: 2, 16: 2, 32: 8, 64: 8, 128: 8}
SUBSETS = sum(RATES.values())
#: Ids of one range when finding the next document.
RANGE_IDS = 100_000
_NONE = "-" * 16


def _primes(n: int) -> list[int]:
    """The first ``n`` primes above 10000."""
    out, k = [], 10_000
    while len(out) < n:
        k += 1
        if all(k % d for d in range(2, int(k**0.5) + 1)):
            out.append(k)
    return out


def subsets() -> list[tuple[int, int]]:
    """(modulus, bound): a term is in the subset if its hash modulo the modulus is below the bound."""
    rates = [rate for rate, n in RATES.items() for _ in range(n)]
    return [(prime, prime // rate) for prime, rate in zip(_primes(SUBSETS), rates, strict=True)]


def _terms(name: str) -> str:
    """SQL: distinct 64-bit hashes of the words in the text column ``name``, A-Z lower-cased."""
    return rf"array_distinct(transform(filter(split(lower({name}), r'[^\p{{L}}\p{{N}}]+'), w -> w != ''), w -> xxhash64(w)))"


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row (lexicon): the sorted hashes of all terms whose share of documents lies in the band, over all documents."""
    n = docs.count()
    counted = docs.select(F.explode(F.expr(_terms("text"))).alias("term")).groupBy("term").count()
    band = counted.filter((F.col("count") >= max(2, least * n)) & (F.col("count") <= most * n))
    return band.agg(F.array_sort(F.collect_list("term")).alias("lexicon"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def subset_hashes(terms: Column) -> Column:
    """For each subset the hash of its sorted terms, null without any."""
    kinds = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(b).cast("long").alias("b")) for m, b in subsets()))

    def one(known: Column, kind: Column) -> Column:
        mine = F.filter(known, lambda t: F.pmod(t, kind["m"]) < kind["b"])
        return _bound(mine, lambda m: F.when(F.size(m) > 0, F.xxhash64(m)))

    return _bound(terms, lambda known: F.transform(kinds, lambda kind: one(known, kind)))


def _printed(docs: DataFrame, text: str, terms: DataFrame, out: str) -> DataFrame:
    """``docs`` with ``out``: the hashes of the text column's subsets, and the text's SHA-256 if it has no lexicon term."""
    name = fresh(docs, "imatch_terms")
    known = docs.crossJoin(F.broadcast(terms.withColumnRenamed("lexicon", name)))  # a single row
    known = known.withColumn(name, F.array_sort(F.array_intersect(F.expr(_terms(f"`{text}`")), F.col(name))))
    value = F.struct(subset_hashes(F.col(name)).alias("hashes"), F.when(F.size(name) == 0, F.sha2(F.col(text), 256)).alias("bare"))
    return known.withColumn(out, value).drop(name)


def as_text(of: Column) -> Column:
    """The fingerprint as a string: the subsets' hashes, sixteen letters each; without any term, the whole text's hash."""
    joined = F.array_join(F.transform(of["hashes"], lambda h: F.coalesce(F.lpad(F.hex(h), 16, "0"), F.lit(_NONE))), "")
    return F.when(of["bare"].isNull(), joined).otherwise(F.concat(F.lit("text:"), of["bare"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets among those in which either of two fingerprints has a term; terms that no subset holds leave equal ones alike."""
    both = F.arrays_zip(a["hashes"].alias("x"), b["hashes"].alias("y"))
    some = F.size(F.filter(both, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    same = F.size(F.filter(both, lambda p: p["x"] == p["y"]))
    bare = a["bare"].isNotNull() | b["bare"].isNotNull()
    return F.when(bare, F.coalesce(a["bare"] == b["bare"], F.lit(False)).cast("double")).when(some == 0, 1.0).otherwise(same / some).cast("double")


def next_ids(ids: DataFrame) -> DataFrame:
    """(none, id, next_none, next_id) in descending order, a null id (``none``) last, the last followed by the first; ids are distinct.

    Ids are dealt into ranges and looked up within each; only each range's
    highest id crosses over.
    """
    n = ids.count()
    order = [F.col("none").asc(), F.col("id").desc()]
    dealt = ids.repartitionByRange(parts(n, RANGE_IDS, 8), *order).withColumn("part", F.spark_partition_id())
    dealt = Stored(dealt, "ranges").read()
    # a range's first id is the least by these: not none, and the highest
    heads = dealt.groupBy("part").agg(F.max(F.struct((~F.col("none")).alias("some"), "id")).alias("head"))
    ordered = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    first = F.first("head").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = heads.select("part", F.coalesce(F.lead("head").over(ordered), first).alias("after"))
    inside = F.lead(F.struct((~F.col("none")).alias("some"), "id")).over(Window.partitionBy("part").orderBy(*order))
    found = dealt.withColumn("inside", inside).join(following, "part").withColumn("then", F.coalesce("inside", "after"))
    return found.select("none", "id", (~F.col("then.some")).alias("next_none"), F.col("then.id").alias("next_id"))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``docs`` with fingerprint, a string; equal texts have equal ones."""
    docs = docs.drop("fingerprint")
    terms = Stored(lexicon(docs, least, most), "lexicon").read()
    text, value = fresh(docs, "imatch_text"), fresh(docs, "imatch_print")
    printed = _printed(docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))), text, terms, value)
    return printed.withColumn("fingerprint", as_text(F.col(value))).drop(text, value)


def edited_fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    Texts move once, by id, with their fingerprints (both sides of the join read the
    one exchange); what the next document lends to the edit moves once more.
    """
    terms = Stored(lexicon(docs, least, most), "lexicon").read()
    plain = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = plain.groupBy("none", "id").agg(F.max((F.length("text") / 2).cast("int")).alias("half"), F.count("*").alias("rows"))
    ids = Stored(ids, "ids").read()
    lends = ids.join(next_ids(ids.select("none", "id")), ["none", "id"])
    lends = Stored(lends.select(F.col("none").alias("for_none"), F.col("id").alias("for_id"), "half", "next_none", "next_id"), "next-documents").read()
    lent = lambda rows: rows.select("for_id", F.substring("text", F.lit(1), F.col("half")).alias("head"), F.col("print").alias("next_print"))

    # the same columns on both sides of the join, so that they read one exchange
    hashed = _printed(plain.filter(~F.col("none")).select("id", "text"), "text", terms, "print").repartition("id")
    least_text = hashed.select("id", "text", "print")
    if not ids.filter("rows > 1 AND NOT none").isEmpty():
        least_text = least_text.groupBy("id").agg(F.min(F.struct("text", "print")).alias("x")).select("id", "x.*")
    heads = lent(least_text.join(lends.filter("NOT for_none AND NOT next_none"), F.col("id") == F.col("next_id")))
    nulls = ids.filter("none").isEmpty()
    if not nulls:  # all of them follow and are followed by one document each, whose row goes to all tasks
        unnamed = _printed(plain.filter("none").select("id", "text"), "text", terms, "print")
        least_null = unnamed.agg(F.min(F.struct("text", "print")).alias("x")).select("x.*")
        heads = heads.unionByName(lent(lends.filter("NOT for_none AND next_none").crossJoin(F.broadcast(least_null))))
        after = lends.filter("for_none").first()
        following = least_null
        if not after["next_none"]:
            first = _printed(plain.filter(~F.col("none") & (F.col("id") == after["next_id"])), "text", terms, "print")
            following = first.agg(F.min(F.struct("text", "print")).alias("x")).select("x.*")
        of_null = lent(following.withColumn("for_id", F.lit(0).cast("long")).withColumn("half", F.lit(after["half"])))
    both = hashed.join(heads, F.col("id") == F.col("for_id")).withColumn("none", F.lit(False))
    if not nulls:
        both = both.unionByName(unnamed.crossJoin(F.broadcast(of_null)).withColumn("none", F.lit(True)))
    n_chars = F.length("text").cast("long")
    half = (n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n_chars - half).cast("int")), F.substring("head", F.lit(1), half))
    both = both.withColumn("n_chars", n_chars).withColumn("edited", edited).drop("head", "text")
    both = _printed(both, "edited", terms, "edited_print")
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
