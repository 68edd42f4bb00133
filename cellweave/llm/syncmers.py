"""Document fingerprints from closed syncmers.

A text's words (cut into pieces of at most 12 characters) are hashed. Of every k words in a row, the k-mer, it is asked
whether its least inner word lies at its first or last place: then it is a closed syncmer, which depends on nothing
outside it, so the same passage gives the same anchors in any text. A fingerprint is the hashes of all of them in the
order of their first places, whatever the length of the text. Two are compared by position: hashes that both hold count
if their shift agrees with the median shift; likeness is Dice's share of them.

Scale: one shuffle of the texts and their anchors by ranges of doc_id, which also brings each document's neighbour (the
first document of a range is a guest at the end of the one above it), so anchors of a document as its neighbour's next
are not computed again; no row meets all others. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, table
from .native import hashed, let, up_to

PIECE = "[^\\x20\\x09-\\x0D]{1,12}"
#: Bits for an anchor's place while two fingerprints are compared (places of longer ones count modulo it).
PLACE = 24


def anchors(text: Column, k: int) -> Column:
    """The closed syncmers' hashes, each once, in order of their first places. A text of fewer than k pieces has one for
    each piece. k is 3 or more."""

    def of(h: Column) -> Column:
        at = lambda i: [F.get(h, i + j) if j else F.get(h, i) for j in range(k)]

        def closed(i: Column) -> Column:
            first, *inner, last = at(i)
            return F.least(first, last) <= (F.least(*inner) if len(inner) > 1 else inner[0])

        found = F.transform(F.filter(up_to(F.size(h) - (k - 1)), closed), lambda i: F.xxhash64(*at(i)))
        return F.when(F.size(h) >= k, found).otherwise(F.transform(h, lambda x: F.xxhash64(x)))

    return F.array_distinct(let(hashed(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), of))


def written(found: Column) -> Column:
    """A fingerprint as text: its hashes in order, as decimal numbers."""
    return F.concat_ws(" ", found.cast("array<string>"))


def likeness(a: Column, b: Column, slack: int = 32) -> Column:
    """From 0 to 1: Dice's share of hashes that both hold at places whose shift is the usual one. Two empty fingerprints
    are alike. Hashes (39 bits of them) with their side and place are sorted together, so equal ones lie side by side."""

    def sided(x: Column, side: int) -> Column:
        place = lambda i: i.cast("long").bitwiseAND(F.lit((1 << PLACE) - 1))
        return F.transform(x, lambda y, i: y.bitwiseAND(F.lit(-1 << (PLACE + 1))).bitwiseOR(place(i)).bitwiseOR(F.lit(side << PLACE)))

    def shifts(both: Column) -> Column:
        twice = F.filter(up_to(F.size(both)), lambda i: F.shiftright(F.get(both, i).bitwiseXOR(F.get(both, i - 1)), PLACE) == 1)
        return F.transform(twice, lambda i: F.get(both, i) - F.get(both, i - 1) - (1 << PLACE))

    def agreeing(s: Column) -> Column:
        return let(F.get(F.sort_array(s), F.floor(F.size(s) / 2).cast("int")), lambda usual: F.size(F.filter(s, lambda x: F.abs(x - usual) <= slack)))

    n = let(let(F.sort_array(F.concat(sided(a, 0), sided(b, 1))), shifts), agreeing)
    part = F.when(F.arrays_overlap(a, b), 2.0 * n / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(part)


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below value, by binary search; null for null."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")

    def search(at: Column, step: int) -> Column:
        if not step:
            return at
        go = at + F.when(F.coalesce(F.get(held, at + (step - 1)) < value, F.lit(False)), F.lit(step)).otherwise(F.lit(0))
        return let(go, lambda x: search(x, step >> 1))

    return F.when(value.isNotNull(), search(F.lit(0), 1 << (len(cuts).bit_length() - 1)))


def with_next(docs: DataFrame, more: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with the columns `more`, computed once a row, and, as next and next_<name>, those of the next
    document in descending order of doc_id; after the last comes the first. Of equal ids the greater text comes first;
    null ids come last, in descending order of their text's hash."""
    parts = parts_for(docs, most=100_000)  # the cuts are literals of the plan
    cuts = sorted({int(c) for c in docs.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    below = F.shiftright((F.shiftright("tie", 32) + (1 << 31)) * parts, 32) - parts  # ranges of null ids, by hash
    dealt = docs.withColumn("tie", tie).withColumn("range", F.coalesce(range_of(F.col("doc_id"), cuts).cast("long"), below))
    heads = dealt.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("head"))  # a row for each range
    all_ = Window.partitionBy().orderBy("range")
    top = F.first("range").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("range").alias("from"), F.col("head.doc_id").alias("head"), F.col("head.tie").alias("head_tie"), F.coalesce(F.lead("range").over(all_), top).alias("to"))
    heads = F.broadcast(heads)  # at most 2 * parts rows of four numbers
    guests = dealt.join(heads, dealt["doc_id"].eqNullSafe(heads["head"]) & (dealt["tie"] == heads["head_tie"]) & (dealt["range"] == heads["from"]))
    guests = guests.select("doc_id", "text", "tie", F.col("to").alias("range"), F.lit(True).alias("guest"))
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests).withColumns(more)
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc())
    ahead = {"next": F.lead("text").over(order)} | {f"next_{c}": F.lead(c).over(order) for c in more}
    return both.withColumns(ahead).filter(~F.col("guest")).select("doc_id", "text", *more, *ahead)


def fingerprinted(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Null text: empty, which has an empty fingerprint. Null doc_id: after all others. Repeated rows follow each other.
    One document follows itself. Extra columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, {"own": anchors(F.col("text"), k)}).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next", F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    found = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", anchors(F.col("edited"), k).alias("changed"))
    own, changed, following = F.col("own"), F.col("changed"), F.col("next_own")
    return found.select("doc_id", "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"), k=5)
